"""AGP files and the assembly format made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import GAP
from ..operators.iterate import running
from .text import numbered_lines, read_lines, write_lines

def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """(number, object, comp, len, orient) of the component lines (type W), numbered as in the file."""
    parts = F.split("value", "\t")
    field = lambda i: F.get(parts, F.lit(i))
    kept = numbered_lines(read_lines(spark, path).filter(~F.col("value").startswith("#") & (field(4) == "W")))
    return kept.select((F.col("number") + 1).alias("number"), field(0).alias("object"), field(5).alias("comp"), field(7).try_cast("long").alias("len"), field(8).alias("orient"))


def rows(placed: DataFrame, first: int = 1) -> DataFrame:
    """Component rows (number, object, comp, len, orient) of placements (scf, ord, name, len, fwd), in order of scaffold."""
    counts = placed.groupBy("scf").agg(F.count(F.lit(1)).alias("n"))
    starts = running(counts, [F.col("scf")], F.col("n")).select(F.col("scf").alias("of"), "before")
    joined = placed.join(starts, F.col("scf") == F.col("of"))
    return joined.select((F.col("before") + F.col("ord") + first - 1).alias("number"), F.col("scf").cast("string").alias("object"), F.col("name").alias("comp"), "len", F.when(F.col("fwd"), "+").otherwise("-").alias("orient"))


def agp_lines(placed: DataFrame) -> DataFrame:
    """(scf, part, value): the lines of an AGP file, with a gap of GAP bases between neighbours."""
    start, end = F.col("off") + 1, F.col("off") + F.col("len")
    text = lambda c: c.cast("string")
    contig = F.concat_ws("\t", text(F.col("scf")), text(start), text(end), text(F.col("ord") * 2 - 1), F.lit("W"), "name", F.lit("1"), text(F.col("len")), F.when(F.col("fwd"), "+").otherwise("-"))
    gap = F.concat_ws("\t", text(F.col("scf")), text(end + 1), text(end + GAP), text(F.col("ord") * 2), F.lit("N"), F.lit(str(GAP)), F.lit("scaffold"), F.lit("yes"), F.lit("proximity_ligation"))
    line = lambda part, value: F.struct(part.alias("part"), value.alias("value"))
    lines = F.when(F.col("is_tail"), F.array(line(F.col("ord") * 2 - 1, contig))).otherwise(F.array(line(F.col("ord") * 2 - 1, contig), line(F.col("ord") * 2, gap)))
    return placed.select("scf", F.inline(lines))


def assembly_lines(components: DataFrame) -> DataFrame:
    """(object, first, members): for each object its components' numbers, negative where they run backwards.

    The file lists the objects by ``first``, after a line ">comp number len" for each component.
    """
    sign = F.concat(F.when(F.col("orient") == "-", "-").otherwise(""), F.col("number").cast("string"))
    members = F.array_sort(F.collect_list(F.struct("number", sign.alias("sign"))))
    grouped = components.groupBy("object").agg(F.min("number").alias("first"), members.alias("members"))
    return grouped.select("object", "first", F.array_join(F.transform("members", lambda x: x["sign"]), " ").alias("members"))


def write_assembly(components: DataFrame, path: str) -> None:
    contig = components.select(F.lit(0).alias("section"), F.format_string("%020d", "number").alias("ord"), F.concat(F.lit(">"), "comp", F.lit(" "), F.col("number").cast("string"), F.lit(" "), F.col("len").cast("string")).alias("value"))
    groups = assembly_lines(components).select(F.lit(1).alias("section"), F.format_string("%020d", "first").alias("ord"), F.col("members").alias("value"))
    write_lines(contig.unionByName(groups), path)
