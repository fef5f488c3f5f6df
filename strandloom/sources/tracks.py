"""Coverage tracks and other exports, as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import running, settled
from .text import numbered_lines, read_lines, write_lines


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def wig_lines(windows: DataFrame, name: str, width: int = 1024) -> DataFrame:
    """(section, ord, value) of windows (scf, start, span, cov): fixed steps, and the last window of each scaffold by itself."""
    key = lambda place: F.concat(F.rpad(_text("scf"), 64, " "), F.lpad(place.cast("string"), 20, "0"))
    last = windows.groupBy("scf").agg(F.max_by(F.struct("start", "span", "cov"), "start").alias("x")).select("scf", "x.*")
    steps = windows.join(last.select("scf", F.col("start").alias("end")), "scf").filter("start < end")
    lines = [
        windows.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit("").alias("ord"), F.lit(f'track type="wiggle_0" name="{name}"').alias("value")),
        last.filter("start > 1").select(F.lit(1).alias("section"), key(F.lit(0)).alias("ord"), F.concat(F.lit("fixedStep chrom="), _text("scf"), F.lit(f" start=1 step={width} span={width}")).alias("value")),
        steps.select(F.lit(1).alias("section"), key(F.col("start")).alias("ord"), _text("cov").alias("value")),
        last.select(F.lit(1).alias("section"), key(F.col("start")).alias("ord"), F.concat(F.lit("variableStep chrom="), _text("scf"), F.lit(" span="), _text("span"), F.lit("\n"), _text("start"), F.lit(" "), _text("cov")).alias("value")),
    ]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def write_wig(windows: DataFrame, path: str, name: str, width: int = 1024) -> None:
    write_lines(wig_lines(windows, name, width), path)


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """(scf, s, span, cov) of a wiggle file's steps, fixed and variable; its other lines are passed over.

    A step's place follows from the declaration before it and the lines between.  Declarations
    are met by an equi-join on their number, which is counted in stretches of the file.
    """
    lines = numbered_lines(read_lines(spark, path).filter(~F.col("value").rlike("^(track|browser|#)")))
    declares = F.col("value").rlike("^(fixed|variable)Step ")
    begun = running(settled(lines.withColumn("declares", declares)), [F.col("number")], F.col("declares").cast("int")).withColumnRenamed("before", "earlier")
    field = lambda key: F.regexp_extract("value", f"{key}=(\\S+)", 1)
    number = lambda key, other: F.coalesce(field(key).try_cast("long"), F.lit(other))
    heads = begun.filter("declares").select(
        (F.col("earlier") + 1).alias("of"), F.col("number").alias("head"), field("chrom").alias("scf"), number("start", 1).alias("start"), number("step", 1).alias("step"),
        number("span", 1).alias("span"), F.col("value").startswith("fixed").alias("fixed"),
    )
    steps = begun.filter(~F.col("declares")).join(heads, F.col("earlier") == F.col("of"))
    parts = F.split(F.trim("value"), "\\s+")
    place = F.when(F.col("fixed"), F.col("start") + F.col("step") * (F.col("number") - F.col("head") - 1)).otherwise(F.get(parts, F.lit(0)).try_cast("long"))
    return steps.select("scf", place.alias("s"), "span", F.element_at(parts, -1).try_cast("long").alias("cov"))


def write_bedgraph(intervals: DataFrame, path: str) -> None:
    """(scf, s, e, cov), tab-separated, sorted by place in range partitions."""
    rows = intervals.repartitionByRange("scf", "s").sortWithinPartitions("scf", "s")
    rows.select(F.concat_ws("\t", _text("scf"), _text("s"), _text("e"), _text("cov")).alias("value")).write.mode("overwrite").text(path)


def write_bed(rows: DataFrame, path: str) -> None:
    """Rows of a pair BED (scf, s, e, read, mapq, strand), two for each pair."""
    columns = [_text(c) for c in ("scf", "s", "e", "read", "mapq", "strand")]
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def write_sizes(sizes: DataFrame, path: str) -> None:
    """(name, len), with a space between, the longest first, in range partitions."""
    sizes.orderBy(F.desc("len"), "name").select(F.concat_ws(" ", _text("name"), _text("len")).alias("value")).write.mode("overwrite").text(path)
