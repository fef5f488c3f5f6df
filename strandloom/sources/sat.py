"""Scaffold graphs in their text format, as five DataFrames.

Tags: H header, S sequence, P path, L join, A assembly (a list of paths), C current assembly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import read_lines, signed, write_lines

#: Fixed value: the first line.
HEADER = "H\tVN:Z:0.1"


@dataclass
class ScaffoldGraph:
    """sequences (name, len, seq), joins (v, v_end, w, w_end, wt), paths (name, len, is_circ, elems), assemblies (name, place, path), current (name)."""

    sequences: DataFrame
    joins: DataFrame
    paths: DataFrame
    assemblies: DataFrame
    current: DataFrame

    def current_paths(self) -> DataFrame:
        """(path, place) of the current assembly."""
        chosen = self.assemblies.join(self.current, "name", "left_semi")
        return chosen.select("place", "path")

    def elements(self) -> DataFrame:
        """(path, ord, name, fwd) of all paths."""
        rows = self.paths.select(F.col("name").alias("path"), F.posexplode("elems").alias("place", "x"))
        return rows.select("path", (F.col("place") + 1).alias("ord"), F.col("x.name").alias("name"), F.col("x.fwd").alias("fwd"))

    def current_sizes(self) -> DataFrame:
        """(name, len) of the current assembly's paths."""
        held = self.current_paths().select(F.col("path").alias("name"))
        return self.paths.join(held, "name", "left_semi").select("name", "len")


def _first(rows: DataFrame) -> DataFrame:
    """Of rows (at, name, ...) with one name the first in the file stays."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("at"))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank", "at")


def _fields() -> tuple[Column, Callable[[int], Column]]:
    """The fields of a line, and one of them by its place."""
    parts = F.split("value", "\t")
    return parts, lambda i: F.get(parts, F.lit(i))


def conflicts(spark: SparkSession, path: str) -> DataFrame:
    """(tag, name, kept, ignored) of a graph's file: lines that another line of their name, before them, leaves without effect.

    A second path or assembly of a name is ignored whatever it says; a second line of a sequence
    only fills in what is missing, so it is in conflict where it says another length or other bases.
    """
    _, field = _fields()
    lines = read_lines(spark, path).filter(F.col("value").rlike("^[SPA]\t")).select(F.left("value", F.lit(1)).alias("tag"), field(1).alias("name"), "at", "value", field(2).try_cast("long").alias("len"), F.when(field(3) != "*", field(3)).alias("seq"))
    before = Window.partitionBy("tag", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    said = lambda c: F.first(c, True).over(before)
    known = lines.withColumn("kept", F.first("value").over(before)).withColumn("known_len", said(F.when(F.col("len") != 0, F.col("len")))).withColumn("known_seq", said("seq"))
    other = (F.col("tag") != "S") | ((F.col("len") != 0) & (F.col("len") != F.col("known_len"))) | (F.col("seq") != F.col("known_seq"))
    return known.filter(F.col("kept").isNotNull() & other).select("tag", "name", "kept", F.col("value").alias("ignored"))


def read_sat(spark: SparkSession, path: str) -> ScaffoldGraph:
    """Reads a graph; other tags are ignored.  A generated name that begins with c is a circle's."""
    lines = read_lines(spark, path)
    tagged = lambda tag: lines.filter(F.col("value").startswith(f"{tag}\t"))
    parts, field = _fields()
    seq = F.when(field(3) != "*", field(3))
    named = tagged("S").select("at", field(1).alias("name"), F.coalesce(field(2).try_cast("long"), F.lit(0)).alias("len"), seq.alias("seq"))
    known = F.min_by(F.when(F.col("len") != 0, F.col("len")), F.when(F.col("len") != 0, F.col("at")))  # of lines with one name, the first that says it
    sequences = named.groupBy("name").agg(F.coalesce(known, F.lit(0)).alias("len"), F.min_by("seq", F.when(F.col("seq").isNotNull(), F.col("at"))).alias("seq"))
    elems = F.transform(F.split(field(3), ","), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).alias("name"), (F.right(x, F.lit(1)) == "+").alias("fwd")))
    paths = _first(tagged("P").select("at", field(1).alias("name"), field(2).try_cast("long").alias("len"), field(1).rlike("^c[0-9]{9}$").alias("is_circ"), elems.alias("elems")))
    weight = F.regexp_extract(field(5), "^wt:f:(.*)$", 1).try_cast("float")
    joins = tagged("L").select(field(1).alias("v"), field(2).alias("v_end"), field(3).alias("w"), field(4).alias("w_end"), weight.alias("wt"))
    assemblies = _first(tagged("A").select("at", field(1).alias("name"), F.split(F.element_at(parts, -1), ",").alias("paths"))).select("name", F.posexplode("paths").alias("place", "path"))
    assemblies = assemblies.select("name", F.col("place").cast("long").alias("place"), "path").filter("path <> ''")
    current = tagged("C").select(F.max_by(field(1), "at").alias("name")).filter("name is not null")
    return ScaffoldGraph(sequences, joins, paths, assemblies, current)


def read_gfa(spark: SparkSession, path: str) -> ScaffoldGraph:
    """Sequences, joins and paths only, as a graph without assemblies."""
    graph = read_sat(spark, path)
    return replace(graph, assemblies=graph.assemblies.filter("false"), current=graph.current.filter("false"))


def lines_of(graph: ScaffoldGraph) -> DataFrame:
    """(section, ord, value): the lines of the file in order."""
    spark = graph.sequences.sparkSession
    row = lambda section, ord_, *parts: [F.lit(section).alias("section"), ord_.alias("ord"), F.concat_ws("\t", *parts).alias("value")]
    text = lambda c: F.col(c).cast("string")
    name = F.col("name")
    elems = F.array_join(F.transform("elems", lambda x: signed(x["name"], x["fwd"])), ",")
    listed = graph.assemblies.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("paths"))  # the format has an assembly in one line
    once = graph.joins.filter(F.concat("v", "v_end") < F.concat("w", "w_end"))  # each join is held in both directions
    return (
        spark.range(1).select(F.lit(0).alias("section"), F.lit("").alias("ord"), F.lit(HEADER).alias("value"))
        .unionByName(graph.sequences.select(*row(1, name, F.lit("S"), name, text("len"), F.coalesce("seq", F.lit("*")))))
        .unionByName(graph.paths.select(*row(2, name, F.lit("P"), name, text("len"), elems)))
        .unionByName(once.select(*row(3, F.col("v"), F.lit("L"), "v", "v_end", "w", "w_end", F.format_string("wt:f:%.6f", F.col("wt").cast("double")))))
        .unionByName(listed.select(*row(4, name, F.lit("A"), name, F.size("paths").cast("string"), F.array_join(F.transform("paths", lambda x: x["path"]), ","))))
        .unionByName(graph.current.select(*row(5, name, F.lit("C"), name)))
    )


def write_sat(graph: ScaffoldGraph, path: str) -> None:
    write_lines(lines_of(graph), path)


def gfa_lines(graph: ScaffoldGraph) -> DataFrame:
    """The same without assemblies."""
    return lines_of(graph).filter("section < 4")


def both_ways(joins: DataFrame) -> DataFrame:
    """Joins as read, with their reverses."""
    back = joins.select(F.col("w").alias("v"), F.col("w_end").alias("v_end"), F.col("v").alias("w"), F.col("v_end").alias("w_end"), "wt")
    return joins.unionByName(back).dropDuplicates(["v", "v_end", "w", "w_end"])
