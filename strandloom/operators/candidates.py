"""Mutual candidates and the choice of an orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clearly_more
from .weights import CELLS


def in_both_directions(edges: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Edges whose reverse is there too.  Both directions of a pair meet in one window, without a join."""
    a, b = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(first)]), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(second)])
    marked = edges.withColumns({"low_": F.least(a, b), "high_": F.greatest(a, b), "up_": a < b})
    pair = Window.partitionBy("low_", "high_")
    kept = marked.withColumn("both_", F.min("up_").over(pair) != F.max("up_").over(pair)).filter("both_")
    return kept.drop("low_", "high_", "up_", "both_")


def mutual(candidates: DataFrame) -> DataFrame:
    """Candidates (ctg1, end1, ctg2, end2, ...) whose other end has this end among its own; never a contig with itself."""
    return in_both_directions(candidates.filter("ctg1 <> ctg2"), ["ctg1", "end1"], ["ctg2", "end2"])


def mutual_contigs(candidates: DataFrame) -> DataFrame:
    """The same by contig only."""
    return in_both_directions(candidates.filter("ctg1 <> ctg2"), ["ctg1"], ["ctg2"])


def orientation(cell_rows: DataFrame, level: float | None = None) -> DataFrame:
    """cells with ``cell``: the place (0 to 3) of the largest of mm, mp, pm, pp; null if two are largest.

    With ``level`` it is null too unless the largest has clearly more hits (hits: those of the
    largest cell) than the second, and for candidates that are not the first of their contig (rank).
    """
    values = F.array(*[name for name, *_ in CELLS])
    largest = F.array_max(values)
    times = F.size(F.filter(values, lambda x: x == largest))
    only = times == 1
    if level is not None:
        second = F.element_at(F.array_sort(values), 3)
        only = only & (F.col("rank") == 1) & clearly_more(F.col("hits"), second / largest * F.col("hits"), level)
    return cell_rows.withColumn("cell", F.when(only, F.array_position(values, largest) - 1))


def oriented(cell_rows: DataFrame, level: float | None = None) -> DataFrame:
    """Edges (ctg1, end1, ctg2, end2, w) of the cells that have an orientation."""
    ends = lambda at: F.element_at(F.array(*[F.lit(c[at]) for c in CELLS]), (F.col("cell") + 1).cast("int"))
    found = orientation(cell_rows, level).filter("cell is not null")
    return found.select("ctg1", ends(1).alias("end1"), "ctg2", ends(2).alias("end2"), F.col("best").alias("w"))


def swapped(edges: DataFrame, w: Column | str = "w") -> DataFrame:
    """The same edges from their other ends."""
    return edges.select(F.col("ctg2").alias("ctg1"), F.col("end2").alias("end1"), F.col("ctg1").alias("ctg2"), F.col("end1").alias("end2"), w)
