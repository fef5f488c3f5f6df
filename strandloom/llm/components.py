"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, itself included; minima are taken before anything is shuffled."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges (a, b) as (a, b): every node of more than one, with the smallest node of its component.

    Smallest nodes are left out.  ``rows``: about how many edges there are at most.  Each round is written to the shared folder; nothing is
    collected but a count and a checksum of the edges.
    """
    now = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges", rows)
    seen = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(sums) == seen or not sums[0]:
            return now
        seen = tuple(sums)
        later = materialize(small_star(large_star(now)), "edges", 2 * sums[0])
        discard(now)
        now = later
