"""Figures of an assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembly_metrics(scaffolds: DataFrame) -> DataFrame:
    """(n, total, longest, n50) of scaffolds (len).

    N50: the length at which the running sum from the longest down reaches half of the total.
    Lengths are first counted, so the window is over distinct lengths only.
    """
    counted = scaffolds.groupBy("len").agg(F.count(F.lit(1)).alias("times"))
    everything = Window.partitionBy(F.lit(0))
    running = F.sum(F.col("len") * F.col("times")).over(everything.orderBy(F.desc("len")))
    half = F.floor(F.sum(F.col("len") * F.col("times")).over(everything) / 2)
    seen = counted.withColumn("reached", running >= half)
    return seen.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("len") * F.col("times")), F.lit(0)).alias("total"),
        F.max("len").alias("longest"), F.max(F.when(F.col("reached"), F.col("len"))).alias("n50"),
    )
