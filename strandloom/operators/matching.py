"""Joins of ends: the edges that are the only best on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clearly_more
from .candidates import in_both_directions


def unique_best(edges: DataFrame, level: float | None = None, hits: str = "w") -> DataFrame:
    """Directed edges (ctg1, end1, ctg2, end2, w) that survive, in both directions.

    An edge survives if it is the one and only heaviest at its first end, and its reverse is
    so at the other.  Maxima are taken over all edges, so the order of removal plays no part.
    With ``level``, an end's heaviest must also have clearly more ``hits`` than its second, where it has one.
    """
    order = Window.partitionBy("ctg1", "end1").orderBy(F.desc("w"), "ctg2", "end2")
    first = edges.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("w").over(order)).withColumn("less", F.lead(hits).over(order)).filter("rank = 1")
    only = F.col("second").isNull() | (F.col("second") < F.col("w"))
    if level is not None:
        only = only & (F.col("second").isNull() | clearly_more(F.col(hits), F.col("less"), level))
    best = first.filter(only).select("ctg1", "end1", "ctg2", "end2", "w")
    return in_both_directions(best, ["ctg1", "end1"], ["ctg2", "end2"])
