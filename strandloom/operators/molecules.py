"""Molecules of linked reads: sessions of a barcode along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import SECOND_READ, UNMAPPED, has_flag


def barcode(qname: Column, length: int = 16) -> Column:
    """The end of the query name."""
    return F.substring(qname, -length, length)


def barcode_hits(records: DataFrame, min_mapq: int = 0, barcode_length: int = 16) -> DataFrame:
    """(bc, scf, pos, mapq) of mapped first reads; scf is the record's tid."""
    kept = records.filter(~has_flag(F.col("flag"), UNMAPPED) & ~has_flag(F.col("flag"), SECOND_READ) & (F.col("mapq") >= min_mapq))
    return kept.select(barcode(F.col("qname"), barcode_length).alias("bc"), F.col("tid").alias("scf"), (F.col("pos0") + 1).cast("long").alias("pos"), F.col("mapq").cast("int").alias("mapq"))


def molecules(hits: DataFrame, max_span: int = 20_000, min_barcode: int = 20, max_barcode: int = 1_000_000, min_members: int = 5, min_length: int = 1000, min_mean_mapq: int = 20) -> DataFrame:
    """(bc, scf, s, e, n, mean_mapq) of hits (bc, scf, pos, mapq).

    Barcodes must have more than min_barcode and fewer than max_barcode hits.  Along a
    sequence a step of more than max_span begins a new molecule; molecules must have more than
    min_members hits, be longer than min_length and have a mean quality over min_mean_mapq.
    """
    by_bc = hits.groupBy("bc").agg(F.count(F.lit(1)).alias("of_bc")).filter((F.col("of_bc") > min_barcode) & (F.col("of_bc") < max_barcode))
    along = Window.partitionBy("bc", "scf").orderBy("pos", "mapq")
    step = F.coalesce(F.col("pos") - F.lag("pos").over(along) > max_span, F.lit(True))
    sessions = hits.join(by_bc.select("bc"), "bc", "left_semi").withColumn("begins", step.cast("int"))
    sessions = sessions.withColumn("session", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = sessions.groupBy("bc", "scf", "session").agg(F.min("pos").alias("s"), F.max("pos").alias("e"), F.count(F.lit(1)).alias("n"), F.floor(F.sum("mapq") / F.count(F.lit(1))).alias("mean_mapq"))
    kept = found.filter((F.col("n") > min_members) & (F.col("e") - F.col("s") > min_length) & (F.col("mean_mapq") > min_mean_mapq))
    return kept.select("bc", "scf", "s", "e", "n", "mean_mapq")


def merged_starts(found: DataFrame) -> DataFrame:
    """(scf, s, e): of molecules that start at one place, the longest."""
    return found.groupBy("scf", "s").agg(F.max("e").alias("e"))
