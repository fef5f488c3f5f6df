"""Sequences of scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import GAP, reverse_complement


def scaffold_sequences(elements: DataFrame, sequences: DataFrame, min_length: int = 0) -> DataFrame:
    """(scf, len, seq): the placed contigs, turned where they run backwards, with GAP times N between them.

    elements: (scf, ord, name, fwd); sequences: (name, seq).  A scaffold with a contig of no
    sequence has none; scaffolds under ``min_length`` are left out.  Names are joined first,
    so each sequence is shuffled once, with its scaffold.
    """
    turned = F.when(F.col("fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    placed = elements.join(sequences, "name", "left").select("scf", "ord", turned.alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("part", F.lit("")).alias("part"))))
    whole = F.array_join(F.transform("parts", lambda x: x["part"]), "N" * GAP)
    grouped = placed.groupBy("scf").agg(parts.alias("parts"), F.count_if(F.coalesce(F.length("part"), F.lit(0)) == 0).alias("missing"))
    return grouped.filter("missing = 0").select("scf", whole.alias("seq")).select("scf", F.length("seq").cast("long").alias("len"), "seq").filter(F.col("len") >= min_length)


def sequence_pieces(elements: DataFrame, sequences: DataFrame) -> DataFrame:
    """(scf, ord, part): for scaffolds too long for one value; written in order they are the sequence."""
    turned = F.when(F.col("fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    gap = F.when(F.col("ord") > 1, F.lit("N" * GAP)).otherwise("")
    return elements.join(sequences, "name").select("scf", "ord", F.concat(gap, turned).alias("part"))
