"""FASTA files, plain or gzip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the name ends at the first white space, lines are joined, the first record of a name stays.

    A record is one row, split where a line begins with ">"; line ends may be of either kind.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.monotonically_increasing_id().alias("at"))
    head = F.regexp_extract("value", "^([^\\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", "^[^\\n]*", ""), "\\s+", "")
    rows = records.select("at", head.alias("name"), body.alias("seq")).filter("name <> ''")
    return rows.groupBy("name").agg(F.min_by("seq", "at").alias("seq"))


def with_sequences(sequences: DataFrame, fasta: DataFrame) -> DataFrame:
    """Sequences (name, len, ...) with seq of the file; a length of 0 is filled in."""
    joined = sequences.drop("seq").join(fasta, "name", "left")
    return joined.withColumn("len", F.when(F.coalesce("len", F.lit(0)) == 0, F.coalesce(F.length("seq"), F.lit(0))).otherwise(F.col("len")).cast("long"))


def write_fasta(sequences: DataFrame, path: str, min_length: int = 0) -> None:
    """Records (name, seq) of at least ``min_length`` as ">name len" and the sequence in one line."""
    kept = sequences.filter(F.length("seq") >= F.greatest(F.lit(min_length), F.lit(1)))
    kept.select(F.concat(F.lit(">"), "name", F.lit(" "), F.length("seq").cast("string"), F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Scaffolds too long for one value, from pieces (scf, ord, part): lines of parts in order under each name."""
    head = pieces.select("scf").distinct().select("scf", F.lit(0).alias("ord"), F.concat(F.lit(">"), F.col("scf").cast("string")).alias("value"))
    rows = head.unionByName(pieces.select("scf", "ord", F.col("part").alias("value")))
    rows.repartitionByRange("scf").sortWithinPartitions("scf", "ord").select("value").write.mode("overwrite").text(path)
