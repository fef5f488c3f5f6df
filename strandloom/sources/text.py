"""Tab-separated files: indexes, link matrices, and what is written as lines.

Plain and gzip files are read alike.  Lines that lack the needed columns are skipped; missing
trailing numbers count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.iterate import running, settled

FAI = "name STRING, len BIGINT, offset BIGINT, linebases INT, linewidth INT"
LINKS = "ctg1 STRING, end1 STRING, ctg2 STRING, end2 STRING, weight DOUBLE, zone2 BIGINT, zone1 BIGINT, n BIGINT"


def _tabbed(spark: SparkSession, path: str, schema: str, least: str) -> DataFrame:
    found = spark.read.csv(path, sep="\t", schema=schema, mode="PERMISSIVE", quote="", escape="")
    numbers = [c for c, kind in found.dtypes if kind != "string"]
    return found.filter(F.col(least).isNotNull()).fillna(0, numbers)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Contigs (name, len, offset, linebases, linewidth) of a FASTA index."""
    return _tabbed(spark, path, FAI, "name")


def contigs(fai: DataFrame) -> DataFrame:
    """(tid, name, len, is_circ) of an index, numbered by offset, then name."""
    first = fai.groupBy("name").agg(F.min("offset").alias("offset"), F.min_by("len", "offset").alias("len"))
    numbered = running(first, [F.col("offset"), F.col("name")], F.lit(1))
    return numbered.select(F.col("before").cast("int").alias("tid"), "name", "len", F.lit(False).alias("is_circ"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A link matrix; rows without four columns are skipped."""
    return _tabbed(spark, path, LINKS, "end2")


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """Up to six columns of a BED-like file, without its track and browser lines."""
    lines = spark.read.text(path).filter(~F.col("value").rlike("^(track|browser)\\b"))
    parts = F.split("value", "\t")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    return lines.filter(F.length("value") > 0).select(F.get(parts, F.lit(0)).alias("name"), *[number(i).alias(c) for i, c in enumerate(("s", "e", "f4", "f5", "f6"), 1)])


def track_header(spark: SparkSession, path: str) -> DataFrame:
    """(name, description) of a file's track line."""
    line = spark.read.text(path).filter(F.col("value").startswith("track")).limit(1)
    of = lambda key: F.regexp_extract("value", f'{key}="?([^"]*?)"?(?: \\w+=|$)', 1)
    return line.select(of("name").alias("name"), of("description").alias("description"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines, and where they stand: files by name, then stretches of a file, then lines of a stretch."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", where.alias("at"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (section, ord, value) in that order, in parts: files whose names sort as their lines do, the header in the first.

    Parts are ranges of lines, dealt by samples of them, so no task holds the whole; joined by name they are the file.
    """
    lines.orderBy("section", "ord", "value").select("value").write.mode("overwrite").text(path)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """lines (at, ...) with ``number``: how many of them come before, counted in stretches of lines side by side."""
    stretch = F.struct("at.file", "at.begin", F.shiftright("at.line", 33).alias("split"))  # lines of one partition follow one another
    kept = settled(lines.withColumn("stretch_", stretch))
    starts = running(kept.groupBy("stretch_").agg(F.count(F.lit(1)).alias("n_")), [F.col("stretch_")], F.col("n_")).select(F.col("stretch_").alias("of_"), "before")
    rank = F.row_number().over(Window.partitionBy("stretch_").orderBy("at"))
    return kept.withColumn("rank_", rank).join(starts, F.col("stretch_") == F.col("of_")).withColumn("number", F.col("before") + F.col("rank_") - 1).drop("stretch_", "of_", "before", "rank_")


def write_links(links: DataFrame, path: str) -> None:
    """A link matrix in as many files as there are partitions; weights with six decimals."""
    weight = F.format_string("%.6f", F.col("weight").cast("double"))
    columns = [weight if c == "weight" else F.col(c).cast("string") for c in ("ctg1", "end1", "ctg2", "end2", "weight", "zone2", "zone1", "n")]
    links.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def signed(name: Column, forward: Column) -> Column:
    return F.concat(name, F.when(forward, "+").otherwise("-"))
