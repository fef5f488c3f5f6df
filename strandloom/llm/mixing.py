"""Mixing sources to target weights by systematic sampling.

Native: DataFrame functions only.  Within each source the expected number of copies of every
document is the same, target / source size.  Its running sum over a fixed order of the
source, plus one offset per source, crosses an integer now and then; the document at which it
crosses is emitted once per crossing.  The order goes by size class first, so that every
stretch of the running sum meets documents of like size and the words taken come near the
target.

The running sum needs no sort of a whole source: rows are ranked inside fine buckets
(source, size class, slice by a hash of doc_id), and the counts of the buckets are summed up.  A source
that holds a third of all rows is spread over as many buckets as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, unwrapped

WEIGHTS = (1, 2, 3)
#: No source is repeated more than this often.
MAX_REPEAT = 3
#: A hash of doc_id (where there is none, of the text) splits a size class in slices; a slice holds about so many rows of the table.
SLICE_ROWS = 20_000
#: Up to so many buckets (some 60 bytes each) their starts are broadcast, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Number of runs of characters that are not white space; 0 for null and empty texts."""
    # each run is turned into one character outside of white space, white space goes
    runs = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x")
    return F.coalesce(F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Water-filling over the sources: (source, source_size) gets its target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes.  A target stops at MAX_REPEAT times the source's size; the excess goes to the others
    by weight until none is above.  With the sources sorted by cap per unit of weight, those
    before some place are capped and the rest share what is left: the first place from which
    the share is not above the next cap.  Input and windows are over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = everything.orderBy("reach", "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    capped = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(weights, ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * MAX_REPEAT)
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("level"), F.col("reach")))
    return capped.select("source", "source_size", target.alias("target"))


def offset(seed: int) -> Column:
    """The offset of a source, from 0 to below 1: the first 32 bits of a digest of seed and name."""
    named = F.concat(F.lit(f"{seed}:"), F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source"))))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, keep: list[str] | None = None, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source, ...) as (row, size, source_size, target, copies).

    ``row`` has the columns ``keep`` of the input (all of them if None), ``copies`` says how
    often the mix takes it: 0 to MAX_REPEAT.  Null and empty texts have size 0; a source of
    size 0 is not taken.  A null source is a source of its own.  Repeated rows count one by
    one; rows with equal (size, doc_id) in a source are ranked by their text, and rows alike in
    all three are interchangeable.  Words of very long texts are all counted, and such a text is
    taken whole or not at all.  Columns of docs may have any names; an empty table gives an empty one.
    """
    columns = docs.columns if keep is None else keep
    rows = docs.count()  # of a Parquet table: footers only
    slices = max(1, -(-rows // SLICE_ROWS))
    size = n_words(F.col("text"))
    classed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "source", "doc_id", size.alias("size"),
        F.length(F.bin(size)).alias("class"),
        (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slices).alias("slice"),
        F.xxhash64("text").alias("tie"),
    )
    bucket = ["source", "class", "slice"]
    cells = materialize(classed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mixing-cells", rows)
    plan = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "of")
    before = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(*[F.col(c).alias(f"b_{c}") for c in bucket], "start", "source_size", "target")
    if cells.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = classed.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("slice") == F.col("b_slice")))
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("size", "doc_id", "tie"))
    ranked = placed.withColumn("place", F.col("start") + rank)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda i: F.floor(offset(seed) + rate * i)
    copies = crossed(F.col("place")) - crossed(F.col("place") - 1)
    return ranked.select("row", "size", "source_size", "target", F.least(copies, F.lit(MAX_REPEAT)).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken."""
    return unwrapped(mix(docs, seed=seed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    mixed = mix(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, text, '')), 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {SLICE_ROWS}.0))::BIGINT FROM documents) AS slice
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap,
         source_size::DOUBLE * 3 / ((place - 1) % 3 + 1)::DOUBLE AS reach
  FROM per_source),
level AS (
  SELECT min_by(level, (reach, place)) AS level FROM (
    SELECT reach, place,
           (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
    FROM weighed WINDOW before AS (ORDER BY reach, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE level <= reach),
ranked AS (
  SELECT doc_id, size, source_size, least(cap, weight * coalesce(level, reach)) AS target,
         ('0x' || left(md5('0:' || CASE WHEN s.source IS NULL THEN '0' ELSE '1' || s.source END), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off,
         row_number() OVER (PARTITION BY s.source ORDER BY length(bin(size)), slice, size, doc_id) AS place
  FROM sized s JOIN weighed w ON s.source IS NOT DISTINCT FROM w.source, level)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * least(3, floor(off + target / source_size * place) - floor(off + target / source_size * (place - 1)))::BIGINT END AS taken
FROM ranked
"""
