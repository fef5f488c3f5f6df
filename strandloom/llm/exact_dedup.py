"""Exact deduplication with streaming state.

Every run lands its rows in a folder of its own below the checkpoint: the whole text, the digest
of the normalised text and a stable identifier.  A streaming query over all landings keeps one
entry of state for each digest, on disk (RocksDB) and without expiry: the smallest identifier so
far, its content locator (file and row of the landing) and the number of rows.  Later
micro-batches, and later runs on the same checkpoint, meet the state that earlier ones left.

A digest that is met again is a hit, and hits are checked byte by byte: the text at the locator,
of whichever run, and the texts of the rows that hit it must be one and the same.  Should two
texts ever share a digest, the rows of all runs with it are grouped by the whole text instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, exists, materialize, note, remove, scratch

#: Up to so many hit digests (some 100 bytes each) are broadcast to the landed rows, else joined by a shuffle.
BROADCAST_ROWS = 500_000

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB of disk for each small store
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of an ended query are closed then
}


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    text = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    return F.coalesce(text, F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


LANDED = "digest binary, doc_id long, run int, rid long, text string"


def land(docs: DataFrame, keep: list[str], folder: str, digest: Callable[[Column], Column] = sha256) -> int:
    """Writes (digest, doc_id, run, rid, text, rest) of docs below folder; rid tells repeated rows of a run apart.

    rest: the columns ``keep`` but for text.  Returns the number of the run.
    """
    spark, run = docs.sparkSession, 0
    while exists(spark, f"{folder}/landed/run-{run:09d}"):
        run += 1
    rest = [F.col(f"`{c}`") for c in keep if c != "text"] or [F.lit(True).alias("none")]
    landed = docs.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(run).alias("run"), F.monotonically_increasing_id().alias("rid"), "text", F.struct(*rest).alias("rest"))
    landed.write.parquet(note(f"{folder}/landed/run-{run:09d}"))
    return run


def identifier() -> Column:
    """Orders rows by doc_id, those without one last, and repeated rows as they landed."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "run", "rid")


def folded(records: DataFrame) -> DataFrame:
    """The state of each digest: (digest, first: identifier, locator, n)."""
    return records.groupBy("digest").agg(F.min(identifier()).alias("first"), F.min_by("locator", identifier()).alias("locator"), F.count(F.lit(1)).alias("n"))


def located(rows: DataFrame) -> DataFrame:
    """Landed rows with the locator of their content."""
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("locator"))


def stream_state(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs what has landed below folder and was not met before through the streaming state; returns the whole state.

    ``folder``: in a store that all executors share; a later call with the same folder goes on from its state.
    """
    out = f"{folder}/changes"
    with settings(spark, STATE):
        reader = spark.readStream.schema(LANDED)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        states = folded(located(reader.parquet(f"{folder}/landed/run-*")).select("digest", "doc_id", "run", "rid", "locator"))

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    if not exists(spark, out):
        return spark.createDataFrame([], states.schema)
    changes = spark.read.schema(states.schema).parquet(f"{out}/batch=*")
    # the last change of each digest has the largest count
    return changes.groupBy("digest").agg(F.min("first").alias("first"), F.min_by("locator", "first").alias("locator"), F.max("n").alias("n"))


def small(hits: DataFrame) -> DataFrame:
    """A written table, with the hint to broadcast it where its rows are few enough."""
    return F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits


def clashes(landed: DataFrame, hits: DataFrame, folder: str) -> DataFrame:
    """Digests of hits whose rows do not all have the text at the locator: (digest).

    landed: the present run's rows, in folder; what stands at a locator may be of any run there, and the
    runs that hits lead to are read with a join on locators.
    """
    spark = landed.sparkSession
    again = landed.join(small(hits.select("digest", "first")), "digest").filter((F.col("run") != F.col("first.run")) | (F.col("rid") != F.col("first.rid")))
    runs = sorted(r["run"] for r in hits.select("first.run").distinct().collect())  # one for each call with this folder that a hit leads to
    paths = [f"{folder}/landed/run-{run:09d}" for run in runs] or [f"{folder}/landed/run-*"]
    held = located(spark.read.schema(LANDED).parquet(*paths)).select("text", "locator")
    firsts = held.join(small(hits.select("locator", "digest")), "locator")
    texts = again.select("digest", "text").unionByName(firsts.select("digest", "text")).select("digest", normalised(F.col("text")).alias("norm"))
    checked = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))  # equal texts are one row before the shuffle
    return checked.filter("least <> greatest").select("digest")


def deduplicate(docs: DataFrame, keep: list[str] | None = None, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) as (row, keep_id, group_size, kept, digest).

    Texts are equal if the same after each run of white space became one space; null counts as
    empty, and texts of any length are compared whole.  The row with the smallest doc_id stays,
    rows without one coming last; of repeated rows with that doc_id exactly one stays.  An empty
    table gives an empty one.  Columns of docs may have any names.

    ``checkpoint``: a shared folder to keep landings and state in.  Rows of a later run on it are
    judged against those of all runs before: group_size counts them too, and a row is not kept if
    an earlier run has its text with a smaller doc_id.  Without it the state is dropped at the end.
    """
    columns = docs.columns if keep is None else keep
    spark = docs.sparkSession
    folder = checkpoint or f"{scratch(spark)}/exact-state-{uuid.uuid4().hex}"
    run = land(docs, columns, folder, digest)
    landed = spark.read.parquet(f"{folder}/landed/run-{run:09d}")
    n = landed.count()  # footers only
    hits = materialize(stream_state(spark, folder, files_per_batch).filter("n > 1"), "exact-hits", n)
    if not checkpoint:
        remove(spark, f"{folder}/stream")
        remove(spark, f"{folder}/changes")

    clash = materialize(clashes(landed, hits, folder), "exact-clashes", n)
    row = F.struct(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns]).alias("row")
    is_first = (F.col("first.run") == F.col("run")) & (F.col("first.rid") == F.col("rid"))
    keep_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    result = [row, keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(is_first, F.lit(True)).alias("kept"), "digest"]
    joined = landed.join(small(hits.select("digest", "first", "n")), "digest", "left")  # what is no hit stands alone
    if not clash.limit(1).count():
        discard(clash)
        return joined.select(*result)
    every = spark.read.schema(LANDED).parquet(f"{folder}/landed/run-*").join(clash, "digest", "left_semi").withColumn("norm", normalised(F.col("text")))
    groups = materialize(every.groupBy("digest", "norm").agg(F.min(identifier()).alias("first"), F.count(F.lit(1)).alias("n")), "exact-whole")
    apart = landed.join(clash, "digest", "left_semi").withColumn("norm", normalised(F.col("text"))).join(groups, ["digest", "norm"])
    return joined.join(clash, "digest", "left_anti").select(*result).unionByName(apart.select(*result))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document."""
    found = deduplicate(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("row.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH normed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
groups AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM normed GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM normed JOIN groups USING (norm)
"""
