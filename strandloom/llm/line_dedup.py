"""Reversible line deduplication: cuckoo filters over exact reference counts.

The log has one row for each line key and document that holds it, with a count of references.
Insertions add rows, deletions add rows with a negative count for what is still there, so the
log is append-only and its sums are the references that are left, whatever was inserted and
deleted before.  Beside it stand its sums by hash of the key, to which a change adds its own.

Most keys stand in one document only.  Keys with enough references to matter are kept, by
their hashes, in cuckoo filters, one for each shard of the key space.  A change's own sums tell
which hashes cross the threshold; they are inserted into the filters of their shards, or
deleted there, and nothing else is touched.  The log is dealt to the shards and probed there,
each row beside its own shard's filter; what passes, and nothing else, goes on to the exact
reference-count table, which has the full keys and decides.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few, materialize, text_or_empty

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
#: A shard has about so many keys in its filter; of its rows in the log, so many are probed by one task.
SHARD_KEYS, PROBE_ROWS = 20_000, 50_000


FILTER_ROW = "shard long, keys long, filter binary"


class CuckooFilter:
    """A set of 64-bit keys with insertion and deletion: 16-bit fingerprints, four to a bucket.

    A key may stand in either of two buckets, each found from the other and the fingerprint.
    A contained key is always found; another key is found with probability 2 ** -13 or so.
    Insert a key once only, and delete only what was inserted.
    """

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.85))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            return x ^ (x >> np.uint64(29))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = self._mixed(np.asarray(keys, np.int64).view(np.uint64))
        mark = (mixed >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)  # 0 is an empty slot
        first = (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        jump = self._mixed(np.asarray(mark, np.uint64)) & np.uint64(len(self.table) - 1)
        return np.asarray(place, np.int64) ^ jump.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(1)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def insert(self, keys: np.ndarray) -> bool:
        """False: too full; the filter has then lost a key and is of no more use."""
        return all(self._put(mark, places) for mark, *places in zip(*self._places(keys), strict=True))

    def _put(self, mark: np.uint16, places: list[int]) -> bool:
        at = places[0]
        for step in range(500):
            for place in places if step == 0 else [at]:
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    return True
            slot = (int(mark) + step) % self.SLOTS  # turn one out, it moves to its other bucket
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int(self._other(np.array([at]), np.array([mark]))[0])
        return False

    def delete(self, keys: np.ndarray) -> None:
        for mark, *places in zip(*self._places(keys), strict=True):
            for place in places:
                held = np.flatnonzero(self.table[place] == mark)
                if len(held):
                    self.table[place, held[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(8, len(keys))
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity *= 2


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), ascii_uppercase, ascii_lowercase)


def digest(line: Column, min_length: int = MIN_LENGTH) -> Column:
    """128 bits of the line's key, or null where the key is too short."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_length, F.unhex(F.md5(key.cast("binary"))))


class LineIndex:
    """Exact reference counts of line keys, in tables of the shared folder that changes add to.

    log: (key, doc_id, of, refs), what each change gave or took: ``of`` is a hash of the text that a
    line was given with.  Nothing is taken that is not there, so its sums are what is left.
    counts: (short, refs), the same by hashes of keys; delta: the last change's part of it.

    A document is a doc_id: rows that repeat one, and all rows without one, are one document.
    """

    def __init__(self, log: DataFrame, counts: DataFrame | None = None, delta: DataFrame | None = None) -> None:
        self.log, self.counts, self.delta = log, self._by_hash(log) if counts is None else counts, delta

    @staticmethod
    def _by_hash(log: DataFrame) -> DataFrame:
        return log.groupBy(F.xxhash64("key").alias("short")).agg(F.sum("refs").alias("refs"))

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        """One reference of each row to each distinct key, however often the text repeats the line."""
        keys = F.array_distinct(F.filter(F.transform(split_lines(text_or_empty()), lambda x: digest(x)), lambda d: d.isNotNull()))
        return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("of"), F.explode(keys).alias("key")).select("key", "doc_id", "of", F.lit(1).cast("long").alias("refs"))

    @classmethod
    def of(cls, docs: DataFrame, counted: bool = False) -> LineIndex:
        """``counted``: for an index that is to be changed, the counts are written too."""
        log = materialize(cls._rows(docs), "line-log")
        return cls(log, materialize(cls._by_hash(log), "line-counts") if counted else None)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(self._rows(docs))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes documents out again: docs with the texts that they were inserted with.

        References that are not there, as of documents that never came or have gone before, are passed over.
        """
        asked = self._rows(docs).groupBy("key", "doc_id").agg(F.sum("refs").alias("wanted"))
        asked = materialize(asked, "line-deletions")
        known = asked.select(F.col("key").alias("key_"), F.col("doc_id").alias("doc_"))
        same = (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("doc_"))
        there = self.log.join(known, same, "left_semi").groupBy(F.col("key").alias("key_"), F.col("doc_id").alias("doc_")).agg(F.sum("refs").alias("there"))
        goes = asked.join(there, same).withColumn("refs", -F.least("wanted", "there")).filter("refs < 0")
        return self._changed(goes.select("key", "doc_id", F.lit(0).cast("long").alias("of"), "refs"))

    def _changed(self, rows: DataFrame) -> LineIndex:
        more = materialize(rows, "line-log")
        delta = materialize(self._by_hash(more), "line-counts")
        return LineIndex(self.log.unionByName(more), self.counts.unionByName(delta), delta)

    def compacted(self) -> LineIndex:
        """The same in one table each, after many changes."""
        log = self.log.groupBy("key", "doc_id", "of").agg(F.sum("refs").alias("refs")).filter("refs <> 0")
        counts = self.counts.groupBy("short").agg(F.sum("refs").alias("refs")).filter("refs > 0")
        return LineIndex(materialize(log, "line-log"), materialize(counts, "line-counts"))

    def repeated(self, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
        """(short): hashes of keys with so many references or more, among them all keys in so many documents."""
        return self.counts.groupBy("short").agg(F.sum("refs").alias("refs")).filter(F.col("refs") >= min_documents).select("short")

    def crossed(self, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
        """(short, enters): hashes that the last change made repeated, or no longer repeated; the log is not read for it."""
        last = self.delta.select("short", F.col("refs").alias("by"))
        now = self.counts.join(last.select("short"), "short", "left_semi").groupBy("short").agg(F.sum("refs").alias("now"))
        both = last.join(now, "short").select("short", (F.col("now") >= min_documents).alias("enters"), (F.col("now") - F.col("by") >= min_documents).alias("was"))
        return both.filter("enters <> was").select("short", "enters")

    def frequent(self, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
        """The exact table: (key, documents, last): keys in so many documents, and the largest doc_id that holds them."""
        held = self.log.groupBy("key", "doc_id").agg(F.sum("refs").alias("refs")).filter("refs > 0")
        counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("last"))
        return counted.filter(F.col("documents") >= min_documents)


class Filters:
    """Cuckoo filters over hashes of keys: a table (shard, keys, filter) and the number of shards."""

    def __init__(self, table: DataFrame, shards: int) -> None:
        self.table, self.shards = table, shards

    def _sharded(self, shorts: DataFrame, *more: str) -> DataFrame:
        return shorts.select(F.pmod("short", F.lit(self.shards)).alias("shard"), "short", *more)

    @staticmethod
    def _built(sharded: DataFrame) -> DataFrame:
        def built(part: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.of(part["short"].to_numpy(np.int64))
            return pd.DataFrame({"shard": part["shard"].iloc[:1], "keys": [len(part)], "filter": [made.table.tobytes()]})

        return sharded.groupBy("shard").applyInPandas(built, FILTER_ROW)

    @classmethod
    def of(cls, shorts: DataFrame) -> Filters:
        """From distinct hashes (short)."""
        new = cls(shorts, max(1, -(-shorts.count() // SHARD_KEYS)))
        new.table = materialize(cls._built(new._sharded(shorts)), "line-filters", new.shards)
        return new

    def refresh(self, index: LineIndex, min_documents: int = MIN_DOCUMENTS) -> Filters:
        """After a change of the index: hashes that came to be repeated are inserted, those that no longer are get deleted.

        Only shards with such hashes are touched.  One that gets too full is built anew, from the counts.
        """
        changes = materialize(self._sharded(index.crossed(min_documents), "enters"), "line-crossed")
        touched = changes.select("shard").distinct()

        def changed(shard: tuple, held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            enters = changes["enters"].to_numpy(bool)
            goes, comes = (changes["short"].to_numpy(np.int64)[x] for x in (~enters, enters))
            one = CuckooFilter.load(held["filter"].iloc[0]) if len(held) else CuckooFilter(len(comes) + 8)
            one.delete(goes)
            keys = int(held["keys"].sum()) - len(goes) + len(comes)
            if not one.insert(comes):
                return pd.DataFrame({"shard": [shard[0]], "keys": [-1], "filter": [b""]})
            return pd.DataFrame({"shard": [shard[0]], "keys": [keys], "filter": [one.table.tobytes()]})

        held = self.table.join(touched, "shard", "left_semi").groupBy("shard")
        made = materialize(held.cogroup(changes.groupBy("shard")).applyInPandas(changed, FILTER_ROW), "line-filters", self.shards)
        full = made.filter("keys < 0").select("shard")
        if full.limit(1).count():
            again = self._built(self._sharded(index.repeated(min_documents)).join(full, "shard", "left_semi"))
            made = made.filter("keys >= 0").unionByName(materialize(again, "line-filters", self.shards))
        return Filters(self.table.join(touched, "shard", "left_anti").unionByName(made), self.shards)

    def candidates(self, log: DataFrame) -> DataFrame:
        """The rows of a log whose key is in the filters: all that are, and one in some thousands of the others.

        Rows go to their shard, those of a large shard (one key may hold a third of all rows) to several
        copies of its filter, dealt by document.
        """
        sharded = log.withColumn("short", F.xxhash64("key")).withColumn("shard", F.pmod("short", F.lit(self.shards)))
        sizes = sharded.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBE_ROWS).alias("copies"))
        large = few(materialize(sizes.filter("copies > 1"), "line-shards", self.shards))
        copies = F.coalesce("copies", F.lit(1))
        rows = sharded.join(large, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id", "key"), copies)).drop("copies")
        filters = self.table.join(large, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies", "keys")
        columns = log.columns

        def probed(lines: pa.Table, held: pa.Table) -> pa.Table:
            found = pa.array([], pa.bool_()) if not len(lines) else pa.array(np.zeros(len(lines), bool))
            if len(lines) and len(held):
                found = pa.array(CuckooFilter.load(held["filter"][0].as_py()).contains(lines["short"].to_numpy()))
            return lines.filter(found).select(columns)

        by = ["shard", "copy"]
        return rows.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(probed, log.schema)


def deduplicate(docs: DataFrame, keep: list[str] | None = None, min_documents: int = MIN_DOCUMENTS, index: LineIndex | None = None, filters: Filters | None = None) -> DataFrame:
    """docs (doc_id, text, ...) as (row, n_lines, n_dropped, kept_text).

    Lines whose key (at least MIN_LENGTH code points) is in min_documents documents or more go,
    except in the largest doc_id that holds it, where all of them stay.  ``index``: the
    references to judge by, by default those of docs; documents that are not in it lose all lines
    that are frequent in it.  ``filters``: over the index's repeated keys, by default built anew.
    Null and empty texts are one empty line; texts of any length are read whole.  Rows without
    doc_id are one document, smaller than every other.  Columns of docs may have any names; an
    empty table gives an empty one.
    """
    columns = docs.columns if keep is None else keep
    own = index is None
    new = LineIndex.of(docs)
    index = new if own else index
    n = new.log.count()  # of a written table: footers only
    filters = filters or Filters.of(materialize(index.repeated(min_documents), "line-repeated", index.log.count() // min_documents))
    asked = materialize(filters.candidates(new.log), "line-candidates", n)
    judging = asked if own else index.log.join(asked.select("key").distinct(), "key", "left_semi")
    exact = materialize(LineIndex(judging).frequent(min_documents).select("key", "last"), "line-frequent", n // min_documents)
    goes = asked.join(exact, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = goes.groupBy(F.col("doc_id").alias("of_doc"), F.col("of").alias("of_text")).agg(F.collect_set("key").alias("drops"))  # at most a text's own lines

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("of"))
    judged = held.join(drops, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("of") == F.col("of_text")), "left")
    lines = split_lines(F.col("text"))
    left = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains("drops", digest(x)), F.lit(False))))
    out = judged.select("row", "text", F.size(lines).cast("long").alias("n_lines"), left.alias("left"))
    return out.select("row", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept_text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    found = deduplicate(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= {MIN_LENGTH}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
judged AS (
  SELECT lines.*, coalesce(last <> doc_id, false) AS goes FROM lines LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
