"""Audit of filters applied one after the other, in every order.

What a document fails is a mask of bits; a part of the corpus is known by its cells, the counts
of documents by mask, so the work over documents is one pass and one grouping, whatever the
number of orders.  The orders are visited by exchanging two neighbours at a time.  Such a swap
changes what is removed at these two steps only, as the filters before each other step stay the
same set, so only these are summed anew from the cells.  A filter's removals over all orders,
its Shapley value but for a factor, are added up along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

#: Filters by letter; a filter's bit in a mask is its place here.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 200, 50, 2, "#$%&*|"
#: Parts whose rows are made at once: each has a row for every order and step.
PART_ROWS = 64
COUNTS = ("documents", "good", "toxic")


def own_failures(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with own: a mask of the filters that a text fails for what it is."""
    bare = F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    split = docs.withColumn("bare", bare).withColumn("words", F.split("bare", r"[\x20\x09-\x0D]+"))  # of an empty text one empty word
    words = F.when(F.col("bare") == "", 0).otherwise(F.size("words"))
    fails = {
        "A": words < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < DISTINCT_SHARE * words,
        "C": 100 * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")) > CAPITAL_SHARE * F.char_length("text"),
        "D": F.col("text").rlike(f"[{MARKS}]"),
    }
    own = sum((F.when(x, 1 << FILTERS.index(name)).otherwise(0) for name, x in fails.items()), F.lit(0))
    return split.withColumn("own", own).drop("bare", "words")


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document.

    A copy is a text that a smaller doc_id has.  Texts meet by their SHA-256; what travels is the
    digest, never the text.  Only digests that repeat are joined back, and of labels only those
    of good or toxic documents, so that copies, however many, are rows of a join that can be split.
    """
    plain = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text"))
    slim = own_failures(plain).select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "own")
    slim = materialize(slim, "audit-masks")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    first = materialize(first, "audit-copies")  # a table of its own, so that the join has both sides to deal out, and can split a text of many copies
    quality = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    quality = quality.filter("doc_id is not null and (good = 1 or toxic = 1)")
    flagged = slim.join(first, "digest", "left").join(quality, "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return flagged.select("part", (F.col("own") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(flagged: DataFrame) -> DataFrame:
    """(part, cells): for each part the masks that occur, at most 2 ** filters, with their counts."""
    counted = flagged.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("documents"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """The places i whose exchange with i + 1, one after the other, leads through all orders of n things.

    The largest thing goes from one end to the other between two orders of the rest, there and back.
    """
    if n > 1:
        there, back = list(range(n - 2, -1, -1)), list(range(n - 1))
        turned = False
        yield from there
        for i in swaps(n - 1):
            turned = not turned
            yield i + turned  # the largest thing stands in front of the rest after each way there
            yield from back if turned else there


class Walk:
    """Orders of filters over the cells of some parts: an array (parts, masks, counts)."""

    def __init__(self, table: np.ndarray, filters: str = FILTERS) -> None:
        self.table, self.filters = table, filters
        self.masks = np.arange(1 << len(filters))
        self.order = list(range(len(filters)))
        self.removed = [self.step(s) for s in range(len(filters))]

    def step(self, s: int) -> np.ndarray:
        """(parts, counts) removed at a step: cells that fail its filter and none before it."""
        earlier = sum(1 << f for f in self.order[:s])
        here = (self.masks & earlier == 0) & (self.masks >> self.order[s] & 1 == 1)
        return self.table[:, here].sum(1)

    def __iter__(self) -> Iterator[tuple[str, list[int], list[np.ndarray]]]:
        """(letters, order, removed by step) of every order."""
        yield "".join(self.filters[f] for f in self.order), list(self.order), list(self.removed)
        for i in swaps(len(self.filters)):
            self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
            self.removed[i], self.removed[i + 1] = self.step(i), self.step(i + 1)
            yield "".join(self.filters[f] for f in self.order), list(self.order), list(self.removed)


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(table: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Letters of every order, the steps' filters (orders, steps) and numbers (parts, orders, steps, NUMBERS) of cells (parts, masks, counts)."""
    masks, n = np.arange(1 << len(filters)), len(filters)
    failing = np.stack([table[:, masks >> f & 1 == 1, 0].sum(1) for f in range(n)], 1)
    alone = np.stack([table[:, 1 << f, 0] for f in range(n)], 1)
    total, shapley = table[:, :, 0].sum(1), np.zeros((len(table), n), np.int64)
    letters, orders, rows = [], [], []
    for name, order, removed in Walk(table, filters):
        at = np.stack(removed, 1)  # (parts, steps, counts)
        shapley[:, order] += at[:, :, 0]
        letters.append(name)
        orders.append(order)
        rows.append(np.stack([total[:, None] - at[:, :, 0].cumsum(1), at[:, :, 0], failing[:, order] - at[:, :, 0], alone[:, order], at[:, :, 1], at[:, :, 2]], 2))
    numbers = np.stack(rows, 1)
    return letters, np.array(orders), np.concatenate([numbers, shapley[:, np.array(orders)][..., None]], 3)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) and labels (doc_id, quality, toxic) as (part, filter_order, step, NUMBERS...).

    A row for every part (a source; null is the empty one), order of FILTERS and step from 1 on,
    zeros included.  Null and empty texts have no words, fail A and D no, and are copies of one
    another; texts of any length count whole.  Of texts that are alike the rows with the smallest
    doc_id are no copies, nor are rows without doc_id, which precede nothing.  Repeated rows
    count one by one.  A document is good or toxic if any of its labels says so.  Columns of docs
    may have any names; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, PART_ROWS) for i in range(0, len(whole), PART_ROWS)):
                table = np.zeros((len(batch), 1 << len(FILTERS), len(COUNTS)), np.int64)
                for k, found in enumerate(batch.column("cells").to_pylist()):
                    for cell in found:
                        table[k, cell["mask"]] = [cell[c] for c in COUNTS]
                letters, orders, numbers = audited(table)
                steps = orders.shape[1]
                each = len(letters) * steps
                columns = [batch.column("part").take(pa.array(np.repeat(np.arange(len(batch)), each)))]
                columns.append(pa.array(np.tile(np.repeat(letters, steps), len(batch))))
                columns.append(pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(batch) * len(letters))))
                columns += [pa.array(np.ascontiguousarray(numbers[..., i]).ravel()) for i in range(len(NUMBERS))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *NUMBERS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in NUMBERS)
    return cells(masked(docs, labels)).mapInArrow(rows, schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ORDERS = ", ".join(f"letter l{i}" for i in range(1, 6))
_DIFFERENT = " AND ".join(f"l{i}.x <> l{j}.x" for i in range(1, 6) for j in range(i + 1, 6))

OP13_SQL = f"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
mask AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_SHARE} * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {CAPITAL_SHARE} * length(t))::INT + 8 * regexp_matches(t, '[{MARKS}]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM doc LEFT JOIN labelled USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM mask GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] AS bits FROM {_ORDERS} WHERE {_DIFFERENT}),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS earlier FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM cell, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
