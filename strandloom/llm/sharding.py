"""Sharding by Karmarkar-Karp differencing.

Documents of equal text form a group that is not divided.  The largest differencing method
starts with one partial partition for each group (its bytes in one shard, nothing in the
others), and again and again takes the two partial partitions of the largest spread and joins
them in opposite order, the heaviest shard of one with the lightest of the other.

The groups are dealt to buckets by their digest and each bucket is differenced by a task of its
own.  The partial partitions that remain, one for each bucket, are dealt to buckets again, and so
on until one is left: a tree, of which each level is some thousands of times smaller than the
one below.  Joining is the same operation at all levels, so this is the method with another
order of joins; a bucket's spread is at most about its largest group's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

SHARDS = 8
#: A bucket has about so many groups, or so many partial partitions of the level below.
BUCKET_GROUPS = 20_000
#: Rows of a shard are numbered in so many independent runs at least.
SLICE_ROWS = 200_000


def difference(partitions: Sequence[Sequence[int]]) -> list[list[int]]:
    """Joins partial partitions by largest spread until one is left.

    partitions[i][j]: the weight of part j of partition i.  Returns for each i the shard that
    each of its parts ends in.  Ties go to the earlier partition.
    """
    if not partitions:
        return []
    shards = len(partitions[0])
    heap = []
    #: node: (weights from the heaviest part down, their places in the node's own numbering)
    order: list[list[int]] = []
    for i, weights in enumerate(partitions):
        by_weight = sorted(range(shards), key=lambda j: (-weights[j], j))
        order.append(by_weight)
        heap.append((weights[by_weight[-1]] - weights[by_weight[0]], i, tuple(weights[j] for j in by_weight)))
    heapq.heapify(heap)
    joined: list[tuple[int, int, list[int]]] = []  # (node, node, parts of the join from the heaviest down)
    n = len(partitions)
    while len(heap) > 1:
        _, a, wa = heapq.heappop(heap)
        _, b, wb = heapq.heappop(heap)
        sums = [x + y for x, y in zip(wa, reversed(wb), strict=True)]
        by_weight = sorted(range(shards), key=lambda j: (-sums[j], j))
        weights = tuple(sums[j] for j in by_weight)
        heapq.heappush(heap, (weights[-1] - weights[0], n + len(joined), weights))
        joined.append((a, b, by_weight))
    # from the last join down: the shard of each place (heaviest first) of each node
    shard_at: dict[int, list[int]] = {heap[0][1]: list(range(shards))}
    for k in range(len(joined) - 1, -1, -1):
        a, b, by_weight = joined[k]
        places = shard_at.pop(n + k)
        of_sum = [0] * shards
        for place, j in enumerate(by_weight):
            of_sum[j] = places[place]
        shard_at[a], shard_at[b] = of_sum, of_sum[::-1]
    out = []
    for i in range(n):
        of_part = [0] * shards
        for place, j in enumerate(order[i]):
            of_part[j] = shard_at[i][place]
        out.append(of_part)
    return out


def merged(sums: DataFrame, buckets: int, shards: int = SHARDS) -> DataFrame:
    """Partial partitions (bucket, part, weight; parts of no weight may be missing) with the bucket and part above: (..., upper, upper_part)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names, of = np.unique(rows["bucket"].to_numpy(np.int64), return_inverse=True)
        weights = np.zeros((len(names), shards), np.int64)
        weights[of, rows["part"].to_numpy()] = rows["weight"].to_numpy(np.int64)
        to = np.array(difference(weights.tolist()), np.int32)
        return pd.DataFrame({"bucket": rows["bucket"], "part": rows["part"], "weight": rows["weight"], "upper": rows["upper"], "upper_part": to[of, rows["part"].to_numpy()]})

    dealt = sums.withColumn("upper", F.pmod(F.xxhash64("bucket"), F.lit(buckets)))
    return dealt.groupBy("upper").applyInPandas(one, "bucket long, part int, weight long, upper long, upper_part int")


def shard(docs: DataFrame, keep: list[str] | None = None, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, ...) as (row, size, text_crc32, shard, slot); the law is bytes.

    Size: UTF-8 bytes of the text plus 1.  Null counts as the empty text, in group and CRC too.
    Repeated rows share a shard and have slots of their own.  A group as large as the rest of
    the table makes its shard larger than the others, as groups are not divided; so does one
    very long text.  Groups of equal size go by the digest of their text.  Columns of docs may
    have any names; an empty table gives an empty one.
    """
    columns = docs.columns if keep is None else keep
    text = text_or_empty()
    slices = max(1, -(-docs.count() // SLICE_ROWS))
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    groups = materialize(slim.groupBy("digest").agg(F.sum("size").alias("weight")), "sharding-groups")
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))

    def differenced(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.assign(order=bucket["digest"].map(bytes)).sort_values("order").drop(columns="order")
        weights = bucket["weight"].to_numpy(np.int64)
        parts = difference([[int(w)] + [0] * (shards - 1) for w in weights])
        part = np.array([p[0] for p in parts], np.int32)
        sums = np.bincount(part, weights.astype(np.float64), shards).astype(np.int64)
        return pd.DataFrame({"bucket": bucket["bucket"].to_numpy(), "digest": bucket["digest"].to_numpy(), "part": part, "part_weight": sums[part]})

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    parts = materialize(dealt.groupBy("bucket").applyInPandas(differenced, "bucket long, digest binary, part int, part_weight long"), "sharding-parts")
    where = parts.select("digest", "bucket", "part")
    sums = parts.groupBy("bucket", "part").agg(F.max("part_weight").alias("weight"))
    while buckets > 1:
        buckets = -(-buckets // BUCKET_GROUPS)
        joined = materialize(merged(sums, buckets, shards), "sharding-level")
        moves = joined.select(F.col("bucket").alias("b"), F.col("part").alias("p"), "upper", "upper_part")
        where = where.join(moves, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))).select("digest", F.col("upper").alias("bucket"), F.col("upper_part").alias("part"))
        sums = joined.groupBy(F.col("upper").alias("bucket"), F.col("upper_part").alias("part")).agg(F.sum("weight").alias("weight"))
    where = where.select("digest", F.col("part").alias("shard"))

    placed = slim.join(where, "digest").withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("shard").alias("at_shard"), F.col("slice").alias("at_slice"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    run = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32"))
    slot = placed.withColumn("run", run).join(starts, (F.col("shard") == F.col("at_shard")) & (F.col("slice") == F.col("at_slice")))
    return slot.select("row", "size", "text_crc32", "shard", (F.col("start") + F.col("run") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    found = shard(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
