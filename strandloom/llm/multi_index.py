"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by a small codebook of its own; the
pairs of centroids are the cells of the index, which thus has the square of the codebook's
size.  A query scores the centroids of both halves, walks the pairs from the best summed score
down with a heap, until the cells walked hold enough entries, and reranks these exactly.  How
many are enough is learned from the vectors: of queries drawn from the sample the true neighbours
are looked up, and the share of entries is taken within which the walk meets as many of them as
wanted.  Vectors in clusters need a small share, shapeless ones a large one.

The codebooks are fitted to a bounded sample; every vector is indexed.  Entries are dealt to
chunks of bounded size by their first centroid: small neighbours share one, large ones are
cut, so that a vector that occurs a million times is shared out to many tasks.  A query visits
the chunks that hold a cell it walked, and only the best of each chunk travel on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

NEIGHBOURS = 20
#: The codebooks are fitted to about so many vectors, those with the smallest hashes of vec_id.
TRAIN_VECTORS = 20_000
#: Centroids of each half, at most.
CENTROIDS = 256
#: The share of true neighbours that the walk is to meet, and how many queries of the sample tell how far it goes for that: a quarter
#: of the sample at most, to which the codebooks are not fitted.
RECALL, TRIAL_QUERIES = 0.95, 256
#: Vectors of a chunk, and queries that meet them in one task.
CHUNK, QUERY_PART = 8_192, 16_384


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """k-means with a fixed seed; empty clusters are seeded anew."""
    rng = np.random.default_rng(seed)
    k = min(k, len(vectors))
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(vectors, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], vectors[rng.integers(0, len(vectors), k)])
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * vectors @ centres.T).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Walks pairs of centroids by descending first[i] + second[j], until their cells hold ``wanted`` entries.

    Returns for each i how many of its pairs were walked; these are the best by second[j].
    The heap merges one list of pairs for each i; a list enters when the one before it has
    given its first pair.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    up, down, held = first[a].tolist(), second[b].tolist(), sizes[a][:, b].tolist()
    heap, walked, total = [(-(up[0] + down[0]), 0)], [0] * len(a), 0
    while heap and total < wanted:
        i = heap[0][1]
        j = walked[i]
        total += held[i][j]
        walked[i] = j = j + 1
        if j < len(down):
            heapq.heapreplace(heap, (-(up[i] + down[j]), i))
        else:
            heapq.heappop(heap)
        if j == 1 and i + 1 < len(up):
            heapq.heappush(heap, (-(up[i + 1] + down[0]), i + 1))
    out = np.zeros(len(a), np.int32)
    out[a] = walked
    return out


def trials_of(n: int, trials: int = TRIAL_QUERIES) -> np.ndarray:
    """Places of the trial queries in a sample of n."""
    return np.sort(np.random.default_rng(41).permutation(n)[: min(trials, n // 4)])


def share_for(recall: float, sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, trials: np.ndarray | None = None) -> float:
    """The share of entries that walks of the trial queries have to reach for so much recall of the k nearest, measured within the sample.

    The neighbours of a query in the whole table are nearer than those in a sample, and are met
    sooner, so a larger table does no worse with this share.
    """
    half = books[0].shape[1]
    cell = nearest(sample[:, :half], books[0]) * len(books[1]) + nearest(sample[:, half:], books[1])
    sizes = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    needed = []
    for i in trials_of(len(sample)) if trials is None else trials:
        q = sample[i]
        score = sample @ q
        score[i] = -np.inf
        true = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        order = np.argsort(-(books[0] @ q[:half])[:, None] - (books[1] @ q[half:])[None, :], axis=None, kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(sizes[order])  # entries met when a cell is done
        needed.append(before[cell[true]])
    found = np.concatenate(needed) if needed else np.zeros(0)
    return float(np.quantile(found, recall, method="higher")) / len(sample) if len(found) else 1.0


def chunks_of(sizes: np.ndarray, most: int = CHUNK) -> tuple[list[int], list[int]]:
    """For each first centroid its first chunk and their number: small ones share a chunk, large ones get several."""
    begin, number, chunk, held = [], [], -1, most
    for n in sizes.tolist():
        if n > most:
            begin.append(chunk + 1)
            number.append(-(-n // most))
            chunk, held = chunk + number[-1], most
        else:
            if held + n > most:
                chunk, held = chunk + 1, 0
            begin.append(chunk)
            number.append(1)
            held += n
    return begin, number


def salted(begin: list[int], number: list[int], group: str, *key: str) -> Column:
    """The chunk of a row, by its group and a hash of key within the group's chunks."""
    first, count = (F.get(F.array(*[F.lit(x) for x in xs]), group) for xs in (begin, number))
    return first + F.pmod(F.xxhash64(*key), count).cast("int")


def best(query: np.ndarray, entries: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best entries other than the query's own, ties to the smaller id."""
    rough = entries @ query
    other = ids != own
    if other.sum() > k:  # summed in one and the same order below, so that equal vectors tie
        least = np.partition(rough[other], -k)[-k]
        other &= rough >= least - 1e-9 * max(1.0, abs(least))
    at = np.flatnonzero(other)
    score = (entries[at] * query).sum(1)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, recall: float = RECALL, walked_share: float | None = None) -> DataFrame:
    """vectors (vec_id, embedding) and queries (vec_id, embedding) as (query_id, rank, vec_id, score).

    A query walks until it has met the share of all entries that ``recall`` asks for, or ``walked_share`` if that is given.

    Nearness is the inner product in double precision.  Rows without vec_id and vectors that
    are null, zero or not finite take no part, nor do those of another length than most.  A row
    with the query's own vec_id is no neighbour of it; other repeated rows each are.  Of equal
    scores the smaller vec_id comes first.  Only vec_id and embedding are read, so other columns
    may have any names.  Of no vectors there is no result.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    entries, asked = clean(vectors), clean(queries)
    widths = entries.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width, total = widths[0]
    entries, asked = entries.filter(F.size("v") == width), asked.filter(F.size("v") == width)

    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30) < TRAIN_VECTORS / total
    sample = np.array([r["v"] for r in (entries.filter(drawn) if total > TRAIN_VECTORS else entries).select("v").collect()]).reshape(-1, width)
    half = (width + 1) // 2
    trials = trials_of(len(sample))
    fitted = np.delete(sample, trials, axis=0)
    books = codebook(fitted[:, :half], CENTROIDS), codebook(fitted[:, half:], CENTROIDS) if width > 1 else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(books)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                yield batch.assign(first=nearest(v[:, :half], shared.value[0]), second=nearest(v[:, half:], shared.value[1]))

    index = materialize(entries.mapInPandas(assigned, "vec_id long, v array<double>, first int, second int"), "multi-index")
    sizes = np.zeros([len(b) for b in books], np.int64)  # CENTROIDS squared at most
    for r in index.groupBy("first", "second").count().collect():
        sizes[r["first"], r["second"]] = r["count"]
    begin, number = chunks_of(sizes.sum(1))
    share = walked_share if walked_share is not None else share_for(recall, sample, books, k, trials)
    wanted = max(k + 1, int(np.ceil(share * total)))
    plan = spark.sparkContext.broadcast(sizes)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, q in zip(batch["vec_id"], batch["v"], strict=True):
                taken = walk(shared.value[0] @ q[:half], shared.value[1] @ q[half:], plan.value, wanted)
                visits = {c for i in np.flatnonzero(taken).tolist() for c in range(begin[i], begin[i] + number[i])}
                home = int((shared.value[0] @ q[:half]).argmax())
                rows.append((own, q, home, taken.astype("<u2").tobytes(), sorted(visits)))
            yield pd.DataFrame(rows, columns=["query_id", "q", "home", "taken", "visits"])

    asks = materialize(asked.mapInPandas(probes, "query_id long, q array<double>, home int, taken binary, visits array<int>"), "multi-queries")
    homes = np.zeros(len(books[0]), np.int64)  # CENTROIDS at most
    for r in asks.groupBy("home").count().collect():
        homes[r["home"]] = r["count"]
    # queries of one home visit much the same chunks, so they share parts, and a chunk is sent to the parts alone that visit it
    asks = asks.withColumn("part", salted(*chunks_of(homes, QUERY_PART), "home", "query_id")).withColumn("chunk", F.explode("visits"))
    held = index.withColumn("row", F.monotonically_increasing_id()).withColumn("chunk", salted(begin, number, "first", "vec_id", "row")).drop("row")
    visited = asks.select(F.col("chunk").alias("visited"), F.col("part").alias("visitor")).distinct()
    held = held.join(visited, F.col("chunk") == F.col("visited")).drop("visited").withColumnRenamed("visitor", "part")

    def ranked(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(block) and len(asking):
            v, ids = np.stack(block["v"].to_numpy()), block["vec_id"].to_numpy()
            first, second = block["first"].to_numpy(), block["second"].to_numpy()
            place = np.zeros(len(shared.value[1]), np.int32)
            for own, q, taken in zip(asking["query_id"], asking["q"], asking["taken"], strict=True):
                place[np.argsort(-(shared.value[1] @ q[half:]), kind="stable")] = np.arange(len(place))
                at = np.flatnonzero(place[second] < np.frombuffer(taken, "<u2")[first])
                found, score = best(q, v[at], ids[at], own, k)
                out.append((np.full(len(found), own), found, score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = ["chunk", "part"]
    found = held.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(ranked, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 nearest found of every row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
