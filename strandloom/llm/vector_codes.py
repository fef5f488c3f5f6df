"""Codes of vectors: each of eight parts by the nearest of sixteen entries of its own codebook.

Vectors become integers, which makes every sum exact in whatever order it is taken.  They are
written once as blocks of some thousand vectors, each part a NumPy array with a row for each
of its dimensions.  A round of k-means is one RDD.treeAggregate over these blocks: distances to
the entries accumulate dimension by dimension over a whole column, np.add.at puts the columns
into int64 tensors of sums and counts, and these, of the codebooks' size whatever the table's,
merge through a reduction tree.  The last assignment reads the same blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import few, materialize

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components are multiplied by this and rounded down.
SCALE = 4096
#: Integers up to so much: squared distances and sums over a table stay far inside 64 bits.
LARGEST = 1 << 26
#: Bytes of a block's vectors, and levels of the reduction tree.
BLOCK_BYTES, DEPTH = 1 << 20, 3


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def scaled(vector: Column) -> Column:
    """Components as integers; one beyond LARGEST is an error."""
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    said = F.concat(F.lit("a component is too large for codes: "), F.format_string("%s", F.array_max(F.transform(vector, F.abs)).cast("string")))
    return F.when(F.forall(vector, lambda x: F.abs(x.cast("double") * SCALE) <= LARGEST), F.transform(vector, lambda x: whole(x).cast("int"))).otherwise(F.raise_error(said).cast("array<int>"))


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, the first of equals: columns (dimensions, n), book (entries, dimensions)."""
    distance = np.zeros((columns.shape[1], len(book)), np.int64)
    for column, entry in zip(columns, book.T, strict=True):
        away = column.astype(np.int64)[:, None] - entry[None, :]
        away *= away
        distance += away
    code = distance.argmin(1)
    return code, distance[np.arange(len(code)), code]


def parts_of(data: bytes, n: int, parts: int) -> np.ndarray:
    """A block as (parts, dimensions of a part, n)."""
    return np.frombuffer(data, "<i4").reshape(parts, -1, n)


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """vectors (row, v) as (n, data, rows), written to the shared folder: data is the block by columns."""
    most = max(1, BLOCK_BYTES // (4 * width))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, len(whole), most)):
                lists = batch.column("v")
                data = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, width).T.tobytes()
                rows = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("row"))
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([data], pa.binary()), rows], ["n", "data", "rows"])

    schema = StructType().add("n", "long").add("data", "binary").add("rows", ArrayType(vectors.schema["row"].dataType))
    return materialize(vectors.mapInArrow(cut, schema), "vector-blocks")


def first_book(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, dimensions): the vectors with the smallest vec_ids; rows without one come last, rows alike in it by their components."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    whole = np.array([r["v"] for r in first], np.int64)
    return whole.reshape(len(whole), parts, -1).transpose(1, 0, 2)


def improved(made: DataFrame, book: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The codebooks after a round: every entry the mean of the parts next to it, rounded down; one that has none stays."""
    spark = made.sparkSession
    shared = spark.sparkContext.broadcast(book)
    zero = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)

    def add(total: tuple[np.ndarray, np.ndarray], block: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = total
        for part, columns in enumerate(parts_of(bytes(block[1]), block[0], len(sums))):
            code, _ = nearest(columns, shared.value[part])
            np.add.at(counts[part], code, 1)
            for dimension, column in enumerate(columns):
                np.add.at(sums[part, :, dimension], code, column)
        return sums, counts

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    sums, counts = made.select("n", "data").rdd.treeAggregate(zero, add, merge, depth)
    shared.destroy()
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)


def written(book: np.ndarray) -> str:
    """All components in decimal, by part, entry and position."""
    return ",".join(map(str, book.ravel().tolist()))


def compress(vectors: DataFrame, keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, embedding, ...) as (row, code, error), and the codebooks (parts, entries, dimensions).

    code: the index of the nearest entry of each part, in bytes; error: the squared distances,
    summed.  Vectors that are null or empty or have null or non-finite components are left out.
    All others must have one length, a multiple of ``parts``, and components within LARGEST /
    SCALE; anything else is an error, as no code could stand for it.  Rows that repeat are coded
    one by one, rows without vec_id too; with fewer vectors than entries the codebooks are
    smaller.  Columns of vectors may have any names; of an empty table there are no codes, and
    codebooks without entries.
    """
    columns = vectors.columns if keep is None else keep
    good = vectors.filter(usable(F.col("embedding")))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    ready = good.select(row, "vec_id", scaled(F.col("embedding")).alias("v"))
    widths = good.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if widths["least"] is None:
        return ready.select("row", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    if widths["least"] != widths["most"] or widths["least"] % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; there are some of {widths['least']} and {widths['most']} components")

    book = first_book(ready, parts, entries)
    made = blocks(ready.select("row", "v"), widths["least"])
    for _ in range(rounds):
        book = improved(made, book)
    last = book

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data, rows in zip(batch.column("n").to_pylist(), batch.column("data"), batch.column("rows"), strict=True):
                found = [nearest(columns_, last[part]) for part, columns_ in enumerate(parts_of(data.as_buffer(), n, len(last)))]
                codes = np.stack([code for code, _ in found], 1).astype(np.uint8)
                error = sum(distance for _, distance in found)
                yield pa.RecordBatch.from_arrays([rows.values, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(error)], ["row", "code", "error"])

    return made.mapInArrow(coded, ready.select("row").schema.add("code", "binary").add("error", "long")), book


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that has a code."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes, book = compress(vectors, keep=["vec_id", "label"])
    found = materialize(codes.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error"), "vector-codes")
    by_label = few(materialize(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels"))
    digest = hashlib.sha256(written(book).encode()).hexdigest()
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_DIMENSIONS = "(SELECT max(len(v)) // 8 FROM kept)"
_ROUND = """
a{i} AS (
  SELECT vec_id, label, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.label, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM point p JOIN b{i} b ON b.part = p.part)
  GROUP BY vec_id, label, part)"""
_NEXT = """
b{j} AS (
  SELECT part, entry, coalesce(n.x, b{i}.x) AS x FROM b{i} LEFT JOIN (
    SELECT part, entry, list(x ORDER BY place) AS x FROM (
      SELECT part, entry, place, floor(sum(x) / count(*))::BIGINT AS x
      FROM (SELECT a.part, a.entry, unnest(p.x) AS x, unnest(range(1, len(p.x) + 1)) AS place FROM a{i} a JOIN point p USING (vec_id, part)) GROUP BY part, entry, place)
    GROUP BY part, entry) n USING (part, entry))"""

OP12_SQL = (
    f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
point AS (
  SELECT vec_id, label, part, v[part * {_DIMENSIONS} + 1 : (part + 1) * {_DIMENSIONS}] AS x FROM kept, range({PARTS}) r(part)),
b0 AS (
  SELECT part, entry, x FROM point JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),"""
    + ",".join(_ROUND.format(i=i) + "," + _NEXT.format(i=i, j=i + 1) for i in range(ROUNDS))
    + ","
    + _ROUND.format(i=ROUNDS)
    + f""",
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM coded
"""
)
