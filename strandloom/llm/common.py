"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's setting, or a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/strandloom"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="strandloom-"))
        atexit.register(shutil.rmtree, _own_scratch[0], True)
    return f"file://{_own_scratch[0]}"


#: Folders that materialize() has written, as long as recorded() listens.
_listening: list[list[str]] = []


def note(path: str) -> str:
    """Tells those who listen of a folder in the shared folder."""
    for paths in _listening:
        paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders written to the shared folder meanwhile."""
    paths: list[str] = []
    _listening.append(paths)
    try:
        yield paths
    finally:
        _listening.remove(paths)


#: Rows of a file, where a table's size is known; and files that such a table may have in any case.
FILE_ROWS, FILES = 5_000, 6


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in no more partitions than a file for every FILE_ROWS asks for: a small table is not written as many tiny files."""
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder once and reads it back: cuts lineage, survives lost executors.

    ``rows``: about how many it has at most, so that small tables do not come in a file for every partition.
    """
    spark = df.sparkSession
    path = note(f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}")
    (df if rows is None else fewer(df, rows)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many short rows are broadcast.
BROADCAST_ROWS = 300_000


def few(table: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast where they are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _found(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    store, where = _found(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _found(spark, path)
    return store.exists(where)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/strandloom" in folder:
                remove(df.sparkSession, folder)


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select("row.*")


#: Rows and bytes of an Arrow batch where whole texts go through Python: a worker holds a batch or two at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch, for memory; they are read when a plan runs, so they stay lowered."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if not (now.lstrip("-").isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def carried(docs: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """(row, more..., text): text only where row does not have it, as ``text_of`` finds it in both."""
    bound_batches(docs.sparkSession)
    columns = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *more]
    return docs.select(*columns) if "text" in keep else docs.select(*columns, "text")


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of carried() rows, null as empty."""
    names = batch.schema.names
    column = batch.column(names.index("text")) if "text" in names else batch.column(names.index("row")).field("text")
    return column.fill_null("")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
