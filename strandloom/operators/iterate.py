"""Support for algorithms that take several rounds: tables written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Graphs of up to so many edges or states (some 100 bytes each) are walked by one task; larger ones in rounds over the cluster.
SMALL_GRAPH = 200_000

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or a temporary folder where that is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandloom-core-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


#: Tables that settled() wrote.
_written: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """df, computed once: later rounds read it instead of growing its plan."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what settled() wrote; for the end of a run, when no result reads it any more."""
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def running(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """df with ``before``: the sum of value over all rows that come before in the order, which must be total.

    Rows are sorted in range partitions; the partitions' own sums, a row for each, are added up.
    """
    dealt = settled(df.withColumn("value_", value.cast("long")).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    total, bases = 0, []
    for r in dealt.groupBy("part_").agg(F.sum("value_").alias("sum")).orderBy("part_").collect():
        bases.append((r["part_"], total))
        total += r["sum"]
    base = df.sparkSession.createDataFrame(bases, "part_ int, base_ long")
    inside = F.sum("value_").over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = dealt.withColumn("inside_", F.coalesce(inside, F.lit(0))).join(F.broadcast(base), "part_")
    return summed.withColumn("before", F.col("base_") + F.col("inside_")).drop("value_", "part_", "base_", "inside_")
