"""Shared intermediate tables and skew-free numbering, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's `spark.checkpoint.dir`.

    A local session without that setting gets a folder of its own, as in tests; on a cluster the
    missing setting is an error, since a machine's own folder is unreadable to the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and the executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Rows of text that a Python worker gets at once. Spark's own 10,000 rows of whole texts take some 200 MB of a worker.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to `TEXT_ROWS`, unless the session has a setting of its own below that."""
    rows = int(spark.conf.get(_BATCH))
    if rows <= 0 or rows > TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder, removed when the session's file system closes."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settled(frame: DataFrame) -> DataFrame:
    """The frame written once as parquet below the shared folder, for results read several times.

    Unlike a checkpoint, the copy is columnar: later reads take only their columns and the planner
    knows its size. It goes when the session ends.
    """
    folder = new_folder(frame.sparkSession, "settled")
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def number_rows(
    frame: DataFrame, group: list[str], order: list[str], bucket: Column, out: str = "row_no"
) -> DataFrame:
    """1-based row number inside each group, without putting a whole group into one task.

    `bucket` must never decrease along `order` inside a group. Rows are numbered inside
    (group, bucket); the offset of a bucket is the running count of the buckets before it, taken
    over the small table of bucket counts.
    """
    tagged = frame.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        tagged.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_inside", "_offset")
    )


def number_sorted(frame: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based position of each row in the global order.

    Rows are range-partitioned and written once, so that a row's partition is the same when the
    partitions are counted and when their rows are numbered.
    """
    ranged = settled(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return number_rows(ranged, [], order, F.col("_range"), out).drop("_range")
