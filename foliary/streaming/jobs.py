"""Streams: inventory scans, job progress and lost heartbeats."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliary.operators.inventory import inventory_after, scan_diff
from foliary.operators.sizing import settled
from foliary.plans.pipelines import assign_ids
from foliary.streaming.state import clear_scans, clear_versions, read_version, versions, write_version

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors ask for."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stream_scan_diff(listings: DataFrame, inventory: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keeps an inventory current from a stream of listings, whose rows come in any files and order.

    Rows carry `scan_id`; one row of each scan, without a path, has the number of its files in `scan_rows`.
    Micro-batches are appended to a table partitioned by batch and scan; a small table of counts by scan tells which
    scan is complete, and only the partitions of that scan are read. It is applied by the batch
    that completes it; one that completes after a newer scan is passed over. Rows of applied scans are cleared by a
    later batch, when the version that has them in is finished. Each state is a version of its own, so a
    retried batch repeats itself.
    """
    rows, counts = f"{state}_rows", f"{state}_counts"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = F.col("relative_path").isNotNull()
        batch.write.mode("overwrite").partitionBy("scan_id").parquet(f"{rows}/version={number}")
        came = spark.read.schema(f"{rows_schema}, version long").parquet(rows).filter(F.col("version") == number).groupBy("scan_id").agg(
            F.count_if(there).alias("found"), F.max("scan_rows").alias("expected")
        )
        before = read_version(spark, counts, before=number)
        # One row for each scan that is not complete, and the newest one that was.
        known = came.withColumn("applied", F.lit(False)) if before is None else came.withColumn("applied", F.lit(False)).unionByName(before)
        scans = known.groupBy("scan_id").agg(F.sum("found").alias("found"), F.max("expected").alias("expected"), F.max("applied").alias("applied")).collect()
        newest = max((r["scan_id"] for r in scans if r["applied"]), default=None)
        clear_scans(spark, rows, [r["scan_id"] for r in scans if newest is not None and r["scan_id"] <= newest], before=number)
        full = sorted(r["scan_id"] for r in scans if not r["applied"] and r["found"] == r["expected"] and (newest is None or r["scan_id"] > newest))
        current = read_version(spark, state, before=number)
        current = inventory if current is None else current
        for scan in full:
            listing = spark.read.schema(f"{rows_schema}, version long").parquet(rows).filter(
                (F.col("scan_id") == scan) & (F.col("version") <= number) & there
            ).drop("scan_id", "scan_rows", "version")
            current = settled(inventory_after(assign_ids(scan_diff(current, listing))))
        newest = max([*full, *([] if newest is None else [newest])], default=None)
        kept = [(r["scan_id"], r["found"], r["expected"], r["scan_id"] == newest) for r in scans if newest is None or r["scan_id"] >= newest]
        write_version(spark.createDataFrame(kept, "scan_id long, found long, expected long, applied boolean").coalesce(1), counts, number)
        if full:
            write_version(current, state, number)
        clear_versions(spark, counts, keep=2)
        clear_versions(spark, state, keep=2)

    rows_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listings.schema.fields)
    return listings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


#: Items are dealt into so many groups of the state. A batch reads and writes those of its items whole.
ITEM_GROUPS = 2_048
_ITEM = ["job_id", "item_id"]


def _newest(events: pd.DataFrame) -> pd.DataFrame:
    """The latest event of each item; of equal times the greater status."""
    return events.sort_values(["ts_us", "status"], kind="stable").drop_duplicates(_ITEM, keep="last")


class LatestStatus(StatefulProcessor):
    """Keeps the latest events of a group of items as one value, and gives how newer ones change the counts of their jobs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "items binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = _newest(pd.concat([frame[[*_ITEM, "ts_us", "status"]] for frame in rows]))
        if self.last.exists():
            known = pa.ipc.open_stream(self.last.get()[0]).read_pandas()
            came["_came"] = True
            # A repeated event is no newer one.
            after = _newest(pd.concat([came, known]))
            newer = after[after.pop("_came").notna()]
            before = known.merge(newer[_ITEM], on=_ITEM)
        else:
            after, newer, before = came, came, came.iloc[:0]
        if newer.empty:
            return
        table = pa.Table.from_pandas(after, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        self.last.update((sink.getvalue().to_pybytes(),))
        counted = pd.concat([newer.assign(by=1), before.assign(by=-1)])
        for kind in ("COMPLETED", "FAILED"):
            counted[f"{kind.lower()}_items"] = counted["by"] * (counted["status"] == kind)
        counted["items"] = counted["by"]
        changes = counted.groupby("job_id", as_index=False)[["completed_items", "failed_items", "items"]].sum()
        # A group is of items with a job or of items without one.
        yield changes.assign(job_id=pd.array([None] * len(changes), "Int64")) if key[1] else changes

    def close(self) -> None:
        pass


PROGRESS = "job_id long, completed_items long, failed_items long, items long"
#: Batches after which the changes before are added up into one row a job.
ADD_UP = 32


def stream_job_progress(items: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Changes of the counts of each job from a stream of item events; `current_progress` reads them.

    The latest event of each item is in Spark's own keyed state, so a batch writes the changes that it makes and no
    more. State is kept by group of items (`ITEM_GROUPS`, by hash), since a call for every item takes
    most of the time. The latest event is a maximum: order does not matter, there is no watermark and no event is late. Every
    `ADD_UP` batches the changes so far become one row a job.
    """
    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        change = [F.sum(c).alias(c) for c in ("completed_items", "failed_items", "items")]
        changes = batch.groupBy("job_id").agg(*change)
        if number and number % ADD_UP == 0:
            before = _changes(spark, state, number)
            write_version((changes if before is None else changes.unionByName(before)).groupBy("job_id").agg(*change), f"{state}/sums", number)
        else:
            write_version(changes, f"{state}/changes", number)

    group = F.pmod(F.xxhash64(*_ITEM), F.lit(ITEM_GROUPS)).alias("group")
    missing = [F.col(c).isNull().alias(f"no_{c}") for c in _ITEM]
    events = items.select(
        group, *missing, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _ITEM], F.unix_micros("ts").alias("ts_us"), "status"
    )
    with keyed_state(items.sparkSession):
        changes = events.groupBy("group", "no_job_id", "no_item_id").transformWithStateInPandas(LatestStatus(), PROGRESS, "Update", "None")
        return changes.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).start()


def _changes(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The newest sums, and the changes of the batches after them."""
    sums = [v for v in versions(spark, f"{state}/sums") if before is None or v < before]
    single = [v for v in versions(spark, f"{state}/changes") if (not sums or v > sums[-1]) and (before is None or v < before)]
    paths = [f"{state}/sums/version={v}" for v in sums[-1:]] + [f"{state}/changes/version={v}" for v in single]
    return spark.read.schema(PROGRESS).parquet(*paths) if paths else None


def current_progress(spark: SparkSession, state: str) -> DataFrame | None:
    """Completed and failed items per job after the last finished micro-batch."""
    changes = _changes(spark, state)
    return None if changes is None else changes.groupBy("job_id").agg(
        F.sum("completed_items").alias("completed_items"), F.sum("failed_items").alias("failed_items")
    )


def stream_stale_leases(heartbeats: DataFrame, timeout_seconds: int, late: str = "10 seconds") -> DataFrame:
    """Stream of (job_id, last_heartbeat): every heartbeat that no other one of its job followed within the timeout.

    Heartbeats that follow one another in time are a session, whose last one is told once the watermark has passed
    every heartbeat that could still have continued it. So files and rows may come in any order that `late` covers; a
    later one is dropped if its session would be over. A job that falls silent again is told again.
    """
    session = F.session_window("ts", f"{timeout_seconds} seconds")
    told = heartbeats.withWatermark("ts", late).groupBy("job_id", session).agg(F.max("ts").alias("last_heartbeat"))
    return told.select("job_id", "last_heartbeat")
