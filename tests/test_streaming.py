"""Listings in several micro-batches are whole scans."""

import tempfile
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliary.operators.inventory import inventory_after, scan_diff
from foliary.plans import adapter as A
from foliary.plans.pipelines import assign_ids
from foliary.streaming import jobs
from foliary.streaming.state import read_version, versions
from tests.compare import difference, oracle

SF = "/root/testdata/sf0.001"


def test_listing_of_many_files(spark):
    text, _, _ = difference(entry.queries()["stream_scan_diff"], entry.oracle_sql()["stream_scan_diff"], spark, oracle(SF), SF)
    assert text == ""


def test_two_scans_and_one_that_is_not_complete(spark):
    folder, files = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), A.source_files(spark, SF)
    first = A.listing(spark, SF)
    second = first.filter("size % 3 <> 0")
    for scan, listing, short in ((1, first, 0), (2, second, 0), (3, second.limit(5), 1)):
        rows = listing.withColumn("scan_rows", F.lit(None).cast("long"))
        marker = listing.agg((F.count("*") + short).alias("scan_rows"))
        rows = rows.unionByName(marker, allowMissingColumns=True).withColumn("scan_id", F.lit(scan).cast("long"))
        rows.repartition(3).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = jobs.stream_scan_diff(stream, files, f"{folder}/state", f"{folder}/checkpoint")
    query.processAllAvailable()
    query.stop()
    expected = files
    for listing in (first, second):
        expected = inventory_after(assign_ids(scan_diff(expected, listing)))
    # Applied scans leave no rows behind but those of the last batches, and states of old batches go.
    left = spark.read.parquet(f"{folder}/state_rows").groupBy("scan_id").count().collect()
    assert {r.scan_id for r in left} <= {2, 3} and len(versions(spark, f"{folder}/state")) <= 2
    columns = [c for c in expected.columns if c != "id"]
    assert Counter(map(str, read_version(spark, f"{folder}/state").select(columns).collect())) == Counter(map(str, expected.select(columns).collect()))


def test_progress_by_changes(spark, monkeypatch):
    """Events of one item in any batch and order; a batch writes its own changes, which are added up now and then."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    monkeypatch.setattr(jobs, "ADD_UP", 3)
    rows = [
        [(1, 10, 5, "RUNNING"), (1, 11, 1, "COMPLETED")], [(1, 10, 3, "COMPLETED"), (2, 20, 1, "FAILED")], [(1, 10, 9, "FAILED")],
        [(2, 20, 4, "COMPLETED"), (1, 11, 0, "FAILED")], [(1, 10, 12, "COMPLETED"), (3, 30, 1, "QUEUED")],
    ]
    schema = "job_id long, item_id long, ts timestamp, status string"
    for batch in rows:
        frame = spark.createDataFrame(batch, "job_id long, item_id long, t long, status string")
        frame.select("job_id", "item_id", F.timestamp_seconds("t").alias("ts"), "status").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = jobs.stream_job_progress(stream, f"{folder}/state", f"{folder}/checkpoint")
    query.processAllAvailable()
    query.stop()
    found = {r.job_id: (r.completed_items, r.failed_items) for r in jobs.current_progress(spark, f"{folder}/state").collect()}
    assert found == {1: (2, 0), 2: (1, 0), 3: (0, 0)}
    sizes = [spark.read.parquet(f"{folder}/state/changes/version={v}").count() for v in versions(spark, f"{folder}/state/changes")]
    assert sizes == [1, 1, 1, 2] and versions(spark, f"{folder}/state/sums") == [3]


def _beats(spark, folder, batches):
    schema = "job_id long, us long"
    for batch in batches:
        spark.createDataFrame(batch, schema).select("job_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with jobs.keyed_state(spark):
        told = jobs.stream_stale_leases(stream, 60, "30 seconds").writeStream.outputMode("append")
        query = told.option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/out").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.schema("job_id long, last_heartbeat timestamp").parquet(f"{folder}/out")
    return sorted(tuple(r) for r in rows.select("job_id", F.unix_micros("last_heartbeat")).collect())


def test_silent_jobs_are_sessions(spark):
    """A heartbeat exactly at the timeout is in time, one a microsecond later is not; no function in Python is called."""
    folder, s = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 1_000_000
    batches = [
        [(1, 0), (1, 120 * s), (2, 0), (3, 10 * s)],
        [(1, 60 * s), (2, 60 * s + 1), (3, 130 * s)],
        [(4, 1_000 * s)],
        [(5, 2_000 * s)],
    ]
    assert _beats(spark, folder, batches) == [(1, 120 * s), (2, 0), (2, 60 * s + 1), (3, 10 * s), (3, 130 * s), (4, 1_000 * s)]
    beats = spark.readStream.schema("job_id long, ts timestamp").parquet(f"{folder}/in")
    plan = jobs.stream_stale_leases(beats, 60)._jdf.queryExecution().analyzed().toString()
    assert "SessionWindow" in plan or "session_window" in plan
    assert "TransformWithState" not in plan


def test_progress_keeps_items_in_groups(spark):
    """Many items of one job, repeated and older events, and rows without a job or item; the state has few keys."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(1, i, 1, "COMPLETED") for i in range(5_000)] + [(None, 1, 1, "FAILED"), (2, None, 1, "FAILED"), (2, 0, 1, "COMPLETED")]
    later = [(1, i, 2 if i % 2 else 0, "FAILED") for i in range(5_000)] + [(None, 1, 3, "COMPLETED"), (2, None, 0, "QUEUED"), (1, 2**60 + 1, 1, "FAILED")]
    for batch in (rows, later):
        frame = spark.createDataFrame(batch, "job_id long, item_id long, t long, status string")
        frame.select("job_id", "item_id", F.timestamp_seconds("t").alias("ts"), "status").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("job_id long, item_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = jobs.stream_job_progress(stream, f"{folder}/state", f"{folder}/checkpoint")
    query.processAllAvailable()
    keys = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    found = {r.job_id: (r.completed_items, r.failed_items) for r in jobs.current_progress(spark, f"{folder}/state").collect()}
    assert found == {1: (2_500, 2_501), 2: (1, 1), None: (1, 0)}
    assert keys <= jobs.ITEM_GROUPS + 3
