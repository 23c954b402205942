"""Versioned state tables: each micro-batch writes its own version, so a retried batch repeats itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliary.sources.artifacts import _exists


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, from the success markers of the version folders."""
    if not _exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def read_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest state, or the newest one before the given version."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


def write_version(frame: DataFrame, path: str, version: int) -> None:
    frame.write.mode("overwrite").parquet(f"{path}/version={version}")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Removes all but the newest finished versions; a retried batch needs the one before its own."""
    for version in versions(spark, path)[:-keep]:
        _delete(spark, f"{path}/version={version}")


def clear_scans(spark: SparkSession, path: str, scans: list[int], before: int) -> None:
    """Removes the rows of these scans from the versions before the given one."""
    for version in (v for v in versions(spark, path) if v < before):
        for scan in scans:
            _delete(spark, f"{path}/version={version}/scan_id={scan}")
