"""Source-file inventory: scan diff, filters and folder views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.paths import (
    clean_path, extension_of, file_name, path_in_folder, relative_directory_of,
)
from foliary.params import MISSING, PRESENT

FILE_COLUMNS = [
    "id", "relative_path", "filename", "extension", "size", "mtime_ns", "sha256", "source_status",
    "conversion_status", "index_status", "last_error",
]
CONVERTIBLE = ("NEW", "CHANGED", "FAILED", "UNSUPPORTED")

# Which extractor handles which extension.
EXTRACTORS = {
    "text": (".txt", ".md"),
    "delimited": (".csv", ".tsv"),
    "json": (".json",),
    "xml": (".xml",),
    "html": (".html",),
    "workbook": (".xlsx", ".xls"),
    "slides": (".pptx", ".ppt"),
    "word": (".docx", ".doc"),
    "pdf": (".pdf",),
    "image": (".png", ".jpg", ".jpeg", ".webp"),
}


def _stale(status: Column) -> Column:
    return F.when(status == "INDEXED", F.lit("STALE")).otherwise(status)


def _needs_hash(prev: str, new: str) -> Column:
    p, n = (lambda c: F.col(f"{prev}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    return (
        p("relative_path").isNull()
        | (p("source_status") != PRESENT)
        | (p("size") != n("size"))
        | (p("mtime_ns") != n("mtime_ns"))
    )


def scan_candidates(previous: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed paths whose bytes must be hashed: new, not present before, or other size or time."""
    joined = listing.alias("n").join(previous.alias("p"), "relative_path", "left")
    return joined.filter(
        F.col("p.id").isNull()
        | (F.col("p.source_status") != PRESENT)
        | (F.col("p.size") != F.col("n.size"))
        | (F.col("p.mtime_ns") != F.col("n.mtime_ns"))
    ).select("relative_path")


def scan_diff(previous: DataFrame, listing: DataFrame) -> DataFrame:
    """Inventory rows after a scan, each with its change: new, changed, unchanged, removed, missing.

    `listing` holds relative_path, size, mtime_ns and sha256; the hash may be null where
    `scan_candidates` does not ask for it. A file whose hash was asked for but is null could not be
    read: it counts as absent, with `unsafe_skipped`. New rows have no id yet.
    """
    joined = previous.alias("p").join(
        listing.alias("n"), F.col("p.relative_path") == F.col("n.relative_path"), "full"
    )
    listed = F.col("n.relative_path").isNotNull()
    known = F.col("p.relative_path").isNotNull()
    asked = listed & _needs_hash("p", "n")
    skipped = asked & F.col("n.sha256").isNull()
    seen = listed & ~skipped
    altered = F.col("n.sha256") != F.col("p.sha256")
    change = (
        F.when(skipped & ~known, F.lit("skipped"))
        .when(seen & ~known, F.lit("new"))
        .when(seen & asked & altered, F.lit("changed"))
        .when(seen, F.lit("unchanged"))
        .when(F.col("p.index_status") == "NOT_INDEXED", F.lit("removed"))
        .otherwise(F.lit("missing"))
    )
    tagged = joined.select("p.*", F.struct("n.*").alias("n"), change.alias("change"), skipped.alias("skipped"), (seen & asked).alias("read"))
    path = F.coalesce(F.col("relative_path"), F.col("n.relative_path"))
    is_new, is_changed, is_missing = (F.col("change") == c for c in ("new", "changed", "missing"))
    fresh = F.col("read")
    index = F.col("index_status")
    values = {
        "id": F.col("id"),
        "relative_path": path,
        "filename": F.when(fresh, file_name(path)).otherwise(F.col("filename")),
        "extension": F.when(fresh, extension_of(file_name(path))).otherwise(F.col("extension")),
        "size": F.when(fresh, F.col("n.size")).otherwise(F.col("size")),
        "mtime_ns": F.when(fresh, F.col("n.mtime_ns")).otherwise(F.col("mtime_ns")),
        "sha256": F.when(is_new | is_changed, F.col("n.sha256")).otherwise(F.col("sha256")),
        "source_status": F.when(fresh, F.lit(PRESENT)).when(is_missing, F.lit(MISSING)).otherwise(F.col("source_status")),
        "conversion_status": F.when(is_new, F.lit("NEW")).when(is_changed, F.lit("CHANGED")).otherwise(F.col("conversion_status")),
        "index_status": F.when(is_new, F.lit("NOT_INDEXED"))
        .when(is_changed | (is_missing & (F.col("source_status") != MISSING)), _stale(index))
        .otherwise(index),
        "last_error": F.when(~is_new & ~is_changed, F.col("last_error")),
    }
    return tagged.select(
        *[v.alias(k) for k, v in values.items()],
        "change",
        F.when(F.col("skipped"), F.lit(1)).otherwise(F.lit(0)).alias("unsafe_skipped"),
    )


def inventory_after(changes: DataFrame) -> DataFrame:
    """The stored inventory after a scan: removed and unreadable new files are gone."""
    return changes.filter(~F.col("change").isin("removed", "skipped")).drop("change", "unsafe_skipped")


def scan_summary(changes: DataFrame) -> DataFrame:
    """One row of scan counters."""
    def count(*names: str) -> Column:
        return F.count_if(F.col("change").isin(*names))

    return changes.agg(
        count("new", "changed", "unchanged").alias("scanned"),
        *[count(n).alias(n) for n in ("new", "changed", "unchanged", "removed", "missing")],
        F.coalesce(F.sum("unsafe_skipped"), F.lit(0)).alias("unsafe_skipped"),
    )


def dispatch_by_extension(files: DataFrame) -> DataFrame:
    """Adds the extractor; a file without one becomes UNSUPPORTED."""
    route = F.lit(None).cast("string")
    for name, extensions in EXTRACTORS.items():
        route = F.when(F.col("extension").isin(*extensions), F.lit(name)).otherwise(route)
    return files.withColumn("extractor", route).withColumn(
        "conversion_status",
        F.when(F.col("extractor").isNull(), F.lit("UNSUPPORTED")).otherwise(F.col("conversion_status")),
    )


def _present() -> Column:
    return F.col("source_status") == PRESENT


def eligible_documents(files: DataFrame) -> DataFrame:
    return files.filter(_present() & (F.col("conversion_status") == "READY"))


def needs_conversion(files: DataFrame, retry_failed: bool = False) -> DataFrame:
    wanted = ("NEW", "CHANGED", "FAILED") if retry_failed else ("NEW", "CHANGED")
    return files.filter(_present() & F.col("conversion_status").isin(*wanted)).orderBy("id")


def needs_reconversion(files: DataFrame) -> DataFrame:
    return files.filter(_present() & ~F.col("conversion_status").isin("QUEUED", "CONVERTING")).orderBy("id")


def folder_conversion_set(files: DataFrame, folder: str) -> DataFrame:
    """Files strictly below the folder that still need conversion."""
    return files.filter(
        path_in_folder(F.col("relative_path"), F.lit(folder)) & _present() & F.col("conversion_status").isin(*CONVERTIBLE)
    ).orderBy("id")


def selected_files_check(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict per distinct requested id in request order: missing, not_present, ineligible or ok."""
    wanted = requested.groupBy("id").agg(F.min("pos").alias("pos"))
    joined = wanted.join(files.select("id", "source_status", "conversion_status"), "id", "left")
    verdict = (
        F.when(F.col("source_status").isNull(), F.lit("missing"))
        .when(F.col("source_status") != PRESENT, F.lit("not_present"))
        .when(~F.col("conversion_status").isin(*CONVERTIBLE), F.lit("ineligible"))
        .otherwise(F.lit("ok"))
    )
    return joined.select("id", "pos", verdict.alias("verdict"))


def inventory_order(files: DataFrame) -> DataFrame:
    return files.orderBy("relative_path", "id")


def library_view(files: DataFrame) -> DataFrame:
    """Read-only listing with links for files that are present."""
    def link(kind: str) -> Column:
        return F.when(_present(), F.concat(F.lit("/api/files/"), F.col("id").cast("string"), F.lit(f"/{kind}")))

    return files.select(
        "id", "relative_path", "filename", "extension", "size", "index_status",
        _present().alias("available"), link("view").alias("view_url"), link("download").alias("download_url"),
    )


def library_search(files: DataFrame, text: str) -> DataFrame:
    """Indexed files whose lower-cased path holds the trimmed, lower-cased text."""
    return files.filter(
        (F.col("index_status") == "INDEXED") & F.lower("relative_path").contains(text.strip().lower())
    )


def folder_tree_rollup(files: DataFrame) -> DataFrame:
    """(folder_path, n_files): descendant files of every folder; the empty path is the root."""
    parts = F.filter(F.split("relative_path", "/"), lambda p: p != "")
    paths = files.select(parts.alias("_parts")).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("_parts") - 1),
                lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/"),
            )
        ).alias("folder_path")
    )
    return paths.groupBy("folder_path").agg(F.count("*").alias("n_files"))


def folder_listing(files: DataFrame, folder: str = "") -> DataFrame:
    """Immediate subfolders with their counts, and the files of this level, of indexed files."""
    prefix = f"{folder}/" if folder else ""
    inside = files.filter(
        (F.col("index_status") == "INDEXED") & F.col("relative_path").startswith(prefix)
    ).select("id", F.split(F.substring("relative_path", len(prefix) + 1, 2**31 - 1), "/").alias("_rest"))
    deep = F.size("_rest") > 1
    second = F.when(F.size("_rest") > 2, F.col("_rest")[1])
    return (
        inside.groupBy(
            F.when(deep, F.lit("folder")).otherwise(F.lit("file")).alias("kind"),
            F.col("_rest")[0].alias("name"),
        )
        .agg(F.count("*").alias("file_count"), F.countDistinct(second).alias("subfolder_count"))
    )


def source_references(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata of requested ids in request order; unknown ids are dropped."""
    return (
        requested.join(files, "id")
        .select(
            "request_id",
            "pos",
            F.col("id").cast("string").alias("document_id"),
            "filename",
            "relative_path",
            relative_directory_of(F.col("relative_path")).alias("relative_directory"),
            F.when(_present(), F.concat(F.lit("/api/files/"), F.col("id").cast("string"), F.lit("/download"))).alias("download_url"),
            _present().alias("available"),
        )
        .orderBy("request_id", "pos")
    )


def snapshot_guard(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """Snapshot documents whose file is gone, not eligible any more, or has another path or hash."""
    current = eligible_documents(files).select("id", F.col("relative_path").alias("_path"), F.col("sha256").alias("_sha"))
    joined = snapshot.join(current, "id", "left")
    reason = (
        F.when(F.col("_path").isNull(), F.lit("not eligible"))
        .when(F.col("_path") != F.col("relative_path"), F.lit("path changed"))
        .when(F.col("_sha") != F.col("sha256"), F.lit("content changed"))
    )
    return joined.withColumn("reason", reason).filter("reason is not null").select("id", "reason")


def content_changed_guard(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files whose bytes no longer have the inventoried hash; a vanished file counts."""
    now = listing.select("relative_path", F.col("sha256").alias("_now"))
    return (
        files.join(now, "relative_path", "left")
        .filter(F.col("_now").isNull() | (F.col("_now") != F.col("sha256")))
        .select("id", "relative_path", F.col("sha256").alias("expected"), F.col("_now").alias("actual"))
    )
