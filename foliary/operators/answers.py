"""Checks of model answers against the selected evidence, and their presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.anchors import canonical_anchor, human_source_location
from foliary.functions.paths import file_name, relative_directory_of
from foliary.functions.text import canonical_document_id

ANCHOR_KEY = ["question_id", "document_id", "part_id", "anchor"]


def evidence_anchors(evidence: DataFrame) -> DataFrame:
    """(question_id, document_id, part_id, anchor, label): everything an answer may cite."""
    return evidence.select(
        "question_id", "document_id", "part_id", F.col("label").alias("trusted"), F.explode("source_anchors").alias("_anchor")
    ).select("question_id", "document_id", "part_id", canonical_anchor(F.col("_anchor")).alias("anchor"), "trusted")


def validate_citations(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations whose document, part and anchor are evidence and whose label is the trusted one."""
    cited = answers.select("question_id", F.posexplode("citations").alias("pos", "_c")).select("question_id", "pos", "_c.*")
    matched = cited.join(allowed, ANCHOR_KEY).filter(F.col("label") == F.col("trusted"))
    return dedupe_citations(matched.drop("trusted"))


def dedupe_citations(citations: DataFrame) -> DataFrame:
    """First citation of each (document, part, anchor)."""
    return citations.groupBy(*ANCHOR_KEY).agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))


def validate_conflicts(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Conflict values whose anchor belongs to the cited document, where at least two remain."""
    values = (
        answers.select("question_id", F.posexplode("conflicts").alias("conflict_no", "_x"))
        .select("question_id", "conflict_no", "_x.subject", "_x.analysis", F.posexplode("_x.values").alias("value_no", "_v"))
        .select("question_id", "conflict_no", "subject", "analysis", "value_no", "_v.*")
    )
    anchors = allowed.select("question_id", "document_id", "anchor").distinct()
    valid = values.join(anchors, ["question_id", "document_id", "anchor"], "left_semi")
    conflict = ["question_id", "conflict_no"]
    enough = valid.groupBy(*conflict).agg(F.count("*").alias("n")).filter("n >= 2").select(*conflict)
    return valid.join(enough, conflict, "left_semi")


def validate_downloads(answers: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Downloads of selected, present documents; names come from the inventory, repeats are dropped."""
    wanted = answers.select("question_id", F.posexplode("downloads").alias("pos", "_d")).select("question_id", "pos", "_d.document_id")
    first = wanted.groupBy("question_id", "document_id").agg(F.min("pos").alias("pos"))
    chosen = first.join(documents.select("question_id", "document_id"), ["question_id", "document_id"], "left_semi")
    present = files.filter("source_status = 'PRESENT'").select(
        F.col("id").alias("_id"), "filename", relative_directory_of(F.col("relative_path")).alias("relative_directory")
    )
    joined = chosen.withColumn("_id", canonical_document_id(F.col("document_id"))).join(present, "_id")
    return joined.select("question_id", "pos", "document_id", "filename", "relative_directory")


def citation_source_join(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations with file name, path, readable place and download link."""
    known = documents.select("question_id", "document_id", "source_path", "title")
    link = F.concat(F.lit("/api/files/"), "document_id", F.lit("/download"))
    name = F.when(F.length("source_path") > 0, file_name(F.col("source_path"))).otherwise(F.col("title"))
    return citations.join(known, ["question_id", "document_id"], "left").select(
        *citations.columns,
        name.alias("source_filename"),
        "source_path",
        human_source_location(F.col("anchor")).alias("source_location"),
        F.when(canonical_document_id(F.col("document_id")).isNotNull(), link).alias("download_url"),
    )


def apply_partial_failures(items: DataFrame, results: DataFrame, allow_partial: bool, fallback: str) -> tuple[DataFrame, DataFrame]:
    """(texts by position, rejected documents) once the results of shared requests are back.

    `items` has document_id, position, digest and `placeholder` (text that needed no request, or null);
    `results` has digest and text, null where the request failed. A failed item takes the fallback text
    if partial failures are allowed and the document has a real success; otherwise the whole document is
    rejected.
    """
    joined = items.join(results, "digest", "left").withColumn("_text", F.coalesce("placeholder", "text"))
    health = joined.groupBy("document_id").agg(
        F.count_if(F.col("_text").isNull()).alias("failed"),
        F.count_if(F.col("placeholder").isNull() & F.col("text").isNotNull()).alias("real"),
    )
    saved = (F.col("real") > 0) if allow_partial else F.lit(False)
    verdict = health.select("document_id", ((F.col("failed") == 0) | saved).alias("_ok"), "failed")
    texts = joined.join(verdict.filter("_ok").select("document_id"), "document_id", "left_semi").select(
        "document_id", "position", F.coalesce("_text", F.lit(fallback)).alias("text")
    )
    return texts, verdict.filter(~F.col("_ok")).select("document_id", F.col("failed").alias("failed_items"))
