"""Request texts for batch inference, rendered as rows; the model job itself is the user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import estimate_tokens, json_string


def _spaced_json(anchors: Column) -> Column:
    """Anchor JSON with a blank after each colon and comma between fields."""
    names = ("page", "slide", "sheet", "rows", "section", "segment")
    fields = [
        F.when(
            anchors[n].isNotNull(),
            F.concat(F.lit(f'"{n}": '), anchors[n].cast("string") if n in ("page", "slide") else json_string(anchors[n])),
        )
        for n in names
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def part_prompt_rows(parts: DataFrame, batches: DataFrame, files: DataFrame, instruction: str) -> DataFrame:
    """(document_id, batch_no, request, bytes, tokens): the parts of a batch between tags, after a header."""
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("<markdown-part id="), json_string(F.col("part_id")), F.lit(">")),
        F.concat(F.lit("anchors: "), _spaced_json(F.col("anchors"))),
        F.col("markdown"),
        F.lit("</markdown-part>"),
    )
    members = parts.join(batches.select("document_id", "part_no", "batch_no"), ["document_id", "part_no"])
    grouped = members.groupBy("document_id", "batch_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", text.alias("text")))), lambda p: p["text"]), "\n\n").alias("_body")
    )
    source = files.select(F.col("id").alias("document_id"), "relative_path", "extension")
    header = F.concat(
        F.lit(f"{instruction}\n\nsource_path: "), json_string(F.col("relative_path")),
        F.lit("\nsource_extension: "), json_string(F.col("extension")), F.lit("\n\n"),
    )
    request = F.concat(header, F.col("_body"))
    return grouped.join(source, "document_id").select(
        "document_id", "batch_no", request.alias("request"), F.octet_length(request).alias("bytes"), estimate_tokens(request).alias("tokens")
    )


def routing_prompt_rows(entries: DataFrame, group: list[str], member: str, heading: str, instruction: str) -> DataFrame:
    """One routing request per (group, batch_no): instruction, question, and the batch's index entries.

    `entries` holds the group columns, batch_no, pos, question and entry_json, batched with
    `pack_batches`, which bounds what one request collects.
    """
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry_json"))), lambda e: e["entry_json"]), ","
    )
    grouped = entries.groupBy(*group, "batch_no").agg(F.first("question").alias("_question"), listed.alias("_entries"))
    request = F.concat(
        F.lit(f"{instruction}\n\nuser_question:\n"), F.col("_question"), F.lit(f'\n\n{heading}:\n{{"{member}":['), F.col("_entries"), F.lit("]}")
    )
    return grouped.select(*group, "batch_no", request.alias("request"), F.octet_length(request).alias("bytes"), estimate_tokens(request).alias("tokens"))


def answer_prompt_rows(questions: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, request): the JSON payload of an answer request.

    `evidence` holds the eligible parts (doc_order, part_order, document_id, part_id, label, content and
    source_anchors); `documents` the selected documents in order with title, filename and
    source_modified_at. Both are capped per question, which bounds the payload.
    """
    keep = {"ignoreNullFields": "false"}

    def ordered(*order: str, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_json")))), lambda e: e["_json"])

    part = F.to_json(F.struct("document_id", "part_id", F.col("content").alias("markdown")), keep)
    anchors = F.transform("source_anchors", lambda a: F.to_json(a))
    source = F.to_json(F.struct("part_id", F.col("label").alias("citation_label"), anchors.alias("anchors")), keep)
    markdown = evidence.groupBy("question_id").agg(ordered("doc_order", "part_order", value=part).alias("_parts"))
    sources = evidence.groupBy("question_id", "document_id").agg(F.array_join(ordered("part_order", value=source), ",").alias("_sources"))
    head = F.to_json(F.struct("document_id", "title", "filename", "source_modified_at"), keep)
    with_parts = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"parts":['), F.coalesce("_sources", F.lit("")), F.lit("]}"))
    listed = (
        documents.withColumn("_head", head).join(sources, ["question_id", "document_id"], "left")
        .groupBy("question_id").agg(ordered("doc_order", value=with_parts).alias("_documents"))
    )
    joined = questions.join(markdown, "question_id", "left").join(listed, "question_id", "left")
    request = F.concat(
        F.lit('{"user_question":'), json_string(F.col("text")),
        F.lit(',"selected_markdown_parts":['), F.coalesce(F.array_join("_parts", ","), F.lit("")),
        F.lit('],"source_metadata":['), F.coalesce(F.array_join("_documents", ","), F.lit("")), F.lit("]}"),
    )
    return joined.select("question_id", request.alias("request"), F.octet_length(request).alias("bytes"), estimate_tokens(request).alias("tokens"))
