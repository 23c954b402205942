"""Cutting documents into anchored Markdown parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliary.functions.anchors import anchor, part_front_matter, render_part, with_segment
from foliary.functions.text import normalize_markdown, strip
from foliary.params import CONVERTER_VERSION

FENCE = re.compile(r"(?s)\A(```[^\n]*\n)(.*)(\n```)\s*\Z")
FENCE_JAVA = r"(?s)\A```[^\n]*\n.*\n```\s*\z"
SLIDE_MARKER = r"(?i)<!--\s*Slide\s+number:\s*(\d+)\s*-->"


def pieces_of(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most `limit` characters, found by moving a window along the text.

    Inside a window the last blank line is the cut if it lies in the second half, else the last
    line end there, else the window's end.
    """
    begin, size = 0, len(text)
    while size - begin > limit:
        middle, end = begin + limit // 2, begin + limit
        cut = max(text.rfind("\n\n", middle, end), -1)
        if cut < 0:
            cut = text.rfind("\n", middle, end)
        if cut < 0:
            cut = end
        yield text[begin:cut].strip()
        begin = cut
        while begin < size and text[begin].isspace():
            begin += 1
    if begin < size:
        yield text[begin:].strip()


def fenced_pieces_of(text: str, limit: int) -> Iterator[str]:
    """As `pieces_of`, but each piece of a wholly fenced text is a fenced block of its own."""
    fence = FENCE.match(text)
    if fence is None:
        yield from pieces_of(text, limit)
        return
    opening, body, closing = fence.groups()
    for piece in pieces_of(body, max(1, limit - len(opening) - len(closing))):
        yield f"{opening}{piece}{closing}"


def _pieces(text: Column, limit: int, fences: bool) -> Column:
    """Array of pieces; only texts over the limit travel to Python."""
    cutter = fenced_pieces_of if fences else pieces_of

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(cutter(t, limit)))

    too_long = F.length(text) > limit
    return F.when(too_long, cut(F.when(too_long, text))).otherwise(F.array(text))


def chunk_text(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Rows (…, chunk_no, chunk) for each text; the other columns are kept."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(
        *kept, F.posexplode(_pieces(F.col(text), limit, fences=False)).alias("chunk_no", "chunk")
    ).withColumn("chunk_no", F.col("chunk_no") + 1)


def chunk_markdown(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """As `chunk_text`, keeping a text that is one fenced block valid in every chunk."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(
        *kept, F.posexplode(_pieces(F.col(text), limit, fences=True)).alias("chunk_no", "chunk")
    ).withColumn("chunk_no", F.col("chunk_no") + 1)


def section_anchor(number: Column, prefix: str = "section") -> Column:
    return anchor(section=F.concat(F.lit(f"{prefix}-"), number.cast("string")))


def section_chunks(text: Column, limit: int) -> Column:
    """Array of the bodies of the drafts that `chunk_sections` makes of a text; empty for an empty text."""
    clean = normalize_markdown(text)
    return F.when(F.length(clean) > 0, _pieces(clean, limit, fences=False)).otherwise(F.array().cast("array<string>"))


def chunk_sections(docs: DataFrame, limit: int, prefix: str = "section", text: str = "text") -> DataFrame:
    """Drafts (…, draft_no, anchors, body) anchored `section = prefix-n`; empty texts give none."""
    clean = docs.withColumn(text, normalize_markdown(F.col(text))).filter(F.length(text) > 0)
    chunks = chunk_text(clean, limit, text)
    return chunks.select(
        *[c for c in chunks.columns if c not in ("chunk_no", "chunk")],
        F.col("chunk_no").alias("draft_no"),
        section_anchor(F.col("chunk_no"), prefix).alias("anchors"),
        F.col("chunk").alias("body"),
    )


def empty_text_rejects(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose text is blank, which `chunk_sections` cannot turn into parts."""
    return docs.filter(F.length(normalize_markdown(F.col(text))) == 0).select(
        *[c for c in docs.columns if c != text], F.lit("no text").alias("error")
    )


def bound_drafts(drafts: DataFrame, limit: int) -> DataFrame:
    """Cut drafts over the limit; pieces keep the anchor and add `segment = n/total`."""
    kept = [c for c in drafts.columns if c not in ("body", "anchors")]
    cut = drafts.withColumn("_pieces", _pieces(normalize_markdown(F.col("body")), limit, fences=True))
    total = F.size("_pieces")
    rows = cut.select(
        *kept,
        "anchors",
        "body",
        total.alias("_total"),
        F.posexplode("_pieces").alias("_pos", "_piece"),
    )
    several = F.col("_total") > 1
    segment = F.format_string("%d/%d", F.col("_pos") + 1, F.col("_total"))
    return rows.select(
        *kept,
        (F.col("_pos") + 1).alias("segment_no"),
        F.when(several, with_segment(F.col("anchors"), segment)).otherwise(F.col("anchors")).alias("anchors"),
        F.when(several, F.col("_piece")).otherwise(F.col("body")).alias("body"),
    )


def split_marked_blocks(
    docs: DataFrame, text: str = "text", marker: str = SLIDE_MARKER, field: str = "slide"
) -> DataFrame:
    """One draft per marked block; a text without markers is one draft numbered 1.

    Text before the first marker is dropped. Escaped line ends next to markers are real ones.
    """
    kept = [c for c in docs.columns if c != text]
    body = F.col(text)
    if field == "slide":
        body = F.when(
            body.contains("<!-- Slide number:"), F.replace(body, F.lit("\\n"), F.lit("\n"))
        ).otherwise(body)
    ahead = marker.replace("(?i)", "(?i)(?=", 1) + ")"
    blocks = F.filter(F.split(body, ahead), lambda b: b.rlike("^" + marker))
    marked = F.size(blocks) > 0
    rows = docs.select(
        *kept,
        marked.alias("_marked"),
        F.posexplode(F.when(marked, blocks).otherwise(F.array(body))).alias("_pos", "_block"),
    )
    number = F.when(F.col("_marked"), F.regexp_extract("_block", marker, 1).cast("int")).otherwise(F.lit(1))
    return rows.select(
        *kept,
        (F.col("_pos") + 1).alias("draft_no"),
        anchor(**{field: number}).alias("anchors"),
        F.when(F.col("_marked"), strip(F.col("_block"))).otherwise(F.col("_block")).alias("body"),
    )


def part_id_of(part_no: Column) -> Column:
    return F.format_string("part-%03d", part_no)


def part_path_of(part_id: Column) -> Column:
    return F.concat(part_id, F.lit(".md"))


def part_columns(part_no: Column, version: str = CONVERTER_VERSION) -> dict[str, Column]:
    """Identity, path, Markdown and hash of a part; expects the draft and its file's columns."""
    part_id = part_id_of(part_no)
    front = part_front_matter(
        F.col("document_id"), F.col("relative_path"), F.col("source_sha256"), part_id,
        F.col("converted_at"), F.col("anchors"), version,
    )
    markdown = render_part(front, F.col("body"))
    return {
        "part_no": part_no.cast("int"),
        "part_id": part_id,
        "path": part_path_of(part_id),
        "anchors": F.col("anchors"),
        "body": F.col("body"),
        "markdown": markdown,
        "sha256": F.sha2(markdown, 256),
    }


def number_parts(drafts: DataFrame, order: tuple[str, ...] = ("draft_no",)) -> DataFrame:
    """Parts numbered in draft order within each document.

    `drafts` holds document_id, relative_path, source_sha256, converted_at, anchors, body and the
    order columns. A document is one source file, which bounds the window's partition.
    """
    number = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    numbered = drafts.withColumn("_part_no", number)
    return numbered.select(
        "document_id", *[v.alias(k) for k, v in part_columns(F.col("_part_no")).items()]
    )


@F.udtf(returnType="chunk_no int, chunk string")
class ChunkText:
    """SQL table function chunk_text(text, limit) for lateral joins, which Spark runs row by row."""

    def eval(self, text: str, limit: int):
        if text is not None:
            for number, piece in enumerate(pieces_of(text, limit) if len(text) > limit else [text], 1):
                yield number, piece


@F.arrow_udtf(returnType="id long, chunk_no int, chunk string")
class ChunkTexts:
    """SQL table function chunk_texts(TABLE(SELECT id, text …), limit): one Python call for each batch of rows."""

    def eval(self, batch: pa.RecordBatch, limit: pa.Array):
        most = limit[0].as_py()
        ids, texts = batch.column("id"), batch.column("text")
        # Only texts above the limit are cut in Python; the others pass as they are.
        short = pc.less_equal(pc.utf8_length(texts), most)
        whole, kept = ids.filter(short), texts.filter(short)
        yield pa.table([whole.cast(pa.int64()), pa.array([1] * len(whole), pa.int32()), kept.cast(pa.string())], ["id", "chunk_no", "chunk"])
        long = pc.invert(short)
        pieces = [list(pieces_of(t, most)) for t in texts.filter(long).to_pylist()]
        if pieces:
            at = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            numbers = pa.array([n for p in pieces for n in range(1, len(p) + 1)], pa.int32())
            yield pa.table([ids.filter(long).take(at).cast(pa.int64()), numbers, pa.array([x for p in pieces for x in p], pa.string())], ["id", "chunk_no", "chunk"])


def register_chunk_text(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("chunk_texts", ChunkTexts)
