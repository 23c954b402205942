"""Reading source files of each format, one row per file; unreadable files go to rejects."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions.anchors import anchor
from foliary.functions.cells import table_cell_render
from foliary.functions.paths import extension_of, file_name, is_ignored_source_path, is_safe_relative_path
from foliary.functions.text import strip
from foliary.operators.chunking import chunk_sections
from foliary.operators.sizing import settled


def _binary_files(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/").removeprefix("file:")
    begin = F.locate(base, F.col("path")) + len(base) + 1
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .withColumn("relative_path", F.substring(F.col("path"), begin, F.lit(2**31 - 1)))
        .filter(~is_ignored_source_path(F.col("relative_path")) & is_safe_relative_path(F.col("relative_path")))
    )


def scan_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Listing of the tree: path, name, extension, size, mtime. The content column is never read.

    Spark's own listing leaves out names that begin with a dot or an underscore.
    """
    name = file_name(F.col("relative_path"))
    return _binary_files(spark, root).select(
        "relative_path", name.alias("filename"), extension_of(name).alias("extension"),
        F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def read_contents(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(relative_path, content, sha256) of the tree, or of the wanted paths only."""
    files = _binary_files(spark, root)
    if wanted is not None:
        files = files.join(wanted.select("relative_path"), "relative_path", "left_semi")
    return files.select("relative_path", "content", F.sha2("content", 256).alias("sha256"))


def read_text_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with `text`, rejects): UTF-8 without its byte order mark, Unix line ends."""
    raw = F.col("content").cast("string")
    kept = [c for c in files.columns if c != "content"]
    text = F.when(raw.startswith("\ufeff"), F.substring(raw, 2, 2**31 - 1)).otherwise(raw)
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    valid = F.is_valid_utf8(raw)
    return (
        files.filter(valid).select(*kept, text.alias("text")),
        files.filter(~valid).select(*kept, F.lit("not UTF-8").alias("error")),
    )


def read_delimited_tables(files: DataFrame, delimiter: str) -> tuple[DataFrame, DataFrame]:
    """((document_id, sheet, row_no, cells) of files without header, rejects).

    Rows count physically from 1. A file that the parser refuses is a reject; its rows do not count. Each
    file is parsed once: rows and refusals are written together.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        columns = ["document_id", "row_no", "raw", "error"]
        for batch in batches:
            for identifier, text in zip(batch["document_id"], batch["text"]):
                block: list[tuple] = []
                try:
                    for number, values in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
                        block.append((identifier, number, values, None))
                        if len(block) == 4_096:
                            yield pd.DataFrame(block, columns=columns)
                            block = []
                except csv.Error as error:
                    block.append((identifier, None, None, f"invalid table: {error}"))
                if block:
                    yield pd.DataFrame(block, columns=columns).astype({"row_no": "Int64"})

    raw = settled(files.select("document_id", "text").mapInPandas(rows, "document_id long, row_no long, raw array<string>, error string"))
    rejects = raw.filter("error is not null").select("document_id", "error")
    cells = F.transform("raw", lambda c: table_cell_render(c, T.StringType()))
    good = raw.filter("error is null").join(rejects.select("document_id"), "document_id", "left_anti")
    return good.select("document_id", F.lit(None).cast("string").alias("sheet"), "row_no", cells.alias("cells")), rejects


@F.pandas_udf(T.StringType())
def _pretty_json(texts: pd.Series) -> pd.Series:
    def pretty(text):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True)
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(pretty).astype(object)


@F.pandas_udf(T.BooleanType())
def _well_formed(texts: pd.Series) -> pd.Series:
    def parses(text):
        parser = expat.ParserCreate()

        def refuse(*_):
            raise ValueError("entity declarations are refused")

        parser.EntityDeclHandler = refuse
        try:
            parser.Parse(text.encode("utf-8"), True)
            return True
        except (expat.ExpatError, ValueError, AttributeError):
            return False

    return texts.map(parses)


def _fenced(docs: DataFrame, language: str, body, error: str) -> tuple[DataFrame, DataFrame]:
    kept = [c for c in docs.columns if c != "text"]
    rows = docs.withColumn("_body", body)
    fence = F.concat(F.lit(f"```{language}\n"), F.col("_body"), F.lit("\n```"))
    good = rows.filter("_body is not null").select(
        *kept, F.lit(1).alias("draft_no"), anchor(section=F.lit("document")).alias("anchors"), fence.alias("body")
    )
    return good, rows.filter("_body is null").select(*kept, F.lit(error).alias("error"))


def read_json_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, rejects): whole JSON files, re-serialised with sorted keys inside a fence."""
    return _fenced(docs, "json", _pretty_json("text"), "not JSON")


def read_xml_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, rejects): well-formed XML files, kept as they are inside a fence."""
    return _fenced(docs, "xml", F.when(_well_formed("text"), strip(F.col("text"))), "not XML")


class _Readable(HTMLParser):
    """Collects visible text: headings marked, blocks apart, scripts, styles and comments dropped."""

    SKIP = {"script", "style", "template", "noscript"}
    BLOCK = {
        "address", "article", "aside", "blockquote", "body", "div", "dd", "dl", "dt", "fieldset", "figure", "footer", "form",
        "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul", "title",
    }

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.words: list[str] = []
        self.lead = ""
        self.hidden = 0

    def close_block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append(self.lead + text)
        self.words, self.lead = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.hidden += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.close_block()
            self.lead = "#" * int(tag[1]) + " "
        elif tag in self.BLOCK:
            self.close_block()
        elif tag in ("br", "td", "th"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCK or (len(tag) == 2 and tag[0] == "h"):
            self.close_block()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Readable Markdown text of HTML."""

    def read(html):
        parser = _Readable()
        parser.feed(html)
        parser.close()
        parser.close_block()
        return "\n\n".join(parser.blocks)

    return pages.map(read, na_action="ignore").astype(object)


def html_pages_to_parts(pages: DataFrame, limit: int) -> DataFrame:
    """Section drafts of HTML pages; the other columns are kept."""
    kept = [c for c in pages.columns if c != "html"]
    return chunk_sections(pages.select(*kept, html_text("html").alias("text")), limit)
