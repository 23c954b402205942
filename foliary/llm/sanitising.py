"""Personal data: exact patterns, and terms near them that reveal them by corpus co-occurrence.

Base spans are found in every whole text by fixed patterns (email, ip, card, phone; leftmost, not
overlapping within a kind; a match that fails its check is dropped).

Each distinct value found is a protected entity. All words of its document outside the base spans are its
context. Over the whole corpus, for entity e and term t,

    P(e) = documents with e / documents,   P(e | t) = documents with t and e / documents with t,

the term reveals log2(P(e | t) / P(e)) of the -log2 P(e) bits that name the entity. A term that stands
with the entity in at least `SUPPORT` different texts and reveals at least `DISCLOSURE` of its bits is a
span of kind `term`, wherever it stands in a document that holds that entity. `sanitised` replaces base
values by their kind and generalises terms to their length class, or removes them.

One pass over the texts finds base spans and the words of documents that have some. A second pass counts
the documents of the terms in enough texts with entities, filtered by a bit map of fixed size (2 MB); the
counts themselves are exact by the terms' 64-bit hashes. Pairs are joined by document, without texts, of
the entities and terms alone whose counts let them reach the support and the threshold.

Cases: a null or empty text has no span; copies of one text support a term once; repeated rows are each
returned; a null doc_id is kept; an empty table gives an empty result; further columns are ignored by
`report` and kept by `sanitised`.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.bitmaps import bitmap, passes
from foliary.llm.words import FOLDED_BYTE, Words, chunks, span_hashes, stripped
from foliary.operators.sizing import settled

#: Patterns of the base kinds, in their order: fixed values. A text without an `@` or a dot costs nothing for the first two,
#: which `emails` and `addresses` find from those marks on: taken alone they retry every start of a long run.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = "".join(chr(c) for c in range(128) if re.match("[A-Za-z0-9._%+-]", chr(c)))
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Words on either side of a value that are its context: all of the document. An entity in fewer different texts than
#: `SUPPORT` has no term, see the README.
WINDOW, SUPPORT, DISCLOSURE = sys.maxsize, 3, 0.9
#: Shortest term in bytes.
LEAST_BYTES = 1
#: Terms that a task counts before it passes them on.
MOST_TERMS = 200_000
_FOUND = (
    "_row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, copy long, "
    "entities array<bigint>, words array<struct<term:bigint,start:int,end:int>>"
)
_NOT_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL. Before an `@` stands the run of local characters back to the match or `@` before it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IP whose parts are at most 255: a chain of dotted numbers is taken four by four."""
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        start = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            values = [p.lstrip("0") for p in four]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) by kind, then start."""
    out = []
    out += [("email", a, b, text[a:b].lower()) for a, b in emails(text)]
    if "." in text:
        out += [("ip", a, b, text[a:b]) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = _NOT_DIGITS.sub("", m[0])
            if 8 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return out


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _context(text: str, spans: list[tuple[str, int, int, str]]) -> list[dict]:
    """The words of a text that lie outside all base spans."""
    data = np.frombuffer(text.encode(), np.uint8)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    words = Words(data, np.array([0, len(data)], np.int64))
    _, start, end = stripped(words)
    hashes = span_hashes(data, start, end, FOLDED_BYTE).view(np.int64)
    # A byte's place counts the characters that begin before it.
    low, high = points[start], points[end]
    free = (end - start) >= LEAST_BYTES
    for _, a, b, _ in spans:
        free[np.searchsorted(high, a, "right") : np.searchsorted(low, b)] = False
    return [
        {"term": t, "start": a, "end": b} for t, a, b in zip(hashes[free].tolist(), low[free].tolist(), high[free].tolist(), strict=True)
    ]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        bases, copies, entities, contexts = [], [], [], []
        for source in batch.column("text"):
            text = source.as_py() or ""
            spans = base_spans(text)
            for column, name in zip(counts, KINDS, strict=True):
                column.append(sum(s[0] == name for s in spans))
            bases.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans))
            copies.append(_digest(text.encode()) if spans else None)
            entities.append(sorted({_digest(f"{k}:{value}".encode()) for k, _, _, value in spans}) if spans else None)
            contexts.append(_context(text, spans) if spans else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_row"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()),
                pa.array(copies, pa.int64()), pa.array(entities, pa.list_(pa.int64())), pa.array(contexts, kind),
            ],
            ["_row", "doc_id", *(f"n_{k}" for k in KINDS), "base", "copy", "entities", "words"],
        )


def _term_counts(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, documents) of terms whose bit is set, added up over a task; they are passed on when many, and at the end."""
    terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "documents"])

    for batch in batches:
        for _, words in chunks(batch.column("text")):
            text, start, end = stripped(words)
            hashes = span_hashes(words.data, start, end, FOLDED_BYTE)
            some = passes(bits, hashes)
            own = np.unique(np.rec.fromarrays([hashes[some], text[some]])).f0
            terms, place = np.unique(np.concatenate([terms, own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, np.ones(len(own), np.int64)]), len(terms)).astype(np.int64)
            if len(terms) > MOST_TERMS:
                yield out()
                terms, counts = terms[:0], counts[:0]
    yield out()


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(_row, term) of the terms above the threshold for an entity of their document; None where there is none."""
    documents = float(found.count())
    # An entity without any other word in a document names nothing there and is not counted.
    held = found.filter(F.size("words") > 0)
    every = held.select("_row", "copy", F.explode("entities").alias("entity"))
    entities = settled(
        every.groupBy("entity").agg(F.count("*").alias("with_entity"), F.countDistinct("copy").alias("copies"))
        .filter(F.col("copies") >= SUPPORT).drop("copies").filter(F.col("with_entity") < documents)
    )
    fewest, most = entities.agg(F.min("with_entity"), F.max("with_entity")).first()
    if fewest is None:
        return None
    owners = settled(every.join(entities, "entity"))
    # A pair is in as many documents at most as its entity and as its term with any entity; 1e-9 is for rounding.
    reach = lambda with_entity: F.pow(F.lit(documents) / with_entity, F.lit(1 - DISCLOSURE)) * (1 + 1e-9)
    words = held.select("_row", "copy", F.explode(F.array_distinct(F.col("words.term"))).alias("term")).join(
        owners.select("_row").distinct(), "_row", "left_semi"
    )
    about = settled(
        words.groupBy("term", "copy").agg(F.count("*").alias("n")).groupBy("term")
        .agg(F.count("*").alias("copies"), F.sum("n").alias("least")).filter(F.col("copies") >= SUPPORT).drop("copies")
    )
    wanted = bitmap(about, F.col("term"))
    counted = texts.select("text").mapInArrow(lambda b: _term_counts(b, wanted), "term long, documents long").groupBy("term").agg(
        F.sum("documents").alias("with_term")
    )
    terms = settled(about.join(counted, "term").filter(
        (F.col("with_term") <= F.col("least") * reach(F.lit(fewest))) & (F.col("with_term") <= F.lit(most) * reach(F.lit(most)))
    ).drop("least"))
    near = settled(
        words.join(terms, "term").drop("copy").join(owners, "_row")
        .filter(F.col("with_term") <= F.col("with_entity") * reach(F.col("with_entity")))
    )
    bits = -F.log2(F.col("with_entity") / F.lit(documents))
    pairs = (
        near.groupBy("entity", "term", "copy").agg(F.count("*").alias("n"), F.max("with_entity").alias("with_entity"), F.max("with_term").alias("with_term"))
        .groupBy("entity", "term").agg(
            F.count("*").alias("copies"), F.sum("n").alias("n"), F.max("with_entity").alias("with_entity"), F.max("with_term").alias("with_term")
        )
        .filter((F.col("copies") >= SUPPORT) & (F.log2(F.col("n") / F.col("with_term")) + bits >= DISCLOSURE * bits))
    )
    return near.join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").select("_row", "term").distinct()


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    return _by_row(documents, F.monotonically_increasing_id()).drop("_row")


def _by_row(documents: DataFrame, row: Column) -> DataFrame:
    """The report with the number of each row as `_row`."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("_row"))
    found = settled(texts.select("_row", "doc_id", "text").mapInArrow(_found, _FOUND))
    out = found.select(
        "_row", "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.col("base")
    )
    marked = disclosing(found, texts)
    if marked is None:
        return out.withColumnRenamed("base", "spans")
    # The terms of one document are the only rows put together.
    terms = (
        found.filter(F.col("copy").isNotNull()).select("_row", F.explode("words").alias("c")).select("_row", "c.*")
        .join(marked, ["_row", "term"]).select("_row", "start", "end")
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        .select(F.col("_row").alias("_of"), F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(
            ":", F.lit(TERM), s["start"].cast("string"), s["end"].cast("string")
        ))).alias("terms"))
    )
    return out.join(terms, out["_row"] == terms["_of"], "left").select(
        "_row", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.concat_ws(",", "base", "terms").alias("spans")
    )


def generalised(text: str, spans: str, remove: bool = False) -> str:
    """The text with base values as their kind, and terms as their length class (or removed)."""
    out, at = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        out.append(f"<{kind}>" if kind != TERM else "" if remove else f"<term{min(3, (end - start) // 4)}>")
        at = end
    return "".join([*out, text[at:]])


def sanitised(documents: DataFrame, remove: bool = False) -> DataFrame:
    """The documents with their texts generalised, columns unchanged. Rows are written once with a number, by which
    their spans come back to them, whatever ids they share."""
    numbered = settled(documents.withColumn("_sn_row", F.monotonically_increasing_id()))
    spans = _by_row(numbered, F.col("_sn_row")).filter("spans <> ''").select(F.col("_row").alias("_sn_of"), F.col("spans").alias("_sn_spans"))
    rows = numbered.join(spans, numbered["_sn_row"] == spans["_sn_of"], "left").drop("_sn_row", "_sn_of")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                generalised(t, s, remove) if t and s else t
                for t, s in zip(batch.column("text").to_pylist(), batch.column("_sn_spans").to_pylist(), strict=True)
            ]
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type)).drop_columns(["_sn_spans"])

    return rows.mapInArrow(replace, documents.schema)
