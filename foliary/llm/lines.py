"""Substring dedup by hashing lines: equal runs of units across all documents, the earliest kept, offsets retained.

A unit is a sentence of a line: texts are cut at line breaks and behind '.', '!' and '?' before a blank or tab. A
unit is normalised to its words (ASCII letters in lower case, white space apart). From every unit with words
the units on are joined until they hold `MIN_WORDS` words, and so are the units up to it: the shortest runs that
begin and end there. A run is digested to 128 bits. Digests are grouped over all documents; of equal
runs the first by rank stays, and all units of the others are removed. Rank is (doc_id, null last; hash of the
text; number of the unit). Each removed word stands in an earlier run, so its first occurrence stays. A run that
overlaps the first equal one of its own document is left alone.

Runs travel as digest and rank, never as text. Three reads of the texts: the first counts digests, whose repeated
ones set a bit map; the second gives digest and rank of the runs whose bit is set, and the earliest rank of each
digest is a minimum that is pre-aggregated before its shuffle. The earliest runs set a second map, and in the third
read a run that is not in it is a repeat for certain; its units leave the task. The few other runs are told apart by a
join with the earliest ones.

Cases: a null or empty text has no unit; a run repeated inside one document is removed like any other;
equal rows have equal ranks, and their units stay or go together; rows with one doc_id and different texts are
different documents, each cut by its own units; an empty table gives an empty result; further columns are
ignored by `removed_units` and kept by `without_repeats`. A passage is found from its first whole unit to its
last one, if these hold `MIN_WORDS` words; the parts of units at its ends stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.bitmaps import bitmap, bits_for, passes
from foliary.llm.words import mix
from foliary.operators.sizing import settled

#: Words of a run. Shorter sentences repeat by chance and carry structure; they go only as part of a run.
MIN_WORDS = 15
_CUT = re.compile(r"\n|[.!?](?=[ \t])")
RUN = "doc_id long, th long, unit int, d1 long, d2 long"
SEEN = "doc_id long, th long, row long, d1 long, d2 long, unit int, start long, end long, n_words int, first int, maybe boolean"
#: Rows of a batch that are taken at once.
AT_ONCE = 256


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each unit, in code points."""
    start = 0
    for cut in _CUT.finditer(text):
        yield start, cut.start() if cut.group() == "\n" else cut.end()
        start = cut.end()
    yield start, len(text)


def shortest_runs(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of `least` words from each place on and up to each place."""
    found, last, held = set(), -1, 0
    for first, count in enumerate(counts):
        while held < least and last + 1 < len(counts):
            last += 1
            held += counts[last]
        if held < least:
            break
        found.add((first, last))
        held -= count
    first, held = 0, 0
    for last, count in enumerate(counts):
        held += count
        while held - counts[first] >= least:
            held -= counts[first]
            first += 1
        if held >= least:
            found.add((first, last))
    return sorted(found)


def runs(text: str, least: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]], np.ndarray]:
    """(unit, start, end, words) of the units with words, (first, last) of the runs of these, their digests (n x 2);
    without the runs that overlap the first equal one."""
    units, lines = [], []
    for unit, (start, end) in enumerate(spans(text)):
        words = text[start:end].encode().lower().split()
        if words:
            units.append((unit, start, end, len(words)))
            lines.append(b" ".join(words))
    found = shortest_runs([u[3] for u in units], least)
    kept, digests, last_of = [], [], {}
    for a, b in found:
        digest = blake2b(b" ".join(lines[a : b + 1]), digest_size=16).digest()
        if a > last_of.setdefault(digest, (a - 1, b))[1] or last_of[digest] == (a - 1, b):
            kept.append((a, b))
            digests.append(digest)
    return units, kept, np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _counted(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                some = [runs(t, least)[2][:, 0] for t in batch.column("text").slice(first, AT_ONCE).to_pylist() if t]
                digests, times = np.unique(np.concatenate([*some, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(times)], ["d1", "n"])

    return run


def _parts(batches: Iterator[pa.RecordBatch], least: int, repeated: np.ndarray) -> Iterator[tuple]:
    """(rows, number of the row and of the first unit of each repeated run, digests, units of each) some rows at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            row, unit, digests, units = [], [], [np.zeros((0, 2), np.int64)], []
            for i, text in enumerate(part.column("text").to_pylist()):
                if text:
                    own, found, both = runs(text, least)
                    some = np.flatnonzero(passes(repeated, both[:, 0].copy())).tolist()
                    row += [i] * len(some)
                    unit += [own[found[k][0]][0] for k in some]
                    digests.append(both[some])
                    units += [own[found[k][0] : found[k][1] + 1] for k in some]
            yield part, np.array(row, np.int64), np.array(unit, np.int64), np.concatenate(digests), units


def _ranked(least: int, repeated: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, unit, digests, _ in _parts(batches, least, repeated):
            at = pa.array(row)
            columns = [part.column("doc_id").take(at), part.column("th").take(at), pa.array(unit.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(d.copy()) for d in digests.T)], _names(RUN))

    return run


def _ids(doc_id: pa.Array, th: pa.Array, unit: np.ndarray, d1: np.ndarray) -> np.ndarray:
    ids = doc_id.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix(mix(mix(ids) + th.to_numpy(zero_copy_only=False).view(np.uint64)) + unit.view(np.uint64) + d1.view(np.uint64))


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = _ids(b.column("doc_id"), b.column("th"), b.column("unit").to_numpy().astype(np.int64), b.column("d1").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64))], ["id"])


def _seen(least: int, repeated: np.ndarray, firsts: np.ndarray) -> Callable:
    """Units of runs that surely repeat, each once, and the units of runs that may be the first of their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        for part, row, unit, digests, units in _parts(batches, least, repeated):
            at = pa.array(row)
            maybe = passes(firsts, _ids(part.column("doc_id").take(at), part.column("th").take(at), unit, digests[:, 0].copy())).tolist()
            gone: dict[tuple[int, int], tuple] = {}
            rows, out = [], []
            for i, own, one, first, (d1, d2) in zip(row.tolist(), units, maybe, unit.tolist(), digests.tolist(), strict=True):
                for u in own:
                    if one:
                        rows.append(i)
                        out.append((d1, d2, *u, first, True))
                    else:
                        gone[i, u[0]] = u
            for (i, _), u in gone.items():
                rows.append(i)
                out.append((None, None, *u, None, False))
            at = pa.array(rows, pa.int64())
            columns = [part.column(c).take(at) for c in ("doc_id", "th", "row")]
            columns += [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, _names(SEEN))

    return run


def _removed(rows: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, unit, start, end, n_words) from rows with doc_id, text, th and row."""
    counted = rows.select("text").mapInArrow(_counted(least), "d1 long, n long").groupBy("d1").agg(F.sum("n").alias("n"))
    repeated = settled(counted.filter("n > 1").select("d1"))
    bits = bitmap(repeated, F.col("d1"), bits_for(repeated.count()))
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "unit")).alias("first")
    texts = rows.select("doc_id", "th", "row", "text")
    first = settled(texts.mapInArrow(_ranked(least, bits), RUN).groupBy("d1", "d2").agg(rank).select("d1", "d2", "first.doc_id", "first.th", "first.unit"))
    ids = settled(first.mapInArrow(_with_ids, "id long"))
    seen = settled(texts.mapInArrow(_seen(least, bits, bitmap(ids, F.col("id"), bits_for(ids.count()))), SEEN))
    maybe = seen.filter("maybe")
    known = first.select("d1", "d2", F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), F.col("unit").alias("f_unit"))
    same = (maybe["d1"] == known["d1"]) & (maybe["d2"] == known["d2"])
    is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")) & (F.col("first") == F.col("f_unit"))
    columns = ["row", "doc_id", "unit", "start", "end", "n_words"]
    return seen.filter("not maybe").select(columns).unionByName(maybe.join(known, same).filter(~is_first).select(columns)).distinct()


def _keyed(documents: DataFrame, row: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), row.alias("row"))


def removed_units(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Units of runs that an earlier one repeats: doc_id, unit, start, end, n_words."""
    return _removed(_keyed(documents, F.monotonically_increasing_id()), min_words).drop("row")


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated runs cut out, columns unchanged, and `removed_spans`, the original [start, end) of
    each cut in code points. A document's spans are the only rows put together; rows are written once with a
    number, by which their spans come back to them."""
    rows = settled(documents.withColumn("_ln_row", F.monotonically_increasing_id()))
    cuts = _removed(_keyed(rows, F.col("_ln_row")), min_words).groupBy(F.col("row").alias("_ln_of")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed_spans")
    )
    joined = rows.join(cuts, rows["_ln_row"] == cuts["_ln_of"], "left").drop("_ln_row", "_ln_of")
    text = F.coalesce(F.col("text"), F.lit(""))
    # The pieces between the spans; the line break behind a removed unit goes with it.
    broken = lambda s: F.substring(text, (s["end"] + 1).cast("int"), F.lit(1)) == "\n"
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed_spans", lambda s: s["end"] + F.when(broken(s), 1).otherwise(0)))
    ends = F.concat(F.transform("removed_spans", lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    left = F.concat_ws("", F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))))
    return joined.withColumn("text", F.when(F.col("removed_spans").isNull(), F.col("text")).otherwise(left)).withColumn(
        "removed_spans", F.coalesce("removed_spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    )
