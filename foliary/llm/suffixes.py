"""Substring dedup over a suffix array that is built column-wise for many strings at once.

A byte goes when a string of `WINDOW` bytes covers it that also starts earlier: in a smaller doc_id, or
earlier in the same document. All windows of all texts are judged, on the input.

Windows are dealt to tasks by content. Of the grams of `GRAM` bytes in a window the one with the least hash (of
equal ones the leftmost) is the window's anchor. Equal windows have equal anchors, and neighbouring windows
mostly share theirs: such a run of windows is one string of less than 2 * WINDOW bytes. Then

1. hashes of anchors are counted; only runs whose anchor stands twice or more go on (a bit map, sized by their
   number up to 16 MB; what passes by chance is dropped at 2);
2. equal strings of an anchor are one string with the earliest rank, found by digest and never shuffled as text.
   The texts are read once more: a run that is not in the map of these first ones is a repeat for certain, and
   neighbours among them leave the task as one; the few others are told apart by a join. Anchors
   with a single string are done, as equal windows lie at equal places beside their anchor;
3. the strings of the other anchors form collections of some `PART_BYTES`. An anchor with more than `HOT`
   different strings is split first: its windows go to two longer grams, one to the left and one to the right, and
   so on up to the whole window, so that neither a common line nor a large family of copies fills one task;
4. within a collection, neighbouring windows at one distance from their anchor share a longer gram. Where no other string
   of the anchor has it, none of them repeats, and strings are shortened to what is left;
5. each collection is sorted column-wise: in every round one symbol of each string is inserted, from the
   right end on, into the Burrows-Wheeler transform of all suffixes so far, and the common prefixes of new
   neighbours follow from those of the round before by range minima. Transform and common prefixes are a file in the
   session's shared folder, read and written in sequence once a round; the rows of each symbol are kept beside it in memory.
   Rows that share WINDOW bytes with the row before are equal windows; all but the earliest are repeats;
6. repeated windows go back to their texts as runs, by doc_id and hash of the text (32 bits beside the id), and are cut out.

Cases: a null or empty text has no window. Rows with one doc_id and one text are the same document, so neither
repeats the other; rows with one doc_id and different texts are documents in the order of their texts' hash; a null
doc_id comes last. An empty table gives an empty result; further columns are ignored by `report`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.bitmaps import bitmap, bits_for, passes
from foliary.llm.tokens import _opened as opened
from foliary.llm.words import _BACK, _STEP, RAW_BYTE, _powers, buffers, mix, span_hashes
from foliary.operators.sizing import new_folder, settled

WINDOW, GRAM = 100, 40
#: Bytes of strings in one collection, and the most different strings of an anchor in it.
PART_BYTES, HOT = 1 << 21, 1_000
#: Neighbouring windows that are looked at together before the sort.
TOGETHER = 16
#: Bytes of text handled at once; positions inside them take 20 bits.
CHUNK_BYTES = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
#: Rows of a transform that are numbered in 24 bits; with more, they take 40.
_NARROW_ROWS = 1 << 24
_GRAM_BYTE = np.random.Generator(np.random.PCG64(20_251_113)).integers(1, 1 << 63, 256, dtype=np.uint64)

#: `place` is the hash of the text (32 bits) and the position in it (31 bits).
RUN = "doc_id long, place long, key long, digest long"
SEEN = "doc_id long, place long, n int, gram int, key long, digest long, maybe boolean, string binary"
STRING = "doc_id long, place long, n int, gram int, key long, digest long, string binary"
SPAN = "doc_id long, place long, n int"
PLACE_BITS = 31


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on."""
    count = max(0, len(data) - size + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_GRAM_BYTE[data] * _powers(_STEP, len(data)), out=total[1:])
    return mix((total[size : size + count] - total[:count]) * _powers(_BACK, count)[:count])


def runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start in the data, windows, start of the anchor, key) of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, none.view(np.uint64)
    hashes = gram_hashes(data, gram)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide, width = window - gram + 1, 1
    while 2 * width <= wide:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    anchor = (least & _PLACE).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    at = np.flatnonzero(np.arange(window, len(anchor) + window) <= ends)
    if not len(at):
        return none, none, none, none, none.view(np.uint64)
    opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]])]))
    start, count = at[opens], np.diff(np.append(opens, len(at)))
    text = np.searchsorted(offsets, start, "right") - 1
    # The least of many hashes has leading zeros; mixed again, its bits are spread for the maps.
    return text, start, count, anchor[start], mix(hashes[anchor[start]] + np.uint64(_STEP))


def _ids(doc_id: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.view(np.uint64) * np.uint64(_STEP)) + place.view(np.uint64))


class _Chunk:
    """The runs of some rows; positions count from the start of each text."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, shift: int):
        self.data = data
        text, self.at, self.n, anchor, self.key = runs(data, offsets)
        self.row = rows[text]
        self.gram = anchor - self.at
        self.doc_id = batch.column("doc_id").take(pa.array(self.row))
        self.place = batch.column("text_place").to_numpy()[self.row] + self.at - offsets[text] + shift

    def digests(self, some: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, self.at[some], self.at[some] + self.n[some] + WINDOW - 1).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Whole texts together up to CHUNK_BYTES; a longer text in slices that share their last windows' bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
            size = int(offsets[last] - offsets[row])
            for shift in range(0, max(size, 1), CHUNK_BYTES) if last == row + 1 else (0,):
                stop = min(size, shift + CHUNK_BYTES + WINDOW - 1) if last == row + 1 else size
                bounds = offsets[row : last + 1] - offsets[row] if last > row + 1 else np.array([0, stop - shift])
                yield _Chunk(batch, np.arange(row, last), data[offsets[row] + shift : offsets[row] + stop], bounds, shift)
            row = last


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches):
        keys, times = np.unique(chunk.key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], ["h", "n"])


def _runs(repeated: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            some = np.flatnonzero(passes(repeated, c.key))
            longs = [pa.array(x) for x in (c.place[some], c.key[some].view(np.int64), c.digests(some))]
            yield pa.RecordBatch.from_arrays([c.doc_id.take(pa.array(some)), *longs], _names(RUN))

    return run


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = _ids(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), batch.column("place").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), batch.column("several")], ["id", "several"])


def _seen(repeated: np.ndarray, firsts: np.ndarray, several: np.ndarray) -> Callable:
    """Runs that are surely repeats, neighbours joined, and those that may be the first of their string; these with
    the string itself if their anchor may have several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for c in _chunks(batches):
            some = np.flatnonzero(passes(repeated, c.key))
            ids = _ids(c.doc_id.fill_null(-1).to_numpy(zero_copy_only=False)[some], c.place[some])
            maybe = passes(firsts, ids)
            sure = some[~maybe]
            opens = np.ones(len(sure), bool)
            opens[1:] = (c.row[sure][1:] != c.row[sure][:-1]) | (c.place[sure][1:] != c.place[sure][:-1] + c.n[sure][:-1])
            at = np.flatnonzero(opens)
            total = np.add.reduceat(c.n[sure], at) if len(at) else np.zeros(0, np.int64)
            none = [pa.nulls(len(at), k) for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [c.doc_id.take(pa.array(sure[at])), pa.array(c.place[sure[at]]), pa.array(total.astype(np.int32)), *none[3:6], pa.array(np.zeros(len(at), bool)), none[7]],
                _names(SEEN),
            )
            some, ids = some[maybe], ids[maybe]
            raw, wanted = c.data.tobytes(), passes(several, ids).tolist()
            strings = [raw[a : a + n + WINDOW - 1] if w else None for a, n, w in zip(c.at[some].tolist(), c.n[some].tolist(), wanted, strict=True)]
            columns = [c.place[some], c.n[some], c.gram[some], c.key[some].view(np.int64), c.digests(some), np.ones(len(some), bool), strings]
            yield pa.RecordBatch.from_arrays(
                [c.doc_id.take(pa.array(some)), *[pa.array(x, k) if x is strings else pa.array(x).cast(k) for x, k in zip(columns, kinds[1:], strict=True)]],
                _names(SEEN),
            )

    return run


def _longer(gram: int) -> Callable:
    """Splits runs by grams that reach half of what is left of the window further, to the left and to the right."""
    step = (WINDOW - gram + 1) // 2

    def hashed(text: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left = min(r["n"], max(0, r["gram"] - step + 1))  # windows that hold the gram and `step` bytes before it
                for first, n, place in ((0, left, r["gram"] - step), (left, r["n"] - left, r["gram"])):
                    if n > 0:
                        string = r["string"][first : first + n + WINDOW - 1]
                        key = hashed(r["string"][place : place + gram + step])
                        out.append(r | {"place": r["place"] + first, "n": n, "gram": place - first, "key": key, "digest": hashed(string), "string": string})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return run


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")


def _same_place(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["place"] == b["place"])


def _firsts(runs_: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """The earliest run of each string: doc_id, place, key, digest, and whether its anchor has `several` strings."""
    first = settled(runs_.groupBy("key", "digest").agg(F.min(_rank()).alias("first"), *[F.max(c).alias(c) for c in carried]))
    many = first.groupBy("key").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1").select("key", F.lit(True).alias("several"))
    return first.join(many, "key", "left").select(
        "first.doc_id", "first.place", "key", "digest", F.coalesce("several", F.lit(False)).alias("several"), *carried
    )


def _split_hot(strings: DataFrame, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(collections without an anchor of more than `hot` strings, runs found to repeat on the way)."""
    done, copies, gram = [], [], GRAM
    while True:
        many = settled(strings.groupBy("key").agg(F.count(F.lit(1)).alias("strings")).filter(F.col("strings") > hot).select("key"))
        if gram == WINDOW or many.isEmpty():
            return [*done, strings], copies
        done.append(strings.join(many, "key", "left_anti"))
        halves = settled(strings.join(many, "key", "left_semi").select(_names(STRING)).mapInArrow(_longer(gram), STRING))
        gram += (WINDOW - gram + 1) // 2
        first = settled(_firsts(halves, ("n", "gram", "string")))
        copies.append(halves.join(first, _same_place(halves, first) & (halves["key"] == first["key"]), "left_anti").select(_names(SPAN)))
        strings = settled(first.filter("several").select(_names(STRING)))


class Columns:
    """The rows of one collection, a symbol of the transform and a common prefix each, as a file that each round writes anew."""

    def __init__(self, folder: str):
        self.files, root = opened(folder)
        self.files.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}"
        self.round = -1

    def write(self, rows: np.ndarray) -> None:
        with self.files.open_output_stream(f"{self.path}-{self.round + 1}") as out:
            out.write(rows.data)
        self.clear()
        self.round += 1

    def read(self) -> np.ndarray:
        with self.files.open_input_stream(f"{self.path}-{self.round}") as source:
            return np.frombuffer(source.read(), np.uint16)

    def clear(self) -> None:
        if self.round >= 0:
            self.files.delete_file(f"{self.path}-{self.round}")


def sorted_suffixes(strings: list[bytes], columns: Columns, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, common bytes with the row before up to `depth`) of all suffixes in order.

    Row k of the transform is the symbol before the k-th suffix, 0 where the string begins. The new suffixes of
    a round are the old ones with their symbol put before: their places are those of a stable sort of the
    symbols (behind the empty suffixes), and two of them with one symbol have one byte more in common than
    the least of the common prefixes between the two old rows. That sort is not done anew: `stands` has the rows
    of each symbol, symbol by symbol, old rows move on in it by the new ones before them, and new ones are put between.
    """
    m, sizes = len(strings), np.array([len(s) for s in strings])
    # Column j has each string's j-th symbol from its right end; symbols are bytes plus one (UTF-8 has no byte above 0xF4).
    symbols = np.zeros((int(sizes.max()) + 1, m), np.uint8)
    for i, s in enumerate(strings):
        symbols[: len(s), i] = np.frombuffer(s, np.uint8)[::-1] + 1
    size = int(sizes.sum()) + m
    kind, bits = (np.uint32, 24) if size <= _NARROW_ROWS else (np.uint64, 40)
    inside = kind((1 << bits) - 1)
    # A row of the file is a symbol, with the common prefix in the upper byte.
    columns.write(symbols[0].astype(np.uint16))
    active = np.argsort(symbols[0], kind="stable")
    stands, spare, moves = np.empty(size, kind), np.empty(size, kind), np.empty(size, kind)
    index, kept = np.empty(size, np.int64), np.empty(size, bool)
    stands[:m] = (symbols[0][active].astype(kind) << kind(bits)) | active.astype(kind)
    at = np.arange(m)
    for j in range(1, len(symbols)):
        rows = columns.read()
        standing = stands[: len(rows)]
        ended = int(np.searchsorted(standing, kind(1 << bits)))
        # The strings that go on, in the order of their old rows in `stands`, and so of their new rows.
        going = symbols[j - 1][active] > 0
        active, new = active[going], at[going] + (m - ended)
        symbol = symbols[j][active]
        total = len(rows) + len(new)
        old = kept[:total]
        old[:] = True
        old[new] = False
        grown = np.empty(total, np.uint16)
        grown[old] = rows
        grown[new] = symbol
        # Common prefixes change at the new rows and at the rows after them.
        touched = np.repeat(new, 1 + (np.diff(new, append=total) > 1))
        touched[1:] += touched[1:] == touched[:-1]
        grown[touched] &= 255
        touched = touched[touched > m]
        below, above = standing[touched + (ended - m - 1)], standing[touched + (ended - m)]
        same = below >> kind(bits) == above >> kind(bits)
        touched, below, above = touched[same], (below[same] & inside).astype(np.int64), (above[same] & inside).astype(np.int64)
        if len(touched):
            # From the last range to the first, so that what reduceat does between two ranges is one element.
            down = np.argsort(-below, kind="stable")
            edges = np.stack([below[down] + 1, above[down] + 1], axis=1).ravel()
            least = np.minimum.reduceat(np.append(rows, np.uint16(0xFFFF)), edges)[::2] >> np.uint16(8)
            grown[touched[down]] |= np.minimum(least + np.uint16(1), np.uint16(depth)) << np.uint16(8)
        columns.write(grown)
        # An old row moves on by the new rows before it.
        before = np.diff(new - np.arange(len(new)), prepend=0, append=len(rows))
        steps = np.repeat(np.arange(len(new) + 1, dtype=kind), before)
        np.bitwise_and(standing, inside, out=index[: len(rows)])
        np.take(steps, index[: len(rows)], out=moves[: len(rows)], mode="clip")
        standing += moves[: len(rows)]
        order = np.argsort(symbol, kind="stable")
        active = active[order]
        added = (symbol[order].astype(kind) << kind(bits)) | new[order].astype(kind)
        at = np.searchsorted(standing, added) + np.arange(len(added))
        old[:] = True
        old[at] = False
        spare[:total][old] = standing
        spare[at] = added
        stands, spare = spare, stands
    rows = columns.read()
    columns.clear()
    transform, common = (rows & 255).astype(np.uint8), (rows >> 8).astype(np.uint8)
    ended = int((transform == 0).sum())
    row = np.empty(len(rows), np.int64)
    row[stands[: len(rows)] & inside] = np.arange(m - ended, m - ended + len(rows))
    of, length = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    place, own = np.arange(m), np.arange(m)
    for j in range(len(symbols)):
        of[place], length[place] = own, j
        own = own[symbols[j][own] > 0]
        place = row[place[transform[place] > 0]]
    return of, length, common


def repeated_windows(strings: list[bytes], ranks: np.ndarray, columns: Columns) -> np.ndarray:
    """(string, first window, windows) of the runs of windows that an earlier equal one repeats; `ranks` has the
    rows (null id, doc_id, place) of each string."""
    of, length, common = sorted_suffixes(strings, columns)
    sizes = np.array([len(s) for s in strings])
    group = np.cumsum(common < WINDOW)
    whole = np.flatnonzero(length >= WINDOW)
    of, first, group = of[whole], sizes[of[whole]] - length[whole], group[whole]
    order = np.lexsort((ranks[2][of] + first, ranks[1][of], ranks[0][of], group))
    of, first, group = of[order], first[order], group[order]
    later = np.concatenate([[False], group[1:] == group[:-1]])
    order = np.lexsort((first[later], of[later]))
    of, first = of[later][order], first[later][order]
    opens = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (first[1:] != first[:-1] + 1)])[: len(of)])
    return np.stack([of[opens], first[opens], np.diff(opens, append=len(of))], axis=1)


def shortened(strings: list[bytes], key: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(string, first window, bytes) from the first to the last window of each string that another one may have too.

    Equal windows have one key and stand at one distance from its gram; windows at neighbouring distances have
    their middle in common. A string goes where no other string of the key has that middle (by hash, which may keep too much).
    """
    sizes = np.array([len(s) for s in strings])
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(strings), np.uint8)
    low = np.arange(GRAM - WINDOW, 1, TOGETHER)
    high = np.minimum(0, low + TOGETHER - 1)
    begin, end = np.maximum(0, gram[:, None] + low), np.minimum((sizes - WINDOW)[:, None], gram[:, None] + high)
    string, group = np.nonzero(begin <= end)
    at = starts[string] + gram[string]
    hashes = span_hashes(data, at + high[group], at + low[group] + WINDOW) + mix(key[string].view(np.uint64) + group.astype(np.uint64))
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    string, group = string[times[which] > 1], group[times[which] > 1]
    first, last = sizes.copy(), np.full(len(strings), -1)
    np.minimum.at(first, string, begin[string, group])
    np.maximum.at(last, string, end[string, group])
    kept = np.flatnonzero(last >= 0)
    return kept, first[kept], [strings[i][a : b + WINDOW] for i, a, b in zip(kept.tolist(), first[kept].tolist(), last[kept].tolist(), strict=True)]


def _collection(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        kept, begin, strings = shortened(table["string"].to_pylist(), table["key"].to_numpy(), table["gram"].to_numpy().astype(np.int64))
        if not strings:
            return
        table = table.select(["doc_id", "place"]).take(pa.array(kept))
        ids = table["doc_id"]
        ranks = np.stack([ids.is_null().to_numpy(), ids.fill_null(0).to_numpy(), table["place"].to_numpy() + begin]).astype(np.int64)
        found = repeated_windows(strings, ranks, Columns(folder))
        string, first, n = found.T
        yield pa.RecordBatch.from_arrays(
            [ids.combine_chunks().take(pa.array(string)), pa.array(ranks[2][string] + first), pa.array(n.astype(np.int32))], _names(SPAN)
        )

    return run


def _text_place() -> Column:
    """The place of a text's first byte."""
    return F.shiftleft(F.hash("text").cast("long").bitwiseAND(F.lit((1 << 32) - 1)), PLACE_BITS)


def repeated_runs(documents: DataFrame, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, place, n): runs of n windows from this place on that all stand earlier too."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.octet_length("text") >= WINDOW
    ).withColumn("text_place", _text_place())
    counted = rows.mapInArrow(_keys, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    repeated = settled(counted)
    repeated_bits = bitmap(repeated, F.col("h"), bits_for(repeated.count()))
    first = settled(_firsts(rows.mapInArrow(_runs(repeated_bits), RUN)))
    ids = settled(first.select("doc_id", "place", "several").mapInArrow(_with_ids, "id long, several boolean"))
    several = ids.filter("several")
    bits = [bitmap(x, F.col("id"), bits_for(x.count())) for x in (ids, several)]
    seen = settled(rows.mapInArrow(_seen(repeated_bits, *bits), SEEN))
    sure, maybe = seen.filter("not maybe").select(_names(SPAN)), seen.filter("maybe")
    keys = ["doc_id", "place"]
    known = settled(maybe.join(first.select(*keys, "several"), _same_place(maybe, first), "left").select(*[maybe[c] for c in _names(STRING)], "several"))
    copies = known.filter("several is null").select(_names(SPAN))
    strings = settled(known.filter("several").select(_names(STRING)).dropDuplicates(["key", "digest"]))
    parts, more = _split_hot(strings, hot)
    dealt = settled(reduce(DataFrame.unionByName, parts).select(*keys, "gram", "key", "string"))
    size = dealt.agg(F.sum(F.octet_length("string"))).first()[0] or 0
    folder = new_folder(documents.sparkSession, "columns")
    found = dealt.repartition(max(1, -(-size // part_bytes)), "key").mapInArrow(_collection(folder), SPAN)
    return reduce(DataFrame.unionByName, [sure, copies, *more, settled(found)])


def _cut(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            data, offsets = buffers(part.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, spans in enumerate(part.column("spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 2, np.int32)
                for s in spans or ():
                    edge[s["start"]] += 1
                    edge[s["start"] + s["n"] + WINDOW - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                opens = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
                kept = text[~gone[: len(text)]].tobytes()
                values = (len(text), len(text) - len(kept), len(opens), hashlib.sha256(kept).hexdigest(), kept if keep else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns[: 5 + keep], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep])


def deduplicated(documents: DataFrame, keep: bool = True, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and with `keep` the bytes that stay (`kept`,
    which may begin or end inside a character)."""
    inside = F.lit((1 << PLACE_BITS) - 1)
    spans = repeated_runs(documents, hot, part_bytes).groupBy(
        F.col("doc_id").alias("_id"), (F.col("place") - F.col("place").bitwiseAND(inside)).alias("_place")
    ).agg(F.collect_list(F.struct(F.col("place").bitwiseAND(inside).alias("start"), "n")).alias("spans"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(spans, (_text_place() == F.col("_place")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    return joined.select("doc_id", "text", "spans").mapInArrow(lambda batches: _cut(batches, keep), schema)


def report(documents: DataFrame) -> DataFrame:
    """Numbers and digest of what stays of each document."""
    return deduplicated(documents, keep=False)
