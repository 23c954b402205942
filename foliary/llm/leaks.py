"""Benchmark passages in documents: SimHash of item-sized windows, Hamming distances, exact verification.

The items are a stated query set: they are read in blocks of bounded size, and each block meets all
documents in one pass over the whole texts.

For every length (in words) that an item has, each window of that many words gets a 64-bit SimHash of
its words, which is compared with the fingerprints of all items of that length; at `RADIUS` no index of bit
blocks would leave any out. Those within `RADIUS` bits are verified on word shingles of five (the whole
sequence of shorter items),
weighted by how often they occur: sum of minima / sum of maxima >= `SIMILARITY`.

Windows that cannot pass are skipped before fingerprinting, without loss: a window of L words has
L - 4 shingles, and to reach the similarity with an item of L words it must hold at least
2s / (1 + s) of them at places whose shingle is in some item. A document shorter than an item is one
window.

Cases: null and empty texts and items match nothing; repeated rows are each reported; equal items are
reported each under its own id; a null item_id is kept as null; an empty table gives an empty result.
Overlapping windows of one item are one finding, the most similar and then the earliest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.words import SHINGLE, Words, chunks, mix, sequence_hash

SIMILARITY = 0.75
#: Words, not shingles, are fingerprinted. At the threshold a contiguous edit changes up to 14 % of the words. Of 3,000 random
#: pairs each with such an edit, inside or at the end, in items of 50, 100, 200 and 500 distinct words, none was further apart;
#: at 22 bits up to 0.03 % were, at 20 up to 0.27 %, at 15 up to 7.4 %.
RADIUS = 24
#: Distances computed at once.
PAIRS = 1 << 20
#: Characters of benchmark text that are matched in one pass over the documents.
BLOCK_CHARS = 8_000_000
FOUND = "doc_id long, item_id long, start long, end long, similarity double, hamming int"


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """For each bit, how many of the first i words have it set: (words + 1) x 64."""
    spread = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    bits = np.unpackbits(spread.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    np.cumsum(bits, axis=0, dtype=np.int32, out=out[1:])
    return out


def simhash(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of the `length` words at each start: per bit, the majority over the words' hashes."""
    ones = 2 * (sums[starts + length] - sums[starts]) > length
    return np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]


def window_shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one window and how often each occurs."""
    if len(hashes) < SHINGLE:
        return np.array([sequence_hash(hashes)], np.uint64), np.ones(1, np.int64)
    return np.unique(_grams(hashes), return_counts=True)


def _grams(hashes: np.ndarray) -> np.ndarray:
    view = object.__new__(Words)
    view.hashes = hashes
    return view.grams(SHINGLE)


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][bt]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class Blocks:
    """Fingerprints of items of one length, compared with blocks of others."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(print place, item place, distance) of every pair within the radius."""
        found, step = [], max(1, PAIRS // len(self.prints))
        for low in range(0, len(prints), step):
            distance = np.bitwise_count(prints[low : low + step, None] ^ self.prints[None, :])
            which, item = np.nonzero(distance <= RADIUS)
            found.append((which + low, item, distance[which, item]))
        which, item, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        return which, item, distance


class Index:
    """A block of items by length: ids, shingles and fingerprints; and all shingles as a sorted set."""

    def __init__(self, items: list[tuple[int | None, str]]):
        column = pa.array([text for _, text in items], pa.large_string())
        self.by_length: dict[int, list] = {}
        prints: dict[int, list] = {}
        every = [np.zeros(0, np.uint64)]
        for first, words in chunks(column):
            for i in range(len(words.offsets) - 1):
                own = words.hashes[words.first[i] : words.first[i + 1]]
                if len(own):
                    shingles = window_shingles(own)
                    every.append(shingles[0])
                    self.by_length.setdefault(len(own), []).append((items[first + i][0], shingles))
                    prints.setdefault(len(own), []).append(simhash(bit_sums(own), np.zeros(1, np.int64), len(own))[0])
        self.blocks = {length: Blocks(np.array(group, np.uint64)) for length, group in prints.items()}
        self.every = np.unique(np.concatenate(every))
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.every >> np.uint64(48)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are a shingle of some item."""
        out = np.zeros(len(hashes), bool)
        if len(self.every):
            maybe = np.flatnonzero(self.coarse[(hashes >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.every, hashes[maybe]), len(self.every) - 1)
            out[maybe] = self.every[place] == hashes[maybe]
        return out


def needed(window: int, item: int) -> int:
    """Fewest shared shingles with which a window of so many words can reach the similarity."""
    a, b = max(1, window - SHINGLE + 1), max(1, item - SHINGLE + 1)
    return int(np.ceil(SIMILARITY * (a + b) / (1 + SIMILARITY) - 1e-9))


def _starts(count: int, size: int, least: int, hits: np.ndarray) -> np.ndarray:
    """Starts of the windows of `size` words that hold at least `least` hits.

    A window at s holds the shingles at s .. s + size - 5, so from some hit not before s on, the
    `least`-th must lie in it.
    """
    near, far = hits[: len(hits) - least + 1], hits[least - 1 :] - (size - SHINGLE)
    opens, closes = np.maximum(far, 0), np.minimum(near, count - size)
    inside = np.zeros(count - size + 2, np.int64)
    some = opens <= closes
    np.add.at(inside, opens[some], 1)
    np.add.at(inside, closes[some] + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


class _Text:
    """A text that may hold a passage: its words' hashes and bounds in code points."""

    def __init__(self, row: int, words: Words, i: int):
        at, end = words.first[i], words.first[i + 1]
        self.row, self.hashes = row, words.hashes[at:end]
        points = np.cumsum((words.data[words.offsets[i] : words.offsets[i + 1]] & 0xC0) != 0x80)
        self.start = points[words.start[at:end] - words.offsets[i]] - 1
        self.end = points[words.end[at:end] - 1 - words.offsets[i]]


def _windows(hashes: np.ndarray, hits: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item length, starts, fingerprints) of one text's windows; hits: its places with a known shingle."""
    count, sums = len(hashes), None
    for length in index.by_length:
        size = min(length, count)
        least = needed(size, length)
        if least > max(1, size - SHINGLE + 1) or (size >= SHINGLE and len(hits) < least):
            continue
        starts = np.arange(count - size + 1) if size < SHINGLE else _starts(count, size, least, hits)
        if len(starts):
            sums = bit_sums(hashes) if sums is None else sums
            yield length, starts, simhash(sums, starts, size)


def _scan(batch: pa.RecordBatch, index: Index) -> list[tuple]:
    """(row, item_id, start, end, similarity, distance) of every finding in a batch of texts.

    The windows of all texts of the batch meet the items of their length at once.
    """
    short = any(length < SHINGLE for length in index.by_length)
    texts: list[_Text] = []
    windows: dict[int, list[tuple]] = {}
    for first, words in chunks(batch.column("text")):
        known = np.flatnonzero(index.known(words.grams(SHINGLE)))
        text = np.searchsorted(words.first, known, "right") - 1
        inside = known + SHINGLE <= words.first[text + 1]
        known, text = known[inside], text[inside]
        rows = np.flatnonzero(np.diff(words.first) > 0) if short else np.unique(text)
        for i in rows.tolist():
            at, end = words.first[i], words.first[i + 1]
            hits = known[np.searchsorted(text, i) : np.searchsorted(text, i, "right")] - at
            own = list(_windows(words.hashes[at:end], hits, index))
            for length, starts, prints in own:
                windows.setdefault(length, []).append((np.full(len(starts), len(texts)), starts, prints))
            if own:
                texts.append(_Text(first + i, words, i))
    found = []
    for length, parts in windows.items():
        which, starts, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
        for at, place, distance in zip(*(x.tolist() for x in index.blocks[length].within(prints)), strict=True):
            text, start, (item_id, shingles) = int(which[at]), int(starts[at]), index.by_length[length][place]
            own = texts[text].hashes
            size = min(length, len(own))
            value = weighted_similarity(window_shingles(own[start : start + size]), shingles)
            if value >= SIMILARITY:
                found.append((text, length, place, start, size, value, distance, item_id))
    found.sort(key=lambda x: (x[:3], -x[5], x[3]))
    best: list[tuple] = []
    group, taken = None, []
    for x in found:
        if x[:3] != group:
            group, taken = x[:3], []
        if all(x[3] >= end or x[3] + x[4] <= start for start, end in taken):
            taken.append((x[3], x[3] + x[4]))
            text = texts[x[0]]
            best.append((text.row, x[7], int(text.start[x[3]]), int(text.end[x[3] + x[4] - 1]), x[5], x[6]))
    return best


def _finder(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
        for batch in batches:
            found = _scan(batch, index)
            columns = [pa.array([x[k + 1] for x in found], kind) for k, kind in enumerate(kinds)]
            ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *columns], [field.split()[0] for field in FOUND.split(", ")])

    return find


def _sieve(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[x[0] for x in _scan(batch, index)]] = False
            yield batch.filter(pa.array(clean))

    return sieve


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Index]:
    """The items block by block; the driver holds one block, whose size no table decides."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("text").rlike(r"[^\x20\x09-\x0D]")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // block_chars)
    for part in range(parts):
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Index([tuple(row) for row in block.collect()])


def findings(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, similarity, hamming) of every benchmark passage in every document.

    Start and end are code points of the text. Each block of items is one pass over the documents,
    without a shuffle.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = documents.sparkSession.createDataFrame([], FOUND)
    for index in _blocks(benchmark, block_chars):
        out = out.unionByName(texts.mapInArrow(_finder(index), FOUND))
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a benchmark passage, columns unchanged; rows are dropped where they stand."""
    for index in _blocks(benchmark, block_chars):
        documents = documents.mapInArrow(_sieve(index), documents.schema)
    return documents
