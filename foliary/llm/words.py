"""Words and word shingles of whole texts, hashed a batch of rows at a time with numpy.

A word is a maximal run of bytes other than blank and tab to carriage return; A-Z count as a-z.
Texts are UTF-8, so no other character contains these bytes. Hashes are 64 bits wide and depend on
the words alone, not on the white space between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that its arrays stay in a core's cache; one longer text is handled alone.
CHUNK_BYTES = 1 << 18
SHINGLE = 5

_generator = np.random.Generator(np.random.PCG64(20_240_501))
RAW_BYTE = _generator.integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED_BYTE = RAW_BYTE.copy()
FOLDED_BYTE[65:91] = FOLDED_BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SHIFTS = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(64)], dtype=np.uint64)


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    out = np.full(max(count, 1), base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = RAW_BYTE) -> np.ndarray:
    """Hash of each span of bytes; the same bytes anywhere have the same hash."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _powers(_STEP, len(data)), out=total[1:])
    sums = total[end] - total[start]
    return mix(sums * _powers(_BACK, len(data) + 1)[start] + (end - start).astype(np.uint64))


class Words:
    """The words of some texts: `hashes`, byte bounds `start` and `end`, and `first[i]:first[i+1]` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = word[edges]
        closes[edges - 1] = word[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = span_hashes(data, self.start, self.end, FOLDED_BYTE)

    def grams(self, size: int) -> np.ndarray:
        """Hash of the `size` words that begin at each word, over text borders too."""
        count = max(0, len(self.hashes) - size + 1)
        out = np.full(count, size, dtype=np.uint64)
        for j in range(size):
            out += self.hashes[j : j + count] * _SHIFTS[j + 1]
        return mix(out)

    def shingle_rows(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """All shingles with repeats, text by text, and where each text's begin: a text of fewer than
        `size` words has one shingle, its whole sequence; one without words has none."""
        counts = np.diff(self.first)
        lengths = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(bounds[-1], np.uint64)
        full = counts >= size
        if full.any():
            grams = self.grams(size)
            at = np.repeat(self.first[:-1][full] - bounds[:-1][full], lengths[full])
            slots = np.repeat(full, lengths)
            index = np.flatnonzero(slots)
            out[index] = grams[index + at]
        for i in np.flatnonzero((counts > 0) & ~full):
            out[bounds[i]] = sequence_hash(self.hashes[self.first[i] : self.first[i + 1]])
        return out, bounds


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole sequence of words, equal to the gram of that size."""
    total = np.array([len(hashes)], dtype=np.uint64)
    for j, x in enumerate(hashes):
        total += np.array([x], dtype=np.uint64) * _SHIFTS[j + 1]
    return mix(total)[0]


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def stripped(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each word without up to three marks on either side; words of marks alone go."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start += (start < end) & _PUNCTUATION[words.data[np.minimum(start, len(words.data) - 1)]]
        end -= (start < end) & _PUNCTUATION[words.data[end - 1]]
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.first))
    some = start < end
    return text[some], start[some], end[some]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the byte offsets of its rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, Words]]:
    """The column's words in pieces of whole rows, about `limit` bytes and at most `most` rows each, with the first row's number."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, min(row + most, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, Words(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last
