"""Phrase collocations of two and three words by top-order marginalisation.

Every word of a piece opens one window of three words, padded with empty words at the piece's end: the
words beside their two leads. Only these longest windows are counted. One ROLLUP over their counts then
sums each window into its shorter prefixes, which gives every word and word pair its exact number of
occurrences, since each occurrence opens exactly one window, and the words of each language as well.
No n-gram table beside that one is made.

A window is padded already from its first pair that stands fewer than `least` times, as no phrase with
that pair can be a candidate, and so is the last word of such a triple. They are known from two passes that
count hashes, of pairs and then of triples of frequent pairs: the frequent ones set bits of a map, sized by
their number up to 16 MB; what passes by chance is counted for nothing and dropped with its sum. Words of a chunk of text are told apart by 64-bit hashes.

A phrase's parts stand at least as often as the phrase, so everything below `least` occurrences is dropped
once the sums are known. Scores are whole numbers in decimals of 38 digits, exact while a count is below
10^15. Of each language the best rows are taken in two steps, first in buckets of candidates by hash, so
that no task ranks a whole language.

Cases: a null text is empty; a null language counts as `und`; a piece of one word counts for that word; an
empty table gives an empty result; repeated rows count as often as they stand; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm.bitmaps import bitmap, bits_for, passes
from foliary.llm.words import CHUNK_BYTES, FOLDED_BYTE, buffers, mix, span_hashes
from foliary.operators.sizing import settled

LEAST, TOP = 10, 2000
#: A candidate goes when a longer one that holds it stands at least this many per cent as often.
INSIDE_PERCENT = 50
#: Buckets in which a language's candidates are ranked before its last ranking.
BUCKETS = 32
#: 0 inside a word, 1 between words, 2 where a piece ends.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class Windows:
    """The padded windows of some texts: `word`, `second` and `third` hold word numbers, `second` and `third`
    -1 where the piece has ended; `text` is the row of each. `words` are the distinct words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        inside = kind == 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        hashes = span_hashes(data, start, end, FOLDED_BYTE)
        known, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        raw = _FOLD[data].tobytes()
        self.words = [raw[x:y].decode() for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        self.hashes = known
        self.text = np.searchsorted(offsets, start, "right") - 1
        piece = np.cumsum(kind == 2)[start]
        follows = np.zeros(len(start) + 1, bool)  # whether the next word belongs to the same piece
        follows[:-2] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1]) if len(start) else []
        lead = np.append(self.word, [-1, -1])
        self.second = np.where(follows[:-1], lead[1:-1], -1)
        self.third = np.where(follows[:-1] & follows[1:], lead[2:], -1)

    def pairs(self, langs: np.ndarray) -> np.ndarray:
        """Hash of (lang, word, second) of each window."""
        return mix(self.hashes[self.word] * _ODD[0] + self.hashes[self.second] * _ODD[1] + langs[self.text])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, Windows]]:
    """(langs, their hashes, windows) of some rows at a time."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        names = batch.column("lang").dictionary_encode()
        own = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()]
        langs = np.array(own, np.uint64)[names.indices.to_numpy()] if own else np.zeros(0, np.uint64)
        row, rows = 0, batch.num_rows
        while row < rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
            windows = Windows(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
            if len(windows.word):
                yield batch.column("lang").slice(row, last - row), langs[row:last], windows
            row = last


def _kept(windows: Windows, langs: np.ndarray, pairs: np.ndarray, triples: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a window's pair may stand often enough, whether its triple may, hash of the triple)."""
    two = passes(pairs, windows.pairs(langs)) & (windows.second >= 0)
    three = two & np.append(two[1:], False) & (windows.third >= 0)
    hashes = mix(windows.pairs(langs) + windows.hashes[windows.third] * _ODD[2])
    return two, three if triples is None else three & passes(triples, hashes), hashes


def _phrase_hashes(pairs: np.ndarray | None) -> Callable:
    """Hashes of pairs with their counts; with the map of frequent pairs, of the triples that consist of such."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, langs, windows in _chunked(batches):
            if pairs is None:
                own = windows.pairs(langs)[windows.second >= 0]
            else:
                _, three, own = _kept(windows, langs, pairs, None)
                own = own[three]
            hashes, times = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], ["h", "n"])

    return run


def _windows(pairs: np.ndarray, triples: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, langs, windows in _chunked(batches):
            two, three, _ = _kept(windows, langs, pairs, triples)
            second, third = np.where(two, windows.second, -1), np.where(three, windows.third, -1)
            padded = np.append(windows.hashes, np.uint64(0))  # -1 is the pad
            key = mix(windows.hashes[windows.word] * _ODD[0] + padded[second] * _ODD[1] + padded[third] * _ODD[2] + langs[windows.text])
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            words = pa.array([*windows.words, ""])
            columns = [words.take(pa.array(c[first] % len(words))) for c in (windows.word, second, third)]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(windows.text[first])), *columns, pa.array(times)], ["lang", "w1", "w2", "w3", "n"]
            )

    return run


def _frequent(rows: DataFrame, pairs: np.ndarray | None, least: int) -> np.ndarray:
    """The map of the pairs or triples that stand at least `least` times."""
    counted = rows.mapInArrow(_phrase_hashes(pairs), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    frequent = settled(counted.filter(F.col("n") >= least).select("h"))
    return bitmap(frequent, F.col("h"), bits_for(frequent.count()))


def window_counts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, n): the padded windows of three words with their counts, added up a chunk of text at
    a time. A window is padded from the first pair on that cannot stand `least` times, and so is the last word of a
    triple that cannot."""
    rows = documents.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    pairs = _frequent(rows, None, least)
    triples = _frequent(rows, pairs, least)
    return rows.mapInArrow(_windows(pairs, triples), "lang string, w1 string, w2 string, w3 string, n long")


def phrase_counts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, size, n) of every phrase of one to three words that stands `least` times, and with
    size 0 the words of each language."""
    sums = documents.sparkSession.sql(
        "SELECT lang, w1, w2, w3, 3 - bit_count(grouping_id()) AS size, sum(n) AS n FROM {windows} GROUP BY lang, ROLLUP(w1, w2, w3)",
        windows=window_counts(documents, least),
    )
    # A padded window that is summed to its full length, or to the pad of its second word, is no phrase.
    padded = ((F.col("size") == 3) & (F.col("w3") == "")) | ((F.col("size") == 2) & (F.col("w2") == ""))
    return sums.filter(~padded & ((F.col("n") >= least) | (F.col("size") == 0)))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact."""
    wide = lambda c: c.cast("decimal(17,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    above = (million * (wide(a) * wide(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", above, (wide(left) * wide(right)).cast("decimal(38,0)"))


def scored_candidates(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, size, a, l, r, score) of every phrase of two and three words, at its lowest-scoring cut."""
    ones = counts.filter("size = 1").select("lang", F.col("w1").alias("x"), F.col("n").alias("of"))
    twos = counts.filter("size = 2").select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("n").alias("of"))

    def with_part(frame: DataFrame, part: DataFrame, words: list[str], name: str) -> DataFrame:
        keys = ["x", "y"][: len(words)]
        renamed = part.select("lang", *[F.col(k).alias(w) for k, w in zip(keys, words, strict=True)], F.col("of").alias(name))
        return frame.join(renamed, ["lang", *words])

    pairs = counts.filter("size = 2").select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "size", F.col("n").alias("a"))
    pairs = with_part(with_part(pairs, ones, ["w1"], "l"), ones, ["w2"], "r")
    pairs = pairs.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    triples = counts.filter("size = 3").select("lang", "w1", "w2", "w3", "size", F.col("n").alias("a"))
    for part, words, name in ((ones, ["w1"], "l1"), (twos, ["w2", "w3"], "r1"), (twos, ["w1", "w2"], "l2"), (ones, ["w3"], "r2")):
        triples = with_part(triples, part, words, name)
    cuts = [
        F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        for k in (1, 2)
    ]
    lowest = triples.withColumn("cut", F.least(*cuts)).select("lang", "w1", "w2", "w3", "size", "a", "cut.l", "cut.r", "cut.score")
    return pairs.select(lowest.columns).unionByName(lowest).filter(F.col("a") >= least)


def outside_longer(candidates: DataFrame, counts: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Candidates without the pairs that stand inside a triple at least `percent` per cent as often."""
    holds = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("w1", "w2"), ("w2", "w3"))]
    triples = counts.filter("size = 3").select(F.col("lang").alias("of"), "n", F.inline(F.array(*holds)))
    inside = triples.groupBy("of", "x", "y").agg(F.max("n").alias("most"))
    same = (F.col("size") == 2) & (F.col("lang") == F.col("of")) & (F.col("w1") == F.col("x")) & (F.col("w2") == F.col("y"))
    held = candidates.join(inside, same, "left")
    return held.filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).select(candidates.columns)


def best_by_group(rows: DataFrame, group: str, order: list[Column], top: int, buckets: int = BUCKETS) -> DataFrame:
    """The first `top` rows of each group with their `rank`; ranked in buckets by hash first."""
    dealt = rows.withColumn("_bucket", F.pmod(F.hash(*rows.columns), F.lit(buckets)))
    near = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))).filter(F.col("rank") <= top)
    return near.drop("_bucket").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= top)


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, percent: int = INSIDE_PERCENT) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = settled(phrase_counts(documents, least))
    left = outside_longer(scored_candidates(counts, least), counts, percent).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score"
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    words = counts.filter("size = 0").select("lang", "n")
    long = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return best_by_group(left, "lang", order, top).join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *long)
