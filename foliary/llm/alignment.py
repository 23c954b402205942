"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers work on blank + text: A (tokenizers, byte-level BPE) encodes it, B (sentencepiece with byte
fallback) puts the blank there itself. The spans of both libraries are the coarse cuts: character offsets
of A, byte spans of B's proto (`proto`, which took the place of the immutable one in the installed release).
A span says nothing where several tokens share a character: there, and at byte-fallback tokens, whose spans
are empty but for the last, the cut is set by the bytes that the tokens decode to. Offsets at which both
sides have a cut close a group, and each A and B token with a common byte are linked.

Neither vocabulary has an entry that goes on over a single blank between visible characters (checked when it is
loaded; if it has one, texts stay whole), so a text falls apart there, both tokenizers have
cuts there, and each distinct piece is encoded and aligned once while a worker remembers it. A document is
the sum of its pieces. Its linked id pairs travel as (pair, times); the corpus counts group these pairs, with
partial counts before the shuffle, and go back to the documents by a join on the pair. That join sends
the counts to all tasks if they are at most `FEW_PAIRS` rows, counted first, and is a shuffled one beyond.

Cases: a null or empty text, and one whose tokens do not give back its bytes (say, U+2581 in it), has no tokens:
zeros and '' as digest. Repeated rows each count as a document, so an id that stands twice gives two rows; an
empty table gives an empty result; further columns are ignored. A text of any length is aligned whole.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.tokens import byte_alphabet, cuts
from foliary.llm.words import buffers, span_hashes
from foliary.operators.sizing import settled

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pieces that a worker remembers before it starts anew, bytes of text and new pieces aligned at once.
REMEMBERED, AT_ONCE, PIECES_AT_ONCE = 400_000, 1 << 20, 8_192
#: Pieces that are encoded as one text.
JOINED = 64
#: Rows of pair counts (25 bytes each) that are sent to every task; more are joined by a shuffle.
FEW_PAIRS = 1_000_000
#: An id pair is one long: A's id times 2**PAIR_BITS plus B's.
PAIR_BITS = 20
flattened = chain.from_iterable
_FIRST = np.uint64(0xA24BAED4963EE407)
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<struct<pair:bigint,times:int>>"
)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def cut_ends(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray, opens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where each token of some pieces ends. A span's end holds unless the token shares a character with the
    next one or has an empty span; then the end is the one before it plus the bytes the token decodes to.
    `opens` marks the first token of each piece, `place` is where the piece of a token begins."""
    after = np.append(begins[1:], np.iinfo(np.int64).max)
    after[:-1][opens[1:]] = np.iinfo(np.int64).max
    shared = (ends <= begins) | (after < ends)
    total = np.cumsum(sizes)
    # Bytes that the spans are ahead of the decoded ones, at the last end that holds or at the piece's begin.
    ahead = np.where(shared, place - (total - sizes), ends - total)
    last = np.maximum.accumulate(np.where(~shared | opens, np.arange(len(ends)), 0))
    return total + ahead[last]


def _joined(ids: np.ndarray, ends: np.ndarray, common: np.ndarray) -> list[str]:
    """The ids up to each common end, joined by commas."""
    names, last = list(map(str, ids.tolist())), (np.searchsorted(ends, common, "left") + 1).tolist()
    return [names[x] if y == x + 1 else ",".join(names[x:y]) for x, y in zip([0, *last], last)]


def _blob(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as one line of bytes, where each begins, and its size."""
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


class Aligner:
    """Both tokenizers, and what is known of each distinct piece."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        entries = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        named = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in named]
        # Each entry with a letter behind it: a cut inside would part a token.
        line, start, _ = _blob([entry + b"x" for entry in (*self.bytes_a, *self.bytes_b)])
        self.apart = int(cuts(line, np.append(start, len(line))).sum()) == len(start)
        self.blob_a, self.blob_b = _blob(self.bytes_a), _blob(self.bytes_b)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.texts: list[str] = []
        # n_a, n_b, groups, links, and 1 where the bytes are not given back
        self.numbers = np.zeros((0, 5), np.int64)
        self.pairs, self.place, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def learn(self, hashes: list[int], pieces: list[str]) -> None:
        for first in range(0, len(pieces), PIECES_AT_ONCE):
            self._learn(hashes[first : first + PIECES_AT_ONCE], pieces[first : first + PIECES_AT_ONCE])

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        groups, numbers, links = self._align(pieces, JOINED)
        doubtful = np.flatnonzero(numbers[:, 4])
        if len(doubtful) and len(pieces) > 1:
            # A piece that is not given back may have taken bytes of its neighbours: each alone.
            kept = numbers[:, 3].copy()
            alone = [self._align([pieces[i]], 1) for i in doubtful.tolist()]
            parts = np.split(links, np.cumsum(kept)[:-1])
            for i, (text, row, own) in zip(doubtful.tolist(), alone, strict=True):
                groups[i], numbers[i], parts[i] = text[0], row[0], own
            links = np.concatenate(parts)
        slot = len(self.texts)
        self.texts += groups
        self.numbers = np.concatenate([self.numbers, numbers])
        self.place = np.concatenate([self.place, self.used + np.cumsum(numbers[:, 3]) - numbers[:, 3]])
        self.pairs = np.concatenate([self.pairs, links])
        self.used += len(links)
        self.slots.update(zip(hashes, range(slot, slot + len(groups)), strict=True))

    def _align(self, pieces: list[str], joined: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(groups, numbers, links) of pieces, each beginning with the blank, on one line of bytes.

        As both tokenizers cut between pieces, up to `joined` of them are encoded as one text.
        """
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character begins
        first_char = np.cumsum([0, *map(len, pieces)])
        edge = chars[first_char]
        n = len(pieces)
        marked = np.fromiter(("▁" in p for p in pieces), bool, n)
        opens = np.arange(n) % joined == 0
        opens |= ~cuts(raw, np.array([0, len(raw)]))[edge[:-1]] | marked
        opens[1:] |= marked[:-1]
        opens = np.flatnonzero(opens)
        texts = ["".join(pieces[x:y]) for x, y in zip(opens.tolist(), [*opens[1:].tolist(), n], strict=True)]

        found = self.a.encode_batch(texts, add_special_tokens=False)
        sizes = np.fromiter((len(e) for e in found), np.int64, len(found))
        of, total = np.repeat(np.arange(len(texts)), sizes), int(sizes.sum())
        spans = np.fromiter(flattened(flattened(e.offsets for e in found)), np.int64, 2 * total).reshape(-1, 2)
        ids = np.fromiter(flattened([e.ids for e in found]), np.int64, total)
        a = self._side(ids, of, chars[first_char[opens][of][:, None] + spans], edge[opens], edge, self.blob_a, raw)
        told = [t.pieces for t in self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)]
        sizes = np.fromiter(map(len, told), np.int64, len(told))
        of = np.repeat(np.arange(len(texts)), sizes)
        spans = np.fromiter((x for t in told for p in t for x in (p.id, p.begin, p.end)), np.int64, 3 * len(of)).reshape(-1, 3)
        b = self._side(spans[:, 0], of, edge[opens][of][:, None] + 1 + spans[:, 1:], edge[opens], edge, self.blob_b, raw)
        good = a[2] & b[2]
        ids_a, ends_a, of_a, begin_a = self._good(a, good, edge)
        ids_b, ends_b, of_b, _ = self._good(b, good, edge)
        common = np.intersect1d(ends_a, ends_b)
        low, high = np.searchsorted(ends_b, begin_a, "right"), np.searchsorted(ends_b, ends_a, "left")
        size = high - low + 1
        links = np.repeat(ids_a, size) << PAIR_BITS | ids_b[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        counts = [np.bincount(x, minlength=n) for x in (of_a, of_b, np.searchsorted(edge, common, "left") - 1)]
        n_links = np.bincount(of_a, size, n).astype(np.int64)
        groups = [f"{x}|{y}" for x, y in zip(_joined(ids_a, ends_a, common), _joined(ids_b, ends_b, common), strict=True)]
        last = np.cumsum(counts[2]).tolist()
        texts = [";".join(groups[y - x : y]) for x, y in zip(counts[2].tolist(), last, strict=True)]
        return texts, np.stack([*counts, n_links, ~good], axis=1), links

    @staticmethod
    def _side(
        flat: np.ndarray, text: np.ndarray, spans: np.ndarray, place: np.ndarray, edge: np.ndarray, blob: tuple, raw: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """(ids, ends, whether a piece's bytes come back, piece of each token) of one tokenizer; ends count in `raw`."""
        n = len(edge) - 1
        line, start, size = blob[0], blob[1][flat], blob[2][flat]
        opens = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
        ends = cut_ends(*spans.T, size, opens, place[text])
        of = np.clip(np.searchsorted(edge, ends, "left") - 1, 0, n - 1)
        of = np.maximum.accumulate(of) if n else of
        decoded = np.bincount(of, size, n).astype(np.int64)
        good = decoded == np.diff(edge)
        kept = good[of]
        size, start, of_kept = size[kept], start[kept], of[kept]
        before = np.cumsum(size) - size
        own = line[np.repeat(start - before, size) + np.arange(size.sum())]
        into = np.repeat(good, np.diff(edge))
        wrong = np.flatnonzero(own != raw[into])
        good[np.repeat(of_kept, size)[wrong]] = False
        # What the tokens decode to has the last word on a cut.
        total = np.cumsum(blob[2][flat])
        exact = total - np.concatenate([[0], np.cumsum(decoded)])[of] + edge[of]
        return flat, np.where(good[of], exact, ends), good, of

    @staticmethod
    def _good(side: tuple[np.ndarray, ...], good: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, ends, pieces, begins) of the tokens of good pieces."""
        ids, ends, _, of = side
        kept = good[of]
        ids, ends, of = ids[kept], ends[kept], of[kept]
        opens = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
        return ids, ends, of, np.where(opens, edge[of], np.concatenate([[0], ends[:-1]])[: len(ends)])

    def aligned(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some whole texts: numbers by text, digests, and (offsets, pair, times) of their distinct links."""
        rows = len(offsets) - 1
        if len(self.texts) > REMEMBERED:
            self.forget()
        starts = offsets[:-1][np.diff(offsets) > 0]
        if not len(starts):
            none = np.zeros(0, np.int64)
            return np.zeros((rows, 5), np.int64), [""] * rows, np.zeros(rows + 1, np.int64), none, none
        start = np.flatnonzero(cuts(data, offsets)) if self.apart else starts
        end = np.append(start[1:], len(data))
        opens = np.isin(start, starts)
        # The blank that is put before a text makes its first piece another one than the same bytes inside.
        hashes = span_hashes(data, start, end) ^ np.where(opens, _FIRST, np.uint64(0))
        known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        slots = np.fromiter((self.slots.get(h, -1) for h in known.tolist()), np.int64, len(known))
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            self.learn(known[new].tolist(), [" " * o + raw[x:y].decode() for x, y, o in zip(start[at], end[at], opens[at].tolist(), strict=True)])
            slots[new] = np.arange(len(self.texts) - len(new), len(self.texts))
        slot = slots[place]
        bounds = np.searchsorted(start, offsets)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[slot], axis=0)])
        numbers = sums[bounds[1:]] - sums[bounds[:-1]]
        whole = (numbers[:, 4] == 0) & (numbers[:, 0] > 0)
        listed = slot.tolist()
        digests = [
            hashlib.sha256(";".join([self.texts[s] for s in listed[x:y]]).encode()).hexdigest() if ok else ""
            for x, y, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), whole.tolist(), strict=True)
        ]
        numbers[~whole] = 0
        of = np.repeat(np.arange(rows), np.diff(bounds))
        slot = slot[whole[of]]
        of = of[whole[of]]
        size = self.numbers[slot, 3]
        before = np.cumsum(size) - size
        links = self.pairs[np.repeat(self.place[slot] - before, size) + np.arange(size.sum())]
        keyed = np.repeat(of, size) << 2 * PAIR_BITS | links  # a call has fewer than 2**23 texts
        keyed, times = np.unique(keyed, return_counts=True)
        edges = np.searchsorted(keyed, np.arange(rows + 1) << 2 * PAIR_BITS)
        return numbers, digests, edges, keyed & ((1 << 2 * PAIR_BITS) - 1), times


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner, kept in a module of the process like its encoder (see `tokens.encoder`)."""
    kept = sys.modules.setdefault("_foliary_aligners", types.ModuleType("_foliary_aligners"))
    if "|".join(paths) not in kept.__dict__:
        kept.__dict__["|".join(paths)] = Aligner(*paths)
    return kept.__dict__["|".join(paths)]


def _aligned(paths: tuple[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(paths)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            row = 0
            while row < batch.num_rows:
                last = max(row + 1, min(row + (1 << 22), int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1))
                numbers, digests, edges, pairs, times = own.aligned(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
                links = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times.astype(np.int32))], ["pair", "times"])
                columns = [batch.column(c).slice(row, last - row) for c in ("row", "doc_id")]
                columns += [pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(4)]
                columns += [pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), links)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
                row = last

    return run


def aligned_documents(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document with its numbers of tokens, groups and links, the digest of its groups, and its
    linked id pairs with how often each is linked; `row` numbers the rows."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_aligned(paths or default_paths()), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents hold each id pair linked, and whether no other pair of
    its A id stands in more of them."""
    counts = aligned.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    a = F.shiftright("pair", PAIR_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignments(documents: DataFrame, paths: tuple[str, str] | None = None, few: int = FEW_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    aligned = settled(aligned_documents(documents, paths))
    counts = settled(pair_counts(aligned))
    if counts.count() <= few:
        counts = F.broadcast(counts)
    links = aligned.select("row", F.inline("pairs")).join(counts, "pair")
    sums = links.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")
    )
    return aligned.drop("pairs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256",
    )
