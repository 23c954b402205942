"""Token ids in binary shards: each document compressed alone with one shared zstandard dictionary.

A shard file holds, in ascending doc_id order (null ids last, ties by content):

    8 bytes   magic FTOKENS1
    4 bytes   length of the header, then the header as JSON: id width in bytes, hash of the dictionary
    frames    one zstandard frame a document: its ids, little-endian, end id included
    index     arrays of n int64 each: doc_id, byte offset of the frame, tokens; then n bytes, 1 for a null doc_id
    24 bytes  place of the index, n, tokens of the shard (int64 each)

so one document is read with three small reads and one short decompression. The dictionary is a file
of its own, `<sha256>.zdict`; a reader refuses a shard whose header names another one.

Texts are encoded with the tokenizers library where they are read. A byte-level BPE never joins a
blank with what stands before it, so a text is cut before single blanks between visible characters,
and each distinct piece is encoded once and remembered; the ids are those of the whole text. Only
compressed frames are shuffled: documents go to shards by bounds of doc_id taken from that column
alone. A retried task writes a file of a new name, and only the files that finished tasks report are
in the manifest.

Cases: a null or empty text is its end id alone; repeated rows are each stored; a null doc_id comes
last; an empty table gives no shard and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm.words import buffers, span_hashes
from foliary.operators.sizing import new_folder, settled

MAGIC = b"FTOKENS1"
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Characters of text in one shard, and the most shards.
SHARD_CHARS, MOST_SHARDS = 32_000_000, 20_000
#: The dictionary is trained on so many documents at most, on so many bytes of ids of each.
TRAINING_DOCUMENTS, TRAINING_BYTES, DICTIONARY_BYTES = 2_000, 8_192, 65_536
LEVEL = 3
#: Distinct pieces that a worker remembers before it starts anew, and bytes of text encoded at once.
REMEMBERED, AT_ONCE = 500_000, 1 << 19
#: New pieces learned at once, and how many of them are encoded as one text.
PIECES_AT_ONCE, JOINED = 16_384, 64
MANIFEST = "shard int, file string, documents long, tokens long"

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:] = True
#: Lead bytes of the white space characters beyond ASCII, and their possible last bytes: no cut beside these.
_SPACE_LEADS, _SPACE_LASTS = np.zeros(256, bool), np.zeros(256, bool)
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE_LASTS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: visible Latin-1 characters stand for themselves,
    the other bytes in order for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts, remembering those of each distinct piece."""

    def __init__(self, path: str):
        # A task has one core: threads of the library's own would only hold memory beside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        entries = {i: len(t) if all(c in alphabet for c in t) else 0 for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        #: Bytes that each id stands for; 0 where that is not known.
        self.bytes = np.array([entries.get(i, 0) for i in range(max(entries, default=0) + 1)], np.int64)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes the pieces `data[start:end]`, whose hashes are new and in order."""
        slots = np.arange(self.count, self.count + len(hashes))
        at = np.searchsorted(self.known, hashes)
        self.known, self.slots = np.insert(self.known, at, hashes), np.insert(self.slots, at, slots)
        for first in range(0, len(hashes), PIECES_AT_ONCE):
            some = slice(first, first + PIECES_AT_ONCE)
            size = end[some] - start[some]
            edge = np.concatenate([[0], np.cumsum(size)])
            raw = data[np.repeat(start[some] - edge[:-1], size) + np.arange(edge[-1])]
            self._learn(*(self._joined(raw, edge) or self._alone(raw, edge)))

    def _alone(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces `raw[edge[i]:edge[i + 1]]`, and how many each has."""
        line, at = raw.tobytes(), edge.tolist()
        pieces = [line[x:y].decode() for x, y in zip(at, at[1:])]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _joined(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same from texts of up to JOINED pieces, parted by the bytes of their tokens; None if a token crosses
        the border of a piece or its bytes are not known."""
        opens = (np.arange(len(edge) - 1) % JOINED == 0) | ~cuts(raw, np.array([0, len(raw)]))[edge[:-1]]
        flat, _ = self._alone(raw, np.append(edge[:-1][opens], len(raw)))
        ends = np.cumsum(self.bytes[flat])
        last = np.searchsorted(ends, edge[1:])
        if len(ends) != last[-1] + 1 or (ends[last] != edge[1:]).any():
            return None
        return flat, np.diff(last, prepend=-1)

    def _learn(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < self.count + len(sizes):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        span = slice(self.count, self.count + len(sizes))
        self.start[span], self.size[span] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(flat), span.stop

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.count > REMEMBERED:
            self.forget()
        start = np.flatnonzero(cuts(data, offsets))
        end = np.append(start[1:], len(data))
        hashes = span_hashes(data, start, end)
        known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, known)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == known[old]
        new = np.flatnonzero(~old)
        if len(new):
            self.learn(known[new], data, start[first[new]], end[first[new]])
            at = np.searchsorted(self.known, known)
        slots = self.slots[at]
        slot = slots[place]
        size = self.size[slot]
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[slot] - bounds[:-1], size) + np.arange(bounds[-1])]
        return ids, bounds[np.searchsorted(start, offsets)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, and at each blank between two characters that are surely visible."""
    out = np.zeros(len(data), bool)
    visible = _VISIBLE[data]
    out[1:-1] = (data[1:-1] == 0x20) & visible[:-2] & visible[2:] & ~_SPACE_LEADS[data[2:]]
    at = np.flatnonzero(out)
    lead = _SPACE_LEADS[data[np.maximum(at - 2, 0)]] | _SPACE_LEADS[data[np.maximum(at - 3, 0)]]
    out[at[_SPACE_LASTS[data[at - 1]] & lead]] = False
    edges = offsets[offsets < len(data)]
    out[edges] = True
    # A cut needs its neighbours in the same text.
    last = edges[edges > 0] - 1
    out[last[~np.isin(last, edges)]] = False
    return out


def encoder(path: str) -> Encoder:
    """The worker's encoder. Functions travel by value and lose their globals with each task, so what is
    remembered is kept in a module of the process."""
    kept = sys.modules.setdefault("_foliary_encoders", types.ModuleType("_foliary_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of each whole text, in order."""
    own = encoder(path)
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1)
        ids, bounds = own.encode(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        for i in range(row, last):
            part = ids[bounds[i - row] : bounds[i - row + 1]]
            yield i, np.append(part, np.uint32(END_ID))
        row = last


def _trained(documents: DataFrame, path: str) -> bytes:
    """A dictionary from the ids of a bounded, hash-chosen set of documents; empty if there are too few."""
    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = f"<u{encoder(path).width}"
        for batch in batches:
            parts = [ids.astype(width).tobytes()[:TRAINING_BYTES] for _, ids in encoded(batch.column("text"), path)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["ids"])

    # Only hashes are sorted; the texts below the last one, fewer than TRAINING_DOCUMENTS, are read where they are.
    hashed = documents.filter(F.length("text") > 0).withColumn("h", F.xxhash64("doc_id", "text"))
    last = hashed.select("h").orderBy("h").limit(TRAINING_DOCUMENTS).agg(F.max("h")).first()[0]
    chosen = hashed.filter(F.col("h") < F.lit(last)).select("text")
    parts = sorted(row[0] for row in chosen.mapInArrow(samples, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # fewer or smaller samples than the trainer asks for
        return b""


def _coder(make: Callable, dictionary: bytes, **options):
    if dictionary:
        options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
    return make(**options)


def _frames(path: str, dictionary: bytes, bounds: list[int]) -> Callable:
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, edges = f"<u{encoder(path).width}", np.array(bounds, np.int64)
        coder = _coder(zstandard.ZstdCompressor, dictionary, level=LEVEL, write_checksum=True)
        for batch in batches:
            ids = batch.column("doc_id")
            shard = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            shard[ids.is_null().to_numpy(zero_copy_only=False)] = len(edges)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes, blobs = [], []
                for _, own in encoded(part.column("text"), path):
                    sizes.append(len(own))
                    blobs.append(coder.compress(own.astype(width).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[first : first + part.num_rows]), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                    ["shard", "doc_id", "n", "frame"],
                )

    return frames


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class _Shard:
    """Writes one shard file."""

    def __init__(self, folder: str, shard: int, width: int, dictionary_hash: str):
        self.shard, self.file = shard, f"{shard:06d}-{uuid.uuid4().hex}.tokens"
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        self.out = files.open_output_stream(f"{root}/{self.file}")
        header = json.dumps({"width": width, "dictionary": dictionary_hash}).encode()
        self.out.write(MAGIC + struct.pack("<i", len(header)) + header)
        self.ids: list[int | None] = []
        self.places: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, size: int, frame: bytes) -> None:
        self.ids.append(doc_id)
        self.places.append(self.out.tell())
        self.sizes.append(size)
        self.out.write(frame)

    def close(self) -> tuple[int, str, int, int]:
        place, null = self.out.tell(), np.array([i is None for i in self.ids], np.uint8)
        for column in ([i or 0 for i in self.ids], self.places, self.sizes):
            self.out.write(np.array(column, "<i8").tobytes())
        self.out.write(null.tobytes())
        self.out.write(struct.pack("<qqq", place, len(self.ids), sum(self.sizes)))
        self.out.close()
        return self.shard, self.file, len(self.ids), sum(self.sizes)


def _writer(folder: str, width: int, dictionary_hash: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_ = [], None
        for batch in batches:
            for shard, doc_id, size, frame in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "frame")), strict=True):
                if open_ is None or open_.shard != shard:
                    if open_:
                        done.append(open_.close())
                    open_ = _Shard(folder, shard, width, dictionary_hash)
                open_.add(doc_id, size, frame)
        if open_:
            done.append(open_.close())
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "file", "documents", "tokens"])

    return write


def write_shards(documents: DataFrame, folder: str, tokenizer: str | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encodes all documents into shard files below `folder`; the manifest (shard, file, documents, tokens).

    `folder` is one that all executors write to, as a path or an address that pyarrow.fs opens.
    """
    path = tokenizer or default_tokenizer()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-chars // shard_chars)))
    bounds: list[int] = []
    if shards > 1:
        shares = [i / shards for i in range(1, shards)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 20 * shards + 1000)).first()[0] or []))
    dictionary = _trained(rows, path)
    name = hashlib.sha256(dictionary).hexdigest()
    files, root = _opened(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{name}.zdict") as out:
        out.write(dictionary)
    frames = rows.mapInArrow(_frames(path, dictionary, bounds), "shard int, doc_id long, n long, frame binary")
    placed = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_last(), "n", "frame"
    )
    width = Encoder(path).width
    return settled(placed.mapInArrow(_writer(folder, width, name), MANIFEST))


class Reader:
    """One shard file: its index, and single documents by place."""

    def __init__(self, folder: str, file: str, dictionaries: dict[str, bytes] | None = None):
        files, root = _opened(folder)
        self.input = files.open_input_file(f"{root}/{file}")
        if self.input.read_at(8, 0) != MAGIC:
            raise ValueError(f"{file} is no token shard")
        length = struct.unpack("<i", self.input.read_at(4, 8))[0]
        header = json.loads(self.input.read_at(length, 12))
        self.kind, name = np.dtype(f"<u{header['width']}"), header["dictionary"]
        known = {} if dictionaries is None else dictionaries
        if name not in known:
            with files.open_input_stream(f"{root}/{name}.zdict") as source:
                known[name] = source.read()
        if hashlib.sha256(known[name]).hexdigest() != name:
            raise ValueError(f"the dictionary of {file} is another one")
        self.coder = _coder(zstandard.ZstdDecompressor, known[name])
        place, n, self.tokens = struct.unpack("<qqq", self.input.read_at(24, self.input.size() - 24))
        index = self.input.read_at(25 * n, place)
        ids, self.places, self.sizes = np.frombuffer(index, "<i8", 3 * n).reshape(3, n)
        null = np.frombuffer(index, np.uint8, n, 24 * n)
        self.ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.ends = np.append(self.places[1:], place)

    def document(self, at: int) -> np.ndarray:
        """Ids of the document at this place of the shard, its end id included."""
        frame = self.input.read_at(int(self.ends[at] - self.places[at]), int(self.places[at]))
        return np.frombuffer(self.coder.decompress(frame), self.kind)

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of a document by its id (the first, if several have it)."""
        return self.document(self.ids.index(doc_id))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Starts inside a shard come from its frames; a shard's own start is the running sum over the manifest,
    which has one row a file.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard, start = Reader(folder, file, known), base
                for first in range(0, len(shard.ids), 4096):
                    starts, sizes, sums = [], [], []
                    for at in range(first, min(first + 4096, len(shard.ids))):
                        ids = shard.document(at)
                        starts.append(start)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.ids[first : first + 4096], pa.int64()), *(pa.array(c, pa.int64()) for c in (starts, sizes, sums))],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = settled(manifest.select("shard", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base")))
    files = max(1, based.count())
    return based.repartitionById(files, F.col("shard")).select("file", "base").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def stored(spark: SparkSession, documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents to shards below the session's shared folder and reads them back."""
    folder = new_folder(spark, "tokens")
    return read_shards(write_shards(documents, folder, tokenizer), folder)
