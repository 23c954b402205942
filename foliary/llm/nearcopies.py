"""Near-duplicate documents by HyperMinHash registers, banding, collision-corrected estimates and full sets.

A document is the set of its distinct five-word shingles (see `words`). Documents with equal sets form
one class; the rest of the work is on one document of each class, that with the smallest doc_id.

1. Signature: a shingle's hash picks one of `REGISTERS` buckets; the smallest second hash of a bucket is
   kept as a HyperMinHash register of 16 bits, six for the count of leading zeros and ten mantissa bits.
2. Empty registers of short texts borrow from others (each has a fixed random order of all buckets and takes
   the first one in use), so that every register of two texts is equal with the chance of their Jaccard.
   Bands of five registers are hashed; documents with an equal band meet in a bucket. At a similarity of
   0.75 a pair misses all 60 bands with a chance of 9e-8, and less above it.
3. A document also keeps one bit of each of 256 registers. Unequal registers share a bit by chance half the
   time, so d unequal bits estimate a Jaccard of 1 - 2 d / 256. Pairs that meet but estimate below 0.5 are
   passed over; at a similarity of 0.75 that is a chance of 1e-7.
4. No bucket emits all its pairs. First every document of a bucket is paired with the bucket's centre, the
   document that meets the most others over all its buckets. Links found join documents to components.
   Where a bucket still holds several components, its documents outside the largest one are paired with
   those of other components, unless too many of a document's shingles are in no other one for any of its
   pairs to reach the threshold. A bucket of thousands of copies so costs one pair a document, and no link
   between components is lost.
5. A pair's Jaccard is estimated again from equal registers less the expected chance collisions. Only pairs
   far below the threshold are dropped (six standard deviations and more); all others are confirmed on
   their full shingle sets: 100 * intersection >= 75 * union.
6. Components come from rounds of large-star and small-star rewiring in Spark; the driver sees a count.

Cases: a text without words has an empty set and is linked with nothing. Rows with a null doc_id are
linked with nothing and have a null component. Rows with one doc_id are one document. An empty table
gives an empty result; further columns are ignored by `components` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.bitmaps import bitmap, passes
from foliary.llm.words import chunks, mix
from foliary.operators.sizing import settled

REGISTERS = 300
BAND = 5
MANTISSA_BITS = 10
#: Similarity in hundredths.
THRESHOLD = 75
#: Longs of register bits kept with a document, and the most unequal ones of a pair that is looked at.
SKETCH, MOST_UNEQUAL = 4, 64
#: Registers in use from which an estimate may drop a pair, and how many standard deviations below the threshold.
ESTIMATE_FROM, DEVIATIONS = 64, 6.0
#: Constant of the expected collisions of two HyperMinHash sketches (Yu and Weber, 2017), a fixed value.
COLLISION = 0.169919487159739093975315012348630288992889

#: Documents whose registers (a long each while they are made) are in memory at once.
SIGNED_AT_ONCE = 512

_SECOND = np.uint64(0xA0761D6478BD642F)
#: Row j: the rank of each bucket in the order in which register j borrows.
_RANK = np.random.Generator(np.random.PCG64(20_170_101)).random((REGISTERS, REGISTERS)).argsort(axis=1).astype(np.int16)


_BITS = tuple(f"s{j}" for j in range(SKETCH))


def registers(shingles: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash registers (count x REGISTERS, uint16; 0 for an empty bucket) of hashes and their row."""
    least = np.full(count * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    np.minimum.at(least, rows * REGISTERS + bucket.astype(np.int64), mix(shingles ^ _SECOND))
    empty = least == np.iinfo(np.uint64).max
    # The double's exponent is 63 less the leading zeros, its top mantissa bits follow the first one.
    bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)
    code = bits - np.uint64(1023 << MANTISSA_BITS)
    code = np.minimum(code, np.uint64((1 << 16) - 2)) + np.uint64(1)
    return np.where(empty, 0, code).astype(np.uint16).reshape(count, REGISTERS)


def densified(codes: np.ndarray) -> np.ndarray:
    """The registers with each empty one borrowed from the first in use of its order; all empty stay so."""
    out = codes.copy()
    for i in np.flatnonzero((codes == 0).any(axis=1) & codes.any(axis=1)):
        used, empty = np.flatnonzero(codes[i]), np.flatnonzero(codes[i] == 0)
        out[i, empty] = codes[i, used[_RANK[empty][:, used].argmin(axis=1)]]
    return out


def bands(codes: np.ndarray) -> np.ndarray:
    """Hash of each band (rows x bands, int64); 0 where all its registers are empty."""
    groups = codes.reshape(len(codes), -1, BAND).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, groups.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), groups.shape[:2])
    for j in range(BAND):
        total = mix(total ^ groups[:, :, j])
    return np.where(groups.any(axis=2), total, 0).astype(np.uint64).view(np.int64)


def sketches(codes: np.ndarray) -> np.ndarray:
    """One well mixed bit of each of the first registers (rows x SKETCH, int64)."""
    some = codes[:, : 64 * SKETCH].astype(np.uint64)
    bits = (mix(some ^ (np.arange(some.shape[1], dtype=np.uint64) << np.uint64(20))) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Jaccard from two register rows, corrected for chance collisions, and the registers in use."""
    used = int(np.count_nonzero(a | b))
    same = int(np.count_nonzero((a == b) & (a != 0)))
    ratio = n / m
    chance = COLLISION * REGISTERS / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return (max(0.0, same - chance) / used if used else 0.0), used


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words in chunks(batch.column("text"), most=SIGNED_AT_ONCE):
            rows = len(words.offsets) - 1
            shingles, bounds = words.shingle_rows()
            codes = registers(shingles, np.repeat(np.arange(rows), np.diff(bounds)), rows)
            full = densified(codes)
            keys, bits = bands(full), sketches(full)
            sizes, low, high = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            for i in range(rows):
                own = np.unique(shingles[bounds[i] : bounds[i + 1]])
                sizes[i] = len(own)
                low[i], high[i] = mix(own).sum(), mix(own ^ _SECOND).sum()
            filled = keys != 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[first : first + rows], pa.array(sizes),
                    pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], filled.sum(axis=1).cumsum()]), pa.int32()), pa.array(keys[filled])),
                    *(pa.array(bits[:, j].copy()) for j in range(SKETCH)),
                ],
                ["doc_id", "n", "f1", "f2", "keys", *_BITS],
            )


def _wanted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(passes(bits, batch.column("at").to_numpy(zero_copy_only=False))))


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in _wanted(batches, bits):
        for first, words in chunks(batch.column("text")):
            shingles, bounds = words.shingle_rows()
            rows = len(bounds) - 1
            own = [np.unique(shingles[bounds[i] : bounds[i + 1]]).tobytes() for i in range(rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[first : first + rows], pa.array(own, pa.binary())], ["doc_id", "hashes"]
            )


def _grams(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingle), each of a wanted text's distinct shingles once."""
    for batch in _wanted(batches, bits):
        for first, words in chunks(batch.column("text")):
            shingles, bounds = words.shingle_rows()
            own = [np.unique(shingles[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(own)) + first, [len(x) for x in own])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["doc_id", "gram"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose estimate may reach the threshold and whose full sets do."""
    bound = THRESHOLD / 100
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        last, left, left_codes = None, None, None
        names = batch.column("a").to_pylist()
        for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
            if names[i] != last:
                last, left = names[i], np.frombuffer(x.as_buffer(), np.uint64)
                left_codes = registers(left, np.zeros(len(left), np.int64), 1)[0]
            right = np.frombuffer(y.as_buffer(), np.uint64)
            if not len(left) or not len(right):
                continue
            codes = registers(right, np.zeros(len(right), np.int64), 1)[0]
            guess, used = estimate(left_codes, codes, len(left), len(right))
            if used >= ESTIMATE_FROM and guess < bound - DEVIATIONS * (bound * (1 - bound) / used) ** 0.5:
                continue
            both = len(left) + len(right) - len(np.union1d(left, right))
            keep[i] = 100 * both >= THRESHOLD * (len(left) + len(right) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The confirmed pairs. Texts of paired documents alone become sets, picked at the scan by a bit map of
    their ids, so that no text is moved."""
    pairs = settled(pairs)
    bits = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), _place())
    sets = settled(texts.withColumn("at", _place()).mapInArrow(lambda b: _sets(b, bits), "doc_id long, hashes binary"))
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("left")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("right")), "b"
    )
    return settled(joined.select("a", "b", "left", "right").mapInArrow(_confirmed, "a long, b long"))


def _place() -> Column:
    return F.coalesce(F.xxhash64("doc_id"), F.lit(0))


def connected(links: DataFrame) -> DataFrame:
    """(doc_id, root): each linked document with the smallest doc_id it reaches.

    Large-star then small-star rounds; each writes its edges and stops when none changed.
    """
    def rewired(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        moved = both.join(least, "x")
        if large:
            return moved.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        kept = moved.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("x").alias("u"), F.col("m").alias("v"))
        )
        return kept.filter("u <> v").distinct()

    def mark(edges: DataFrame) -> tuple:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
        return found["n"], found["s"]

    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = mark(edges)
    while before[0]:
        edges = settled(rewired(rewired(edges, True), False))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))


def _alike(a: str, b: str) -> str:
    """Whether a pair may reach the threshold by its sizes and register bits; columns begin with `a` and `b`."""
    unequal = " + ".join(f"bit_count({a}{s} ^ {b}{s})" for s in _BITS)
    return f"100 * least({a}n, {b}n) >= {THRESHOLD} * greatest({a}n, {b}n) and {unequal} <= {MOST_UNEQUAL}"


def _prefixed(frame: DataFrame, prefix: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(f"{prefix}{c}") for c in frame.columns])


def _open_pairs(split: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket or a rare shingle and may reach the threshold.

    A shingle is rare that at most three of these documents have. The intersection of two documents is at
    most the smaller of their counts of other shingles, and the rare ones they share. Pairs that need no
    rare shingle for it come from the buckets; those that share one, straight from its two or three documents.
    """
    bits = bitmap(split, _place())
    grams = texts.withColumn("at", _place()).mapInArrow(lambda b: _grams(b, bits), "doc_id long, gram long")
    total, low, high = F.sum(F.col("doc_id").cast("decimal(20,0)")), F.min("doc_id"), F.max("doc_id")
    rare = settled(grams.groupBy("gram").agg(F.count("*").alias("documents"), low.alias("low"), high.alias("high"), total.alias("total")).filter(
        "documents <= 3"
    ).select(F.expr("array_sort(array_distinct(if(documents = 3, array(low, high, cast(total - low - high as long)), array(low, high))))").alias("own")))
    counts = rare.select(F.explode("own").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("rare"))
    people = settled(
        split.select("doc_id", "root", "n", *_BITS).distinct().join(counts, "doc_id", "left")
        .withColumn("most", F.col("n") - F.coalesce("rare", F.lit(0)))
    )

    def may(shared: str) -> str:
        return (
            f"x_root <> y_root and {100 + THRESHOLD} * (least(x_most, y_most) + {shared}) >= {THRESHOLD} * (x_n + y_n) and "
            + _alike("x_", "y_")
        )

    x, y = _prefixed(people.drop("rare"), "x_"), _prefixed(people.drop("rare"), "y_")
    sharing = (
        rare.filter(F.size("own") > 1).select(F.explode(F.expr(
            "if(size(own) = 2, array(struct(own[0] as a, own[1] as b)), array(struct(own[0] as a, own[1] as b), struct(own[0] as a, own[2] as b), struct(own[1] as a, own[2] as b)))"
        )).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    )
    by_shingle = sharing.join(x, sharing["a"] == x["x_doc_id"]).join(y, sharing["b"] == y["y_doc_id"]).filter(may("shared")).select("a", "b")

    # A pair that meets in several buckets is taken in the first: each row has its document's at most 60 keys.
    keys = split.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    placed = split.select("key", "doc_id", "main", "head").join(people.drop("rare"), "doc_id").join(keys, "doc_id").filter(
        f"100 * most >= {THRESHOLD} * n"
    )
    minor = _prefixed(placed.filter("root <> main").drop("main", "head"), "x_").withColumnRenamed("x_key", "key")
    other = _prefixed(placed, "y_").withColumnRenamed("y_key", "key")
    by_bucket = minor.join(other, "key").filter(
        "(y_root = y_main or x_doc_id < y_doc_id) and x_doc_id <> y_head and y_doc_id <> y_head and " + may("0")
        + " and key = array_min(array_intersect(x_keys, y_keys))"
    ).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"))
    return by_bucket.unionByName(by_shingle).distinct()


def components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module's text)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signatures = settled(texts.mapInArrow(
        _signatures, "doc_id long, n long, f1 long, f2 long, keys array<long>, " + ", ".join(f"{s} long" for s in _BITS)
    ))
    named = signatures.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = settled(
        named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    )
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    mine = named.join(reps, "doc_id", "left_semi")
    sketch = mine.select("doc_id", "n", *_BITS)
    keys = mine.select("doc_id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = settled(keys.join(shared.filter("low < high").select("key", "size"), "key"))
    # What many others are copies of has the most company; it is the centre of its buckets.
    company = shared.groupBy("doc_id").agg(F.sum("size").alias("company"))
    centres = shared.join(company, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("h_doc_id"))
    centres = centres.join(_prefixed(sketch, "h_"), "h_doc_id")
    met = settled(shared.join(sketch, "doc_id").join(centres, "key").select(
        "key", "doc_id", "n", *_BITS, F.col("h_doc_id").alias("head"), F.expr(_alike("", "h_")).alias("near")
    ))
    stars = met.filter("near and doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _links(stars, texts)
    roots = connected(links)

    placed = met.drop("near").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    largest = placed.groupBy("key", "root").count().groupBy("key").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots")
    ).filter("roots > 1").drop("roots")
    split = settled(placed.join(largest, "key"))
    if split.take(1):
        links = links.unionByName(_links(_open_pairs(split, texts), texts))
        roots = connected(links)

    rooted = classes.join(roots.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "f1", "f2", "rep", "last", F.coalesce("root", "rep").alias("root")
    )
    moved = rooted.filter("root <> rep or rep <> last").select("f1", "f2", "root")
    return signatures.join(moved, ["f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those that a kept one of their component stands for, columns unchanged.

    A bit map of the ids that go passes the other rows on where they stand; only the rest is joined, so texts that
    stay are not moved. Rows with a null doc_id stay; of repeated rows with one doc_id, one stays.
    """
    found = settled(components(documents))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_nc_gone")).distinct()
    gone = settled(gone)
    bits = bitmap(gone, F.xxhash64("_nc_gone"))
    placed = documents.withColumn("_nc_at", F.coalesce(F.xxhash64(F.col("doc_id").cast("long")), F.lit(0)))

    def sieved(marked: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same = passes(bits, batch.column("_nc_at").to_numpy(zero_copy_only=False)) == marked
                yield batch.filter(pa.array(same)).drop_columns(["_nc_at"])

        return placed.mapInArrow(keep, documents.schema)

    maybe = sieved(True)
    rows = sieved(False).unionByName(maybe.join(gone, maybe["doc_id"] == gone["_nc_gone"], "left_anti"))
    again = settled(
        found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    )
    if not again.take(1):
        return rows
    marks = again.select(F.col("doc_id").alias("_nc_again"))
    repeated = rows.join(marks, rows["doc_id"] == marks["_nc_again"], "left_semi").dropDuplicates(["doc_id"])
    return rows.join(marks, rows["doc_id"] == marks["_nc_again"], "left_anti").unionByName(repeated)
