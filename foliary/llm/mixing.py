"""Mixing sources to target weights by exact token lengths: counts by length, bounded knapsack, seeded picks.

Sizes are words. Sources in code point order, null last, weigh 3, 1, 2 and so on again; together they
share 150 % of all words. A target stops at twice its source's size, and what is above is shared again
by weight among the others until none is above.

A source first takes all its documents as often as its target holds its whole size (0, 1 or 2 times).
The rest of the target is fitted by length: documents of a source are counted by exact length, each
length gives its proportional share, a bounded knapsack over the lengths that have documents left
fits what then remains, and of each length as many documents are taken as the fit says, in the order
of a seeded hash. Only lengths, not documents, meet in one task: a source of n words has fewer than
sqrt(2 n) of them. Which documents of a length go is decided inside small hash buckets, so that a
length shared by any share of all rows is no single group.

Cases: a null or empty text has size 0 and takes 0; repeated rows are each a document; a null source is
a source of its own, apart from the empty name; a null doc_id is hashed like any value; an empty table
gives an empty result; further columns pass through `allotted` and `mixed`, names used inside begin
with `_mx_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm.columns import WORD, whole
from foliary.operators.sizing import number_sorted, settled

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT, MOST_TIMES = 150, 2
SEED = 20_240_229
#: Words that the knapsack fits exactly; what is above it is given out by length first, as long as documents fit.
KNAPSACK_WORDS = 1 << 16


def source_key(source: Column) -> Column:
    """A join key that is never null: null apart from every name."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def sized(documents: DataFrame) -> DataFrame:
    """The documents with their key of source, size in words, seeded hash and hash bucket."""
    return documents.withColumns({
        "_mx_source": source_key(F.col("source").cast("string")),
        "_mx_size": F.regexp_count(whole(F.col("text").cast("string")), F.lit(WORD)).cast("long"),
        "_mx_hash": F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
    }).withColumn("_mx_bucket", F.shiftright("_mx_hash", 54))


def targets(sizes: DataFrame) -> DataFrame:
    """(_mx_source, _mx_source_size, _mx_target) from the counts by source, size and bucket.

    The level of words per weight rises as sources reach their caps. Each step is one row of sums over
    the table of sources; the driver holds two numbers.
    """
    totals = settled(
        sizes.groupBy("_mx_source").agg(F.sum(F.col("_mx_size") * F.col("_mx_count")).alias("_mx_source_size"))
        .withColumn("_mx_null", F.col("_mx_source") == "n")
    )
    ranked = settled(number_sorted(totals, ["_mx_null", "_mx_source"], "_mx_rank").withColumn(
        "_mx_weight", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("_mx_rank") - 1) % len(WEIGHTS)).cast("int"))
    ))
    cap = F.col("_mx_source_size") * MOST_TIMES
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("_mx_weight") > cap
        row = ranked.agg(
            F.sum("_mx_source_size").alias("all"), F.sum(F.when(above, cap)).alias("capped"),
            F.sum(F.when(~above, F.col("_mx_weight"))).alias("weights"), F.count_if(above).alias("n"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        capped = row["n"]
        level = (row["all"] * TOTAL_PERCENT / 100 - (row["capped"] or 0)) / row["weights"]
    return ranked.select(
        "_mx_source", "_mx_source_size", F.least(cap.cast("double"), F.lit(level) * F.col("_mx_weight")).alias("_mx_target")
    )


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, limit: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each size to take for about `budget` words in all.

    The proportional share of each size is taken first, then one more of the sizes with the largest
    remainders while more than `limit` words are left, then what `_filled` finds for the rest. Where that
    misses the budget, it fills the plain shares, and then nothing, as well, and the nearest counts.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:  # what is left out is fitted, so that documents of every size stay free to choose
        return counts - fit(sizes, counts, total - budget, limit)
    share = counts * (budget / total)
    floors = np.floor(share).astype(np.int64)
    taken, rest = floors.copy(), budget - int((sizes * floors).sum())
    for i in np.argsort(-(share - floors), kind="stable"):
        if rest <= limit:
            break
        if taken[i] < counts[i] and sizes[i] <= rest:
            taken[i] += 1
            rest -= int(sizes[i])
    best, most = taken, -1
    for start in (taken, floors, np.zeros_like(floors)):
        found = _filled(sizes, counts, start, budget, limit)
        words = int((sizes * found).sum())
        if words > most:
            best, most = found, words
        if most == budget:
            break
    return best


def _filled(sizes: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int, limit: int) -> np.ndarray:
    """`taken` and further documents, until the budget is met or no document fits what is left of it.

    Sizes above `limit` are used where the shorter documents cannot bring the rest down to it; they are
    fitted in units of some words, rounded up, which get smaller with the rest. Shorter sizes are then given
    out by proportion and, the longest first, in full. The knapsack's exact fit ends it.
    """
    taken, rest, long = taken.copy(), budget - int((sizes * taken).sum()), sizes > limit
    while rest > limit + int((sizes * (counts - taken))[~long].sum()):
        unit = -(-rest // limit)
        more = knapsack(np.where(long, -(-sizes // unit), 0), counts - taken, rest // unit)
        fitting = np.flatnonzero(long & (counts > taken) & (sizes <= rest))
        if not len(fitting):
            break
        longest = fitting[np.argmax(sizes[fitting])]
        if int((sizes * more).sum()) < sizes[longest]:  # lost in rounding up
            more = (np.arange(len(sizes)) == longest).astype(np.int64)
        taken += more
        rest -= int((sizes * more).sum())
    left = np.where(long, 0, counts - taken)
    words = int((sizes * left).sum())
    if rest > limit and words:
        more = np.floor(left * min(1.0, (rest - limit) / words)).astype(np.int64)
        taken += more
        rest -= int((sizes * more).sum())
        for i in np.argsort(-sizes, kind="stable"):
            if rest <= limit:
                break
            if not long[i] and sizes[i]:
                some = min(int(counts[i] - taken[i]), -(-(rest - limit) // int(sizes[i])))
                taken[i] += some
                rest -= some * int(sizes[i])
    return taken + knapsack(sizes, counts - taken, min(rest, limit))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most `counts`) sum up to the largest value not above the budget.

    Reachable sums are the bits of one integer. Counts are split into powers of two, and the sums
    before each step are kept to walk back; an exact hit ends it.
    """
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i, size in enumerate(sizes.tolist()):
        if not 0 < size <= budget:
            continue
        left, chunk = min(int(counts[i]), budget // size), 1
        while left > 0:
            some = min(chunk, left)
            steps.append((i, some, reach))
            reach |= (reach << (some * size)) & mask
            left, chunk = left - some, chunk * 2
        if reach >> budget & 1:
            break
    best, taken = reach.bit_length() - 1, np.zeros(len(sizes), np.int64)
    for i, some, before in reversed(steps):
        if not before >> best & 1:
            taken[i] += some
            best -= some * int(sizes[i])
    return taken


def _fitted(lengths: pd.DataFrame) -> pd.DataFrame:
    lengths = lengths.sort_values("_mx_size")
    size, target = int(lengths["_mx_source_size"].iloc[0]), float(lengths["_mx_target"].iloc[0])
    times = min(MOST_TIMES, int(target // size)) if size else 0
    extra = fit(
        lengths["_mx_size"].to_numpy(), lengths["_mx_count"].to_numpy(), round(target) - times * size
    ) if times < MOST_TIMES and size else np.zeros(len(lengths), np.int64)
    return lengths[["_mx_source", "_mx_size"]].assign(_mx_times=times, _mx_extra=extra)


def quotas(rows: DataFrame) -> DataFrame:
    """(_mx_source, _mx_size, _mx_bucket, _mx_source_size, _mx_target, _mx_times, _mx_quota): how many documents
    of each bucket are taken once more than `_mx_times` times."""
    counts = settled(rows.groupBy("_mx_source", "_mx_size", "_mx_bucket").agg(F.count(F.lit(1)).alias("_mx_count")))
    aims = settled(targets(counts))
    lengths = counts.groupBy("_mx_source", "_mx_size").agg(F.sum("_mx_count").alias("_mx_count")).join(aims, "_mx_source")
    picks = settled(lengths.groupBy("_mx_source").applyInPandas(
        _fitted, "_mx_source string, _mx_size long, _mx_times int, _mx_extra long"
    ))
    before = Window.partitionBy("_mx_source", "_mx_size").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_mx_extra") - F.coalesce(F.sum("_mx_count").over(before), F.lit(0))
    return (
        counts.join(picks, ["_mx_source", "_mx_size"])
        .withColumn("_mx_quota", F.greatest(F.lit(0), F.least(left, F.col("_mx_count"))))
        .drop("_mx_count", "_mx_extra").join(aims, "_mx_source")
    )


def allotted(documents: DataFrame) -> DataFrame:
    """The documents with `_mx_size`, `_mx_source_size`, `_mx_target` and `_mx_copies`, the times a document is taken.

    One narrow pass counts; then each document meets its bucket's quota, and the first of a bucket by
    the seeded hash are taken.
    """
    rows = sized(documents)
    keys = ["_mx_source", "_mx_size", "_mx_bucket"]
    narrow = sized(documents.select("doc_id", "source", "text")).select(*keys)
    order = Window.partitionBy(*keys).orderBy("_mx_hash", "doc_id")
    return (
        rows.join(quotas(narrow), keys)
        .withColumn("_mx_copies", F.col("_mx_times") + (F.row_number().over(order) <= F.col("_mx_quota")).cast("int"))
        .drop("_mx_source", "_mx_bucket", "_mx_hash", "_mx_times", "_mx_quota")
    )


def taken_words(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    The sizes are written once; the texts are read once and not moved.
    """
    rows = settled(sized(documents.select("doc_id", "source", "text")).drop("text"))
    keys = ["_mx_source", "_mx_size", "_mx_bucket"]
    order = Window.partitionBy(*keys).orderBy("_mx_hash", "doc_id")
    return rows.join(quotas(rows.select(*keys)), keys).select(
        "doc_id", F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"),
        (F.col("_mx_size") * (F.col("_mx_times") + (F.row_number().over(order) <= F.col("_mx_quota")).cast("int"))).alias("taken"),
    )


def mixed(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, columns unchanged."""
    return allotted(documents).withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).filter(
        "_mx_copies > 0"
    ).select(*documents.columns)
