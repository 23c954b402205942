"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other text is unlabelled: it holds toxic documents too,
at the rate of the class prior. A linear classifier over word features is trained with the estimator
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), whose second term would turn negative when the model
fits the unlabelled text too closely; a step that finds it negative walks it back up instead (Kiryo and
others, 2017).

Features of a text are its distinct words without outer punctuation, and the first four and five bytes
of each, which inflected forms share. They are counted in Spark over the training sample. A feature's rate
among texts that are not toxic is its rate among the unlabelled less the prior's part of the toxic; the
`FEATURES` that toxic texts have most above that are kept, and every text is scored on whether it has them.

Bounds, as parameters: at most `POSITIVES` toxic and `UNLABELLED` other documents, chosen by a hash of
doc_id, are trained on; the driver holds their kept features only. The prior is the toxic share of all
training labels, and every document's whole text is scored.

Held out are documents whose crc32(doc_id as text) mod 4 is 2: neither their labels nor their texts are
trained on. Labels, lang, source and doc_id are no features.

Cases: a null or empty text has no features and gets the score of none; a null doc_id is not held out
and not trained on; several labels of one doc_id count as toxic if one is; without a toxic training
label all scores are 0; repeated rows are each scored; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.words import FOLDED_BYTE, Words, chunks, mix, span_hashes, stripped
from foliary.operators.sizing import settled

POSITIVES, UNLABELLED = 8_000, 16_000
#: A feature is kept if at least so many toxic texts have it, by more than so many standard errors, and if its
#: rate among texts that are not toxic is at most this share of its rate among toxic ones.
FEATURES, LEAST_DOCUMENTS, LEAST_ERRORS, MOST_SHARE = 4_096, 4, 3.0, 0.3
EPOCHS, BATCHES, RATE, DECAY, SEED = 20, 16, 0.05, 1e-3, 17
PREDICT_FROM = 0.3
_PREFIXES = (4, 5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every feature, repeats included."""
    text, start, end = stripped(words)
    texts, hashes = [text], [span_hashes(words.data, start, end, FOLDED_BYTE)]
    for size in _PREFIXES:
        long = end - start >= size
        hashes.append(mix(span_hashes(words.data, start[long], start[long] + size, FOLDED_BYTE) ^ np.uint64(size)))
        texts.append(text[long])
    return np.concatenate(texts), np.concatenate(hashes)


class Table:
    """Kept features by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.coarse = np.zeros(1 << 18, bool)
        self.coarse[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature place) of each text's distinct kept features, in order."""
        text, hashes = features(words)
        maybe = self.coarse[(hashes >> np.uint64(46)).astype(np.int64)]
        text, hashes = text[maybe], hashes[maybe]
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[place] == hashes
        both = np.unique(text[same] * len(self.hashes) + place[same])
        return np.divmod(both, len(self.hashes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, others): in how many texts of the batch each feature is."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, words in chunks(batch.column("text")):
            text, hashes = features(words)
            pairs = np.unique(np.rec.fromarrays([hashes, text]))
            known, place = np.unique(pairs.f0, return_inverse=True)
            own = toxic[first + pairs.f1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(known.view(np.int64)), pa.array(np.bincount(place[own], minlength=len(known))),
                    pa.array(np.bincount(place[~own], minlength=len(known))),
                ],
                ["feature", "toxic", "others"],
            )


def training_sample(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(toxic, text) of the training documents, and the class prior.

    Both id lists are bounded by their parameters, so they are sent to all tasks.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    order = F.xxhash64(F.lit(SEED), "doc_id")
    positive = known.filter("toxic = 1").orderBy(order, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("toxic"))
    other = documents.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(
        UNLABELLED
    ).select("doc_id", F.lit(False).alias("toxic")).distinct()
    ids = settled(positive.unionByName(other))
    return settled(documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "text")), share


def kept_features(sample: DataFrame, prior: float) -> np.ndarray:
    """Hashes of the features that set toxic texts apart, by the log ratio of the rates times their reach."""
    counts = sample.groupBy().agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).first()
    if not counts["p"] or not counts["u"] or not 0 < prior < 1:
        return np.zeros(0, np.uint64)
    one = 1 / counts["u"]
    toxic, free = F.col("toxic") / F.lit(counts["p"]), F.col("others") / F.lit(counts["u"])
    clean = F.greatest((free - prior * toxic) / (1 - prior), F.lit(one))
    error = F.sqrt(F.greatest(free, F.lit(one)) * (1 / counts["p"] + one))
    rows = (
        sample.mapInArrow(_counted, "feature long, toxic long, others long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
        .filter((F.col("toxic") >= LEAST_DOCUMENTS) & (clean < MOST_SHARE * toxic) & (toxic - free >= LEAST_ERRORS * error))
        .orderBy(F.desc(toxic * F.log(toxic / clean)), "feature").limit(FEATURES).select("feature").collect()
    )
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def _rows(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words in chunks(batch.column("text")):
            text, place = table.of(words)
            rows = len(words.offsets) - 1
            bounds = np.searchsorted(text, np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic")[first : first + rows], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place, pa.int32()))],
                ["toxic", "places"],
            )


def trained(toxic: list[np.ndarray], others: list[np.ndarray], prior: float, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier, from the feature places of each text."""
    draw = np.random.default_rng(SEED)
    weights, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    moments, squares, step = np.zeros(width + 1), np.zeros(width + 1), 0

    def part(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in chosen]
        return np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])

    def gradient(places: np.ndarray, row: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(places, slopes[row], width), slopes.sum())

    for _ in range(EPOCHS):
        orders = draw.permutation(len(toxic)), draw.permutation(len(others))
        for own, free in zip(*(np.array_split(o, BATCHES) for o in orders), strict=True):
            if not len(own) or not len(free):
                continue
            p, p_row = part(toxic, own)
            u, u_row = part(others, free)
            p_prob = 1 / (1 + np.exp(-(np.bincount(p_row, weights[p], len(own)) + bias)))
            u_prob = 1 / (1 + np.exp(-(np.bincount(u_row, weights[u], len(free)) + bias)))
            # Logistic losses: of the positives as positive, and of both as negative.
            surplus = -np.log1p(-np.minimum(u_prob, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p_prob, 1 - 1e-12)).mean()
            negative = gradient(u, u_row, u_prob / len(free)) - prior * gradient(p, p_row, p_prob / len(own))
            total = -negative if surplus < 0 else prior * gradient(p, p_row, (p_prob - 1) / len(own)) + negative
            total[:-1] += DECAY * weights
            step += 1
            moments = 0.9 * moments + 0.1 * total
            squares = 0.999 * squares + 0.001 * total**2
            move = RATE * (moments / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.999**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def _scored(batches: Iterator[pa.RecordBatch], table: Table | None, weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        if table is not None:
            for first, words in chunks(batch.column("text")):
                rows = len(words.offsets) - 1
                text, place = table.of(words)
                score[first : first + rows] = 1 / (1 + np.exp(-(np.bincount(text, weights[place], rows) + bias)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"]
        )


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sample, prior = training_sample(documents, labels)
    hashes = kept_features(sample, prior)
    table, weights, bias = None, np.zeros(0), 0.0
    if len(hashes):
        table = Table(hashes)
        found = sample.mapInArrow(lambda b: _rows(b, table), "toxic boolean, places array<int>").toArrow()
        toxic = found.column("toxic").to_numpy()
        # The order of collected rows may differ between runs; training must not.
        places = [np.array(x, np.int64) for x in found.column("places").to_pylist()]
        groups = [sorted((places[i] for i in np.flatnonzero(toxic == kind)), key=lambda x: x.tobytes()) for kind in (True, False)]
        weights, bias = trained(*groups, prior, len(hashes))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    out = rows.mapInArrow(lambda b: _scored(b, table, weights, bias), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
