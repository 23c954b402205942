"""Toxicity: held-out accuracy, what scores may depend on, and the risk estimator's cases."""

import random
import zlib

import numpy as np

from foliary.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, source string, score string", "doc_id long, quality int, toxic int"


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def corpus(seed, count):
    draw = random.Random(seed)
    pool = [f"word{i}" for i in range(2000)]
    docs, toxic = [], {}
    for d in range(count):
        text = [draw.choice(pool) for _ in range(draw.choice([5, 80, 300]))]
        toxic[d] = int(draw.random() < 0.15)
        for _ in range(draw.randrange(2, 6) if toxic[d] else 0):
            text.insert(draw.randrange(len(text)), draw.choice(["Vile,", "(scoundrel)", f"grobian{draw.choice(['s', 'en', 'ich'])}."]))
        docs.append((d, " ".join(text)))
    return docs, toxic


def run(spark, docs, toxic):
    frame = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], DOCS)
    labels = spark.createDataFrame([(d, 1, v) for d, v in toxic], LABELS)
    return toxicity.scored(frame, labels).collect()


def test_held_out_accuracy(spark):
    docs, toxic = corpus(1, 1500)
    labelled = [(d, v) for d, v in toxic.items() if d % 3]
    found = run(spark, docs, labelled)
    assert {r.doc_id: r.held_out for r in found} == {d: held(d) for d, _ in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    judged = [(toxic[r.doc_id], r.predicted) for r in found if r.held_out]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert sum(b for a, b in judged if a) >= 0.85 * sum(a for a, _ in judged)
    # Held-out labels are not learnt from, and the same rows give the same scores.
    turned = [(d, 1 - v if held(d) else v) for d, v in labelled]
    again = {r.doc_id: r.score for r in run(spark, docs[::-1], turned)}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in found)


def test_cases(spark):
    docs, toxic = corpus(2, 400)
    docs += [(5000, None), (5001, ""), (5002, "vile scoundrel " * 30_000), (None, "vile scoundrel"), (3, docs[3][1])]
    found = run(spark, docs, [*toxic.items(), (7, None), (None, 1), (8, toxic[8])])
    assert len(found) == len(docs)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5000].score == by_id[5001].score < 0.3 and by_id[5002].predicted == 1
    assert by_id[None].held_out is False and by_id[None].predicted == 1
    assert {r.score for r in run(spark, docs, [(1, 0)])} == {0.0}
    assert run(spark, [], []) == []


def test_negative_risk_is_walked_back():
    """Unlabelled texts that look less toxic than the prior claims: the estimate would fall below zero."""
    toxic = [np.array([0]) for _ in range(50)]
    weights, bias = toxicity.trained(toxic, [np.array([1]) for _ in range(400)], 0.4, 2)
    assert np.isfinite(weights).all() and weights[0] > weights[1] and 1 / (1 + np.exp(-(weights[0] + bias))) > 0.5
