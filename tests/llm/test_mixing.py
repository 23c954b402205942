"""Source mixing: targets by hand, the knapsack against all subsets, fits near their targets."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from foliary.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def aims(sizes):
    """Targets by the rule, one source after another over its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return frame, mixing.taken_words(frame).collect()


def test_mix_is_near_its_targets(spark):
    draw = random.Random(4)
    rows = [(d, " w\t" * draw.randrange(0, 300), draw.choice(["b", "b", "b", "a", "", None, "ä", "z", "rare"] if d < 900 else ["b"])) for d in range(1500)]
    rows += [(d, "same text here", "b") for d in range(2000, 2700)] + [(7, "x y", "a"), (7, "x y", "a"), (None, "q", "z"), (8, None, "z")]
    frame, found = run(spark, rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = aims(sizes)
    by_target = {round(v, 6): s for s, v in expected.items()}
    taken = defaultdict(int)
    for r in found:
        s = by_target[round(r.target, 6)]
        assert r.source_size == sizes[s] and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.taken_words(frame.repartition(5)).collect()))
    copies = mixing.mixed(frame)
    assert copies.columns == frame.columns
    words = Counter()
    for r in copies.collect():
        words[r.source] += len((r.text or "").split())
    assert words == Counter({s: n for s, n in taken.items() if n})


def test_empty(spark):
    frame, found = run(spark, [])
    assert found == [] and mixing.mixed(frame).collect() == []
    assert [r.taken for r in run(spark, [(1, None, None), (2, "", "a")])[1]] == [0, 0]


def test_knapsack_equals_all_subsets():
    draw = random.Random(9)
    for _ in range(200):
        sizes = np.array(sorted(draw.sample(range(0, 30), 4)))
        counts = np.array([draw.randrange(0, 4) for _ in sizes])
        budget = draw.randrange(0, 60)
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        sums = [sum(int(k) * int(s) for k, s in zip(ks, sizes)) for ks in itertools.product(*[range(c + 1) for c in counts])]
        assert int((taken * sizes).sum()) == max(x for x in sums if x <= budget)


def test_fit_with_more_left_than_the_knapsack_holds():
    draw = random.Random(8)
    sizes = np.array(sorted(draw.sample(range(1, 20_000), 700)))
    counts = np.array([draw.randrange(1, 5) for _ in sizes])
    for share in (0.01, 0.3, 0.77, 0.999):
        budget = int((sizes * counts).sum() * share)
        taken = mixing.fit(sizes, counts, budget)
        assert (taken <= counts).all() and abs(int((taken * sizes).sum()) - budget) <= 1


def test_fit_leaves_no_words_while_documents_fit():
    sizes, counts = np.array([100, 900_000, 1_000_000]), np.array([50_000, 1, 1])
    taken = mixing.fit(sizes, counts, 2_760_000)
    assert (taken <= counts).all() and int((taken * sizes).sum()) == 2_760_000
    # Long documents alone: the best two of three, one that is the whole rest, and short ones that do not suffice.
    sizes, counts = np.array([260_000, 500_000, 600_000, 700_000]), np.ones(4, np.int64)
    assert mixing.fit(sizes, counts, 760_000).tolist() == [1, 1, 0, 0]
    sizes, counts = np.array([100, 99_999, 700_001, 900_000]), np.array([10, 1, 1, 1])
    assert mixing.fit(sizes, counts, 700_001).tolist() == [0, 0, 1, 0]
    draw = random.Random(5)
    for _ in range(200):
        sizes = np.array(sorted({*draw.sample(range(1, 500), 6), *draw.sample(range(300, 20_000), 6)}))
        counts = np.array([draw.choice([1, 1, 3, 400]) for _ in sizes])
        budget = int((sizes * counts).sum() * draw.random() / 2)
        taken = mixing.fit(sizes, counts, budget, limit=1000)
        left = budget - int((taken * sizes).sum())
        assert (taken >= 0).all() and (taken <= counts).all() and left >= 0
        assert not (sizes[taken < counts] <= left).any()
