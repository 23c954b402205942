"""HyperMinHash near copies against all pairs of full shingle sets."""

import random

from foliary.llm import nearcopies

SCHEMA = "doc_id long, text string, n long"


def shingles(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").split() if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and sets[a] and sets[b] and 100 * both >= 75 * either and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in ids}


def found(spark, rows):
    frame = spark.createDataFrame([(d, t, 7) for d, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nearcopies.components(frame).collect()}


def test_equals_all_pairs(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for d in range(60):
        base.append([draw.choice(words) for _ in range(draw.choice([1, 3, 5, 8, 20, 60, 200]))])
        rows.append((d, " ".join(base[-1])))
    for d in range(60, 330):  # copies that drift from one another, some just over and some just under the threshold
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
            text[draw.randrange(len(text))] = draw.choice(words)
        if draw.random() < 0.3:
            base.append(text)
        rows.append((d, "\n ".join(text).upper() if d % 7 == 0 else " ".join(text)))
    assert found(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [(4, None), (5, ""), (6, " \n\t"), (1, "a b c d e f"), (2, "A  b C\nd e f"), (3, "É b c"), (7, "é b c"), (8, "x"), (9, "X")]
    assert found(spark, rows) == {
        4: (0, 4), 5: (0, 5), 6: (0, 6), 1: (2, 1), 2: (2, 1), 3: (1, 3), 7: (1, 7), 8: (1, 8), 9: (1, 8)
    }
    assert found(spark, []) == {}
    frame = spark.createDataFrame([(None, "a b c", 1), (1, "a b c", 2), (1, "a b c", 2), (3, "a b c", 2)], SCHEMA)
    got = sorted(map(tuple, nearcopies.components(frame).collect()), key=repr)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (None, 1, None, True)]
    left = nearcopies.one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted(map(tuple, left.collect()), key=repr) == [(1, "a b c", 2), (None, "a b c", 1)]


def test_hot_group_of_copies_without_a_centre(spark):
    """Copies that are each near some but not the smallest one; the star round alone would lose links."""
    line = [f"t{i}" for i in range(260)]
    rows = [(d, " ".join(line[d * 8 : d * 8 + 120])) for d in range(17)]
    assert found(spark, rows) == brute(rows)
    assert {root for _, root in found(spark, rows).values()} == {0}
