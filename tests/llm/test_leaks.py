"""SimHash decontamination against all windows compared directly."""

import random
from collections import Counter

import numpy as np

from foliary.llm import leaks

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"


def words(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)}).split()


def shingles(window):
    return Counter(tuple(window[i : i + 5]) for i in range(max(1, len(window) - 4)))


def brute(docs, items):
    found = set()
    for d, text in docs:
        own = words(text)
        for item, passage in items:
            want = words(passage)
            size = min(len(own), len(want))
            for s in range(len(own) - size + 1 if size else 0):
                a, b = shingles(own[s : s + size]), shingles(want)
                if sum((a & b).values()) >= 0.75 * sum((a | b).values()):
                    found.add((d, item))
    return found


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)


def test_equals_all_windows(spark):
    draw = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(pool) for _ in range(draw.choice([2, 4, 5, 9, 20, 33, 60])))) for i in range(30)]
    docs = []
    for d in range(120):
        text = [draw.choice(pool) for _ in range(draw.choice([0, 3, 10, 90, 400]))]
        for _ in range(draw.choice([0, 1, 2])):
            own = words(draw.choice(items)[1])
            for _ in range(draw.choice([0, 0, 1, 2])):
                k = draw.randrange(len(own))
                own[k : k + 1] = draw.choice([[], ["zz"], [own[k], "yy"]])
            at = draw.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, draw.choice([" ", "\n", "\t "]).join(text).upper()))
    expected = brute(docs, items)
    documents, benchmark = frames(spark, docs, items)
    for block in (leaks.BLOCK_CHARS, 900):
        rows = leaks.findings(documents, benchmark, block).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == expected
    texts = dict(docs)
    for r in rows:
        window = words(texts[r.doc_id][r.start : r.end])
        a, b = shingles(window), shingles(words(dict(items)[r.item_id]))
        assert abs(r.similarity - sum((a & b).values()) / sum((a | b).values())) < 1e-9
        assert r.hamming <= leaks.RADIUS
    left = leaks.clean_documents(documents, benchmark)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} == set(texts) - {d for d, _ in expected}


def test_cases(spark):
    passage = "É one two three four five six seven"
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (4, "x " * 50_000 + passage), (5, "one two")]
    documents, benchmark = frames(spark, docs, [(7, passage), (8, passage), (None, passage), (9, None), (10, " ")])
    rows = leaks.findings(documents, benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == Counter(
        {(d, i): n for d, n in ((3, 2), (None, 1), (4, 1)) for i in (7, 8, None)}
    )
    assert {(r.start, r.end) for r in rows if r.doc_id == 4} == {(100_000, 100_000 + len(passage))}
    assert sorted(r.doc_id for r in leaks.clean_documents(documents, benchmark).collect()) == [1, 2, 5]
    empty, none = frames(spark, [], [])
    assert leaks.findings(empty, benchmark).collect() == [] and leaks.findings(documents, none).collect() == []
    assert leaks.clean_documents(documents, none).count() == len(docs)


def test_radius_is_guaranteed():
    """Every fingerprint within the radius is found, none beyond it."""
    draw = random.Random(1)
    items = [draw.getrandbits(64) for _ in range(40)]
    prints = []
    for _ in range(300):
        x = draw.choice(items)
        for bit in draw.sample(range(64), draw.randrange(leaks.RADIUS - 3, leaks.RADIUS + 4)):
            x ^= 1 << bit
        prints.append(x)
    which, item, distance = leaks.Blocks(np.array(items, np.uint64)).within(np.array(prints, np.uint64))
    expected = {(i, j): (x ^ y).bit_count() for i, x in enumerate(prints) for j, y in enumerate(items)}
    assert dict(zip(zip(which.tolist(), item.tolist()), distance.tolist())) == {k: v for k, v in expected.items() if v <= leaks.RADIUS}


def test_contiguous_edits_at_the_threshold_are_within_the_radius():
    """Edits of one block or at the end, as long as the similarity allows, in items of distinct words."""
    draw, none = np.random.default_rng(11), np.zeros(1, np.int64)
    for length, inner, end in ((50, 2, 6), (100, 9, 13), (200, 24, 28), (500, 66, 70)):
        for _ in range(150):
            item = draw.integers(1, 1 << 63, length, dtype=np.uint64)
            block, shifted = item.copy(), np.concatenate([item[end:], draw.integers(1, 1 << 63, end, dtype=np.uint64)])
            at = draw.integers(5, length - inner - 5)
            block[at : at + inner] = draw.integers(1, 1 << 63, inner, dtype=np.uint64)
            for other in (block, shifted):
                assert leaks.weighted_similarity(leaks.window_shingles(item), leaks.window_shingles(other)) >= leaks.SIMILARITY
                prints = [leaks.simhash(leaks.bit_sums(x), none, length) for x in (item, other)]
                assert len(leaks.Blocks(prints[0]).within(prints[1])[0]) == 1
