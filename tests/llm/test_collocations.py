"""Collocations against plain counting loops."""

import random
import re
from collections import Counter, defaultdict

from foliary.llm import collocations

DOCS = "doc_id long, text string, lang string, n long, w1 string, _bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], DOCS)


def brute(rows, least, top):
    found, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        plain = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            own = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(own)
            for size in (1, 2, 3):
                for i in range(len(own) - size + 1):
                    found[lang][tuple(own[i : i + size])] += 1
    out = []
    for lang, f in found.items():
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rows = []
        for p, a in f.items():
            if len(p) == 1 or a < least or (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def test_against_loops(spark):
    random.seed(3)
    vocabulary = ["The", "the", "é", "É", "a\xa0b", "x", "yy", "Z", "…", "w1"]
    rows = []
    for k in range(120):
        words = random.choices(vocabulary, weights=range(10, 0, -1), k=random.randrange(60))
        text = "".join(w + random.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ! ", " "]) for w in words)
        rows.append((text, ["en", "de", None, "und", ""][k % 5]))
    rows += [(None, "en"), ("", None), ("...", "none"), (rows[0][0], "en"), ("alone", "one"), ("same same " * 30_000, "long")]
    for least, top in ((10, 2000), (2, 7), (1, 25)):
        assert sorted(map(tuple, collocations.collocations(docs(spark, rows), least, top).collect())) == brute(rows, least, top)


def test_counts_that_pass_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", "a", "", "", 1, 9 * 10**14), ("en", "b", "", "", 1, 8 * 10**14), ("en", "a", "b", "", 2, 7 * 10**14 + 1)],
        "lang string, w1 string, w2 string, w3 string, size int, n long",
    )
    (row,) = collocations.scored_candidates(counts).collect()
    assert row.score == 10**6 * (7 * 10**14 + 1) ** 2 // (72 * 10**28)


def test_empty_table(spark):
    assert collocations.collocations(docs(spark, [])).collect() == []
    assert collocations.collocations(docs(spark, [(None, None)])).collect() == []
