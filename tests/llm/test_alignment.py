"""Alignment against a plain loop that compares byte ranges of whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliary.llm import alignment
from foliary.llm.tokens import byte_alphabet

DOCS = "doc_id long, text string, pair string, row long"
TEXTS = [
    "Plain words, some of them repeated words.", "", None, "a", " ", "  two  blanks  ", "naïve café — “quoted”…", "漢字 and 𓀀𓀁 mixed é́ 한국어",
    "tabs\tand\nlines\r\n\n x", "<|endoftext|> <s> </s> <unk> <0x41>", "has ▁ the mark", "emoji 👩‍👩‍👧‍👦 family", "\xa0nbsp\xa0 a 　 wide", "Plain words, some of them repeated words.",
    "don't we'll I'd 12345 3.14 --==", "\x00\x01 control", "x" * 3000, "ﬁ ligature Å Å", " a", "b ", "…", "end  .", "a é b́ c",
]


def docs(spark, texts):
    return spark.createDataFrame([(i // 2 if i < 6 else i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def brute(texts):
    a, b = alignment.default_paths()
    own = alignment.Aligner(a, b)
    alphabet = byte_alphabet()
    rows = []
    for text in texts:
        ids_a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = own.b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in own.a.id_to_token(i)) for i in ids_a]
        bytes_b = [own.bytes_b[i] for i in ids_b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append(None)
            continue
        ends_a = [sum(map(len, bytes_a[: i + 1])) for i in range(len(ids_a))]
        ends_b = [sum(map(len, bytes_b[: i + 1])) for i in range(len(ids_b))]
        groups, at = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            left = [str(i) for i, e in zip(ids_a, ends_a) if at < e <= end]
            right = [str(i) for i, e in zip(ids_b, ends_b) if at < e <= end]
            groups.append(",".join(left) + "|" + ",".join(right))
            at = end
        links = [
            (x, y) for x, ex, bx in zip(ids_a, ends_a, bytes_a) for y, ey, by in zip(ids_b, ends_b, bytes_b)
            if max(ex - len(bx), ey - len(by)) < min(ex, ey)
        ]
        rows.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(pair for row in rows if row for pair in set(row[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, row in enumerate(rows):
        doc = i // 2 if i < 6 else i
        if row is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        out.append((
            doc, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out)


@pytest.mark.parametrize("few", [alignment.FEW_PAIRS, 0])
def test_against_loop(spark, few):
    assert sorted(map(tuple, alignment.alignments(docs(spark, TEXTS), few=few).collect())) == brute(TEXTS)


def test_table_against_loop(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    texts = [r.text[:4000] for r in frame.collect()]
    assert sorted(map(tuple, alignment.alignments(docs(spark, texts)).collect())) == brute(texts)


def test_cut_ends():
    def ends(begins, stops, sizes):
        n = len(sizes)
        return alignment.cut_ends(*map(np.array, (begins, stops, sizes)), np.arange(n) == 0, np.zeros(n, int)).tolist()

    assert ends([0, 2, 2, 2, 5], [2, 5, 5, 5, 6], [2, 1, 1, 1, 1]) == [2, 3, 4, 5, 6]
    assert ends([0, 1, 1, 1], [1, 1, 1, 4], [1, 1, 1, 1]) == [1, 2, 3, 4]
    assert ends([0, 0, 0], [3, 3, 3], [1, 1, 1]) == [1, 2, 3]


def test_empty_table(spark):
    assert alignment.alignments(docs(spark, [])).collect() == []
    assert [tuple(r) for r in alignment.alignments(docs(spark, [None])).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]
