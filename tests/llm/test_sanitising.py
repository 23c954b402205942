"""Personal data: base spans against plain loops, disclosing terms against counts by hand."""

import math
import random
import re
import sys
import time
from collections import defaultdict
from hashlib import sha256

import numpy as np

from pyspark.sql import functions as F

from foliary.llm import sanitising
from foliary.llm.bitmaps import bitmap, passes

SCHEMA = "doc_id long, text string, spans string, n_ip int"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    out += [("email", *m.span(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span(), m[0]) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for kind, pattern, good in (
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 8 <= len(d) <= 15),
    ):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if good(digits):
                out.append((kind, *m.span(), digits))
    return out


def terms(docs):
    """Spans of disclosing terms by document, from counts over all documents."""
    def words(text):
        out = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            a, b = m.span()
            for _ in range(3):
                a += a < b and text[a] in MARKS
                b -= a < b and text[b - 1] in MARKS
            if a < b:
                out.append((a, b))
        return out

    near, having, containing = defaultdict(set), defaultdict(set), defaultdict(set)
    places = defaultdict(set)
    for row, (_, text) in enumerate(docs):
        text, spans = text or "", base(text)
        own = words(text)
        for a, b in own:
            containing[text[a:b].lower()].add(row)
        for kind, s, e, value in spans:
            before, after = [w for w in own if w[1] <= s], [w for w in own if w[0] >= e]
            for a, b in before[-sanitising.WINDOW :] + after[: sanitising.WINDOW]:
                if len(text[a:b].encode()) >= sanitising.LEAST_BYTES and all(b <= x[1] or a >= x[2] for x in spans):
                    term = text[a:b].lower()
                    near[(kind, value), term].add(row)
                    having[kind, value].add(row)
                    places[(kind, value), term, row].add((a, b))
    out = defaultdict(set)
    for (entity, term), rows in near.items():
        bits = -math.log2(len(having[entity]) / len(docs))
        revealed = math.log2(len(rows) / len(containing[term])) + bits
        if len({docs[r][1] for r in rows}) >= sanitising.SUPPORT and bits > 0 and revealed >= sanitising.DISCLOSURE * bits:
            for r in rows:
                out[r] |= places[entity, term, r]
    return out


MARKS = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}


def expected(docs):
    found, rows = terms(docs), []
    for r, (d, text) in enumerate(docs):
        spans = base(text)
        listed = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
        extra = [f"term:{a}:{b}" for a, b in sorted(found[r])]
        rows.append((d, *(sum(s[0] == k for s in spans) for k in sanitising.KINDS), sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + extra)))
    return sorted(rows, key=repr)


def report(spark, docs):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    return frame, sorted(map(tuple, sanitising.report(frame).collect()), key=repr)


def test_equals_plain_loops(spark):
    draw = random.Random(12)
    pool = [f"wörd{i}" for i in range(300)]
    people = [("ann@mail.example.com", "Badge,"), ("+44 20 7946 0958", "(ZÜRICH)"), ("4539 1488 0343 6467", "kestrel."), ("10.1.2.3", "harbour")]
    junk = ["1.2.3.999", "a@b", "4539148803436468", "+12", "12.5", "1.2.3.4.5", "x@y.z-", "+1 (988) 555-2485", "0-0 0", "a@b.c@d.e", "+", "999.1.1.1.1"]
    docs = []
    for d in range(300):
        text = [draw.choice(pool) for _ in range(draw.choice([0, 2, 30, 90]))]
        for _ in range(draw.choice([0, 0, 1])):
            value, mark = draw.choice(people)
            at = draw.randrange(len(text) + 1)
            text[at:at] = [mark, draw.choice(pool), value] if draw.random() < 0.8 else [value]
        for _ in range(draw.choice([0, 1])):
            text.insert(draw.randrange(len(text) + 1), draw.choice(junk))
        docs.append((d, draw.choice([" ", "\n"]).join(text)))
    docs += docs[:5] + [(900, None), (901, ""), (None, "me@x.org"), (902, "y " * 60_000 + "ann@mail.example.com Badge")]
    frame, found = report(spark, docs)
    assert found == expected(docs)
    assert any("term:" in r[-1] for r in found)
    clean = sanitising.sanitised(frame)
    assert clean.columns == frame.columns
    texts = [r.text or "" for r in clean.collect()]
    assert len(texts) == len(docs) and not any(base(t) for t in texts) and any("<term" in t for t in texts)


def test_random_patterns():
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choice("0123456789" * 3 + "+-. ()@ab%é\n") for _ in range(draw.randrange(1, 60)))
        assert sanitising.base_spans(text) == base(text), repr(text)


def test_long_runs_and_odd_numbers():
    start = time.time()
    for text in ("a" * 1_000_000 + "@", "a." * 500_000 + "@x", "@" * 300_000, "a@b" * 300_000, "1" * 1_000_000, "1." * 500_000, "+1" + "( " * 500_000, "1 " * 500_000, "a@" + "b-" * 500_000):
        sanitising.base_spans(text)
    assert time.time() - start < 60
    sys.set_int_max_str_digits(0)  # for the plain loop
    for text in ("1.2.3." + "4" * 5_000, "0" * 5_000 + "1.2.3.4", "1.2.3.4.5.6.7.8.9", "1.2.3.256.1.1.1.1", "a@b.c@d.e", "x..y@-.-", "a@b.c.d.@e.f"):
        assert sanitising.base_spans(text) == base(text), text[:40]


def test_rows_with_one_id(spark):
    rows = [(1, "mail one@example.org now"), (1, "another text entirely, of one@example.org too"), (1, "nothing here"), (None, "one@example.org")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _row string")
    left = sorted((str(r.doc_id), r.text) for r in sanitising.sanitised(frame).collect())
    assert left == sorted((str(d), t.replace("one@example.org", "<email>")) for d, t in rows)


def test_terms_far_from_the_value(spark):
    fill = " ".join(f"f{i % 7}" for i in range(40))
    docs = [(d, f"Dear Li Quentin {fill} Yours {d} at q@mail.example.com {fill} quentin") for d in range(4)]
    docs += [(d, f"Dear all {fill} Yours") for d in range(10, 60)]
    found = {r[0]: r[-1].split(",") for r in report(spark, docs)[1]}
    for d, text in docs[:4]:
        assert [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in found[d]) if k == "term"] == ["Li", "Quentin", "at", "quentin"]
    assert not any("term" in x for d in range(10, 60) for x in found[d])


def test_none(spark):
    assert report(spark, [])[1] == [] and report(spark, [(1, "plain"), (2, None)])[1] == expected([(1, "plain"), (2, None)])


def test_bitmap(spark):
    draw = random.Random(7)
    values = [draw.getrandbits(64) - (1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    found = bitmap(spark.createDataFrame([(v,) for v in values], "term long"), F.col("term"))
    assert passes(found, np.array(values)).all() and not passes(found, np.array([v ^ (1 << 45) for v in values[:500]])).all()
    bits = np.unpackbits(found, bitorder="little")
    assert set(np.flatnonzero(bits).tolist()) == {(v % (1 << 64)) >> 40 for v in values}
