"""Column-wise suffix sorting and substring dedup against plain loops."""

import hashlib
import random
import tempfile

import numpy as np
import pyarrow as pa

from foliary.llm import suffixes

DOCS = "doc_id long, text string, th long, start string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)


def brute(rows):
    """Bytes covered by a window that starts earlier too; equal rows are one document."""
    known, out = {}, {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = t.encode()
        covered = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            if known.setdefault(raw[i : i + 100], (d, t, i)) != (d, t, i):
                covered[i : i + 100] = True
        kept = bytes(b for b, gone in zip(raw, covered) if not gone)
        spans = int((covered[:-1] & ~np.concatenate([[False], covered[:-2]])[: len(raw)]).sum()) if raw else 0
        out[d, t] = (d, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[d, t or ""] for d, t in rows), key=repr)


def passages(seed, n=160):
    random.seed(seed)
    words = ["alpha", "beta", "é", "漢字", "gamma", "x", "delta-delta", "\n", "…"]
    prose = lambda k: " ".join(random.choice(words) + str(random.randrange(500)) for _ in range(k))
    shared = [prose(k) for k in (8, 12, 13, 14, 16, 30, 60, 300)]
    rows = []
    for i in range(n):
        text = prose(random.randrange(40))
        for _ in range(random.randrange(4)):
            part = random.choice(shared)
            text += random.choice(["", " ", "\n"]) + (part if random.random() < 0.7 else part[random.randrange(30) : -random.randrange(1, 30)])
            text += prose(random.randrange(20))
        rows.append((1000 - i if i % 2 else i, text))
    rows += [(5000 + i, rows[3][1]) for i in range(5)] + [(rows[4][0], rows[4][1]), (None, rows[8][1]), (None, rows[8][1])]
    rows += [(6000, "a" * 450), (6001, "ab" * 300), (6002, None), (6003, ""), (6004, "z" * 99), (6005, "z" * 100), (6006, "z" * 100), (6007, "z" * 101)]
    rows += [(7000, prose(30_000)), (7001, "tail " + rows[5][1])]
    return rows


def test_sorted_suffixes():
    random.seed(1)
    for size, letters in ((1, "a"), (7, "ab"), (40, "abc"), (60, "xyzé")):
        strings = ["".join(random.choices(letters, k=random.randrange(1, 140))).encode() for _ in range(size)]
        strings += strings[: size // 2]
        of, length, common = suffixes.sorted_suffixes(strings, suffixes.Columns(tempfile.mkdtemp(prefix="spark-")), depth=30)
        found = [strings[i][len(strings[i]) - n :] for i, n in zip(of, length)]
        assert sorted(zip(of.tolist(), length.tolist())) == sorted((i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
        assert found == sorted(found)
        for a, b, n in zip(found, found[1:], common[1:]):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == min(same, 30)


def test_against_loop(spark):
    rows = passages(5)
    for hot, part in ((suffixes.HOT, suffixes.PART_BYTES), (2, 3_000)):
        found = suffixes.deduplicated(docs(spark, rows), keep=False, hot=hot, part_bytes=part)
        assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_common_line_in_many_contexts(spark):
    random.seed(9)
    line = "a very common line of some eighty bytes that stands in a third of all documents 12"
    rows = [(i, f"{random.random()} {random.random()} {line} {random.random()} {random.random()}" * 2) for i in range(300)]
    rows += [(i, f"{i % 7} {'same words around it ' * 3}{line}{' and behind it' * 4}") for i in range(300, 400)]
    found = suffixes.deduplicated(docs(spark, rows), keep=False, hot=20, part_bytes=20_000)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_kept_bytes_and_empty_table(spark):
    text = "é" * 20 + "".join(map(str, range(100)))
    (first, second) = suffixes.deduplicated(docs(spark, [(1, text), (2, "new " + text)])).orderBy("doc_id").collect()
    assert first.kept == text.encode() and second.kept == b"new " and second.n_spans == 1
    assert suffixes.report(docs(spark, [])).collect() == []
    assert [r.n_bytes for r in suffixes.report(docs(spark, [(1, None)])).collect()] == [0]


def test_a_round_sorts_little_beside_the_transform(monkeypatch):
    sorted_, real = [0], {n: getattr(np, n) for n in ("argsort", "sort", "lexsort", "union1d")}

    def counted(name):
        def run(*args, **options):
            sorted_[0] += sum(len(a) for a in args[: 2 if name == "union1d" else 1]) if name != "lexsort" else len(args[0][0])
            return real[name](*args, **options)

        return run

    for name in real:
        monkeypatch.setattr(np, name, counted(name))
    random.seed(4)
    m, size = 50, 120
    strings = ["".join(random.choices("abcd", k=size)).encode() for _ in range(m)]
    suffixes.sorted_suffixes(strings, suffixes.Columns(tempfile.mkdtemp(prefix="spark-")))
    transforms = sum(m * j for j in range(1, size + 2))
    assert sorted_[0] - transforms <= 3 * m * size


def test_a_round_does_not_sort_the_transform(monkeypatch):
    sorted_, real = [0], {n: getattr(np, n) for n in ("argsort", "sort", "lexsort")}

    def counted(name):
        def run(a, *args, **options):
            sorted_[0] += len(a[0] if name == "lexsort" else a)
            return real[name](a, *args, **options)

        return run

    for name in real:
        monkeypatch.setattr(np, name, counted(name))
    random.seed(4)
    m, size = 50, 120
    strings = ["".join(random.choices("abcd", k=size)).encode() for _ in range(m)]
    suffixes.sorted_suffixes(strings, suffixes.Columns(tempfile.mkdtemp(prefix="spark-")))
    assert sorted_[0] <= 4 * m * size


def test_strings_without_a_common_middle_are_not_sorted(monkeypatch):
    random.seed(6)
    letters = lambda k: "".join(random.choices("abcdefgh", k=k)).encode()
    anchor, behind, before = letters(40), letters(60), letters(60)
    strings = [letters(60) + anchor + letters(60) for _ in range(30)]
    strings += [letters(60) + anchor + behind for _ in range(3)] + [before + anchor + letters(60), before + anchor + letters(40)]
    seen, real = [], suffixes.sorted_suffixes
    monkeypatch.setattr(suffixes, "sorted_suffixes", lambda s, *args: seen.extend(s) or real(s, *args))
    n = len(strings)
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(n)), "place": [7] * n, "gram": [s.index(anchor) for s in strings], "key": [-1] * n, "string": strings},
        schema=pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("gram", pa.int32()), ("key", pa.int64()), ("string", pa.binary())]),
    )
    found = [r for b in suffixes._collection(tempfile.mkdtemp(prefix="spark-"))(iter([batch])) for r in b.to_pylist()]
    windows = {(r["doc_id"], r["place"] - 7 + k) for r in found for k in range(r["n"])}
    known, expected = set(), set()
    for i, s in enumerate(strings):
        for k in range(len(s) - 99):
            if s[k : k + 100] in known:
                expected.add((i, k))
            known.add(s[k : k + 100])
    assert windows == expected and len(expected) > 2
    assert len(seen) <= 6 and sum(map(len, seen)) < 6 * 130


def test_wide_rows(monkeypatch):
    random.seed(8)
    strings = ["".join(random.choices("abc", k=random.randrange(1, 90))).encode() for _ in range(40)]
    narrow = suffixes.sorted_suffixes(strings, suffixes.Columns(tempfile.mkdtemp(prefix="spark-")))
    monkeypatch.setattr(suffixes, "_NARROW_ROWS", 0)
    wide = suffixes.sorted_suffixes(strings, suffixes.Columns(tempfile.mkdtemp(prefix="spark-")))
    assert all((a == b).all() for a, b in zip(narrow, wide))
