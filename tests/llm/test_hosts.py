"""Host rules: measures against plain loops, hosts against a fitted prior by hand."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foliary.llm import hosts

SCHEMA = "doc_id long, text string, source string, host string, n_words int"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def failed(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def bad_hosts(rows):
    rules = {
        "few": lambda m: m[0] < 50, "repeat": lambda m: 100 * m[4] > 50 * m[0], "symbols": lambda m: 10 * m[2] > m[1],
        "lines": lambda m: 5 * m[3] > m[0],
    }
    groups = defaultdict(list)
    for _, text, source in rows:
        groups[source or ""].append(measures(text))
    bad, total = set(), len(rows)
    for rule in rules.values():
        fails = {h: sum(map(rule, ms)) for h, ms in groups.items()}
        mean = sum(fails.values()) / total
        variance = sum(len(ms) * (fails[h] / len(ms) - mean) ** 2 for h, ms in groups.items()) / total
        between = variance - mean * (1 - mean) * len(groups) / total
        size = 1e6 if between <= 1e-6 * mean * (1 - mean) else min(1e6, max(1.0, (mean * (1 - mean) - between) / between))
        bad |= {h for h, ms in groups.items() if (fails[h] + mean * size) / (len(ms) + size) > hosts.HOST_LIMIT}
    return bad


def rows_of(seed):
    draw = random.Random(seed)
    rows = []
    for d in range(300):
        source = draw.choice(["good"] * 4 + ["bad"] * 9 + ["mixed", "", None, f"one{d}"])
        good = draw.random() < {"good": 0.97, "bad": 0.0}.get(source, 0.6)
        words = [f"w{draw.randrange(80)}" for _ in range(draw.randrange(50, 200) if good else draw.randrange(0, 35))]
        text = "".join(w + draw.choice([" ", "  ", "\t", "\n", "\x0b", "\n \n", " # "]) for w in words)
        rows.append((d, text + text if good and draw.random() < 0.1 else text, source))
    return rows + [(900, None, "good"), (901, "", None), (None, "w " * 60, "bad"), (902, "é" * 40 + "     z", "good"),
                   (3, rows[3][1], rows[3][2]), (903, "a b c d " * 20_000, "good"), (904, "a b c a b c", "one"), (905, "a a a a", "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_loops(spark, seed):
    rows = rows_of(seed)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    bad = bad_hosts(rows)
    assert "bad" in bad and "good" not in bad
    expected = sorted(((d, *measures(t), failed(measures(t)), not failed(measures(t)) and (s or "") not in bad) for d, t, s in rows), key=repr)
    assert sorted(map(tuple, hosts.judged(frame).collect()), key=repr) == expected
    left = hosts.kept_documents(frame)
    assert left.columns == frame.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in expected if r[-1])


def test_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hosts.judged(empty).collect() == [] and hosts.kept_documents(empty).collect() == []
    frame = spark.createDataFrame([("http://User@WWW.Ex.org:80/a?b",), ("src1",), ("",), (None,)], "source string")
    assert [r[0] for r in frame.select(hosts.host(frame["source"])).collect()] == ["www.ex.org", "src1", "", ""]
    plan = hosts.judged(spark.createDataFrame([(1, "a", "b", "c", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
