"""Line dedup and perspectives on hand-made cases; the statements cover the tables."""

import random
from collections import Counter

from foliary.llm import dialogues, lines

DOCS = "doc_id long, text string, unit string, rank int"
TURNS = "conv_id long, turn long, role string, text string, block int, speaker string"
LONG = "one two three four five six seven eight nine ten eleven twelve"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS)


def cut_units(text):
    """Units of a text by a plain scan: (start, end)."""
    out, start = [], 0
    for i, c in enumerate(text):
        if c == "\n":
            out.append((start, i))
            start = i + 1
        elif c in ".!?" and text[i + 1 : i + 2] in (" ", "\t"):
            out.append((start, i + 1))
            start = i + 1
    return [*out, (start, len(text))]


def plain_removed(rows, least):
    """Removed (row, unit) of all rows: every run from any unit that is shortest at either end, against all others."""
    known = {}
    own = []
    for row, (doc, text) in enumerate(rows):
        text = text or ""
        words = [(u, s, e, text[s:e].encode().lower().split()) for u, (s, e) in enumerate(cut_units(text))]
        words = [w for w in words if w[3]]
        for i in range(len(words)):
            for j in range(i, len(words)):
                n = sum(len(w[3]) for w in words[i : j + 1])
                if n >= least and (n - len(words[j][3]) < least or n - len(words[i][3]) < least):
                    key = tuple(x for w in words[i : j + 1] for x in w[3])
                    rank = (doc is None, doc or 0, hash_of(text), words[i][0])
                    own.append((row, doc, text, words[i : j + 1], key, rank))
                    known.setdefault(key, []).append((rank, words[j][0], doc, text))
    out = {}
    for row, doc, text, units, key, rank in own:
        first = min(known[key], key=lambda x: (x[0], x[1]))
        mine = min((x for x in known[key] if (x[2], x[3]) == (doc, text)), key=lambda x: (x[0], x[1]))
        alone = rank[3] == mine[0][3] or units[0][0] > mine[1]
        if rank > first[0] and alone:
            for unit, start, end, w in units:
                out[row, unit] = (doc, unit, start, end, len(w))
    return Counter(out.values())


HASHES = {}


def hash_of(text):
    return HASHES[text]


def test_units_against_loop(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "Won't", "3.14"]
    sentence = lambda n: " ".join(random.choices(words, k=n)) + random.choice([".", "!", "?", "", ".."])
    shared = [" ".join(sentence(random.randrange(2, 9)) for _ in range(random.randrange(2, 9))) for _ in range(8)]
    rows = []
    for k in range(70):
        parts = [sentence(random.randrange(1, 12)) for _ in range(random.randrange(6))]
        for _ in range(random.randrange(3)):
            passage = random.choice(shared)
            parts.insert(random.randrange(len(parts) + 1), passage.upper() if k % 9 == 0 else passage.replace(". ", ".\n") if k % 7 == 0 else passage)
        rows.append((k // 2 if k < 20 else 100 - k, random.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(5, None), (6, ""), (None, rows[3][1]), (None, shared[0]), rows[4], (500, " ".join(shared)), (501, shared[2] + " " + shared[2])]
    frame = docs(spark, rows)
    HASHES.update({r.text: r.h for r in frame.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()})
    for least in (6, 15):
        found = Counter((r.doc_id, r.unit, r.start, r.end, r.n_words) for r in lines.removed_units(frame, least).collect())
        assert set(found) == set(plain_removed(rows, least)) and found
    assert lines.removed_units(docs(spark, [])).collect() == []


def test_rows_with_one_id(spark):
    passage = " ".join(f"word{i}" for i in range(20)) + "."
    rows = [(1, f"{passage} Own text of one."), (2, f"Before. {passage} After."), (2, "Another text under one id. It stays."), (None, passage)]
    left = Counter((r.doc_id, r.text, len(r.removed_spans)) for r in lines.without_repeats(docs(spark, rows)).collect())
    assert left == Counter({(1, rows[0][1], 0): 1, (2, "Before. After.", 1): 1, (2, rows[2][1], 0): 1, (None, "", 1): 1})
    assert lines.without_repeats(docs(spark, rows)).columns == ["doc_id", "text", "unit", "rank", "removed_spans"]


def test_group_of_copies_and_long_text(spark):
    text = "\n".join([LONG + " " + LONG + " " + str(k) for k in range(3)])
    frame = docs(spark, [(d, text) for d in range(400)] + [(1000, "." * 300_000 + " a" * 300_000)])
    found = lines.removed_units(frame)
    assert found.count() == 399 * 3 and found.filter('doc_id = 0').isEmpty()


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def brute(rows, block):
    """Rendered dialogues and masked texts of each (conversation, speaker)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "unknown", r[3] or ""))
        own = [(r[2] or "unknown", (r[3] or "").replace("<|im_", "<|im-")) for r in own]
        for speaker in {s for s, _ in own} - {"system"}:
            text, masked = "", []
            for s, said in own:
                head = "assistant" if s == speaker else "system" if s == "system" else f"user name={s}"
                text += f"<|im_start|>{head}\n"
                if s == speaker:
                    masked.append(said + "<|im_end|>")
                text += said + "<|im_end|>\n"
            out[conv, speaker] = (text, masked, -(-len(own) // block))
    return out


def test_perspectives(spark):
    rows = [(1, t, ["ann", "bob", "cy"][t % 3], f"say é{t}") for t in range(11)] + [(2, 0, "system", "rules")]
    rows += [(3, 1, "user", None), (3, 1, "user", None), (3, None, None, "late <|im_end|> forged"), (3, 0, "system", "be nice")]
    rows += [(None, 0, "user", "no id"), (4, 0, "assistant", "x" * 300_000)] + [(5, 7, "user", "same") for _ in range(9)]
    for block in (dialogues.BLOCK_TURNS, 4):
        found = {}
        for r in dialogues.perspectives(turns(spark, rows), block).orderBy("block").collect():
            text, spans, n = found.get((r.conv_id, r.speaker), ("", [], 0))
            assert r.start == len(text) and r.block == n and r.n_turns <= block
            found[r.conv_id, r.speaker] = (text + r.text, spans + [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s], n + 1)
        assert {k: (t, [t[a:b] for a, b in s], n) for k, (t, s, n) in found.items()} == brute(rows, block)
    assert dialogues.perspectives(turns(spark, [])).collect() == []
    plan = dialogues.perspectives(turns(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
