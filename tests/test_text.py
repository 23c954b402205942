"""Text functions against values worked out by hand and against Python's own rules."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliary.functions import anchors as AN
from foliary.functions import bounded as B
from foliary.functions import cells, paths
from foliary.functions import text as X


def values(spark, rows, build, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.select("i", build(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


FOLDING = ["Straße ŒUVRE", "ＡＢＣ　１２", "ﬁne ½ Ⅳ", "ıİ", "ΣΊΣΥΦΟΣ ς", "e\u0301a", "付款，信息。", "K\u212a", "ｶﾞ", "", "plain", "Æther «x» 10 µm"]


def test_normalize_equals_python(spark):
    expected = [unicodedata.normalize("NFKC", t).casefold() for t in FOLDING]
    assert values(spark, FOLDING, X.lexical_normalize) == expected


def test_every_character_of_the_native_path_folds_like_python(spark):
    chars = [chr(c) for low, high in X._plain_fold_ranges() for c in range(low, high + 1)]
    texts = ["".join(chars[i : i + 500]) for i in range(0, len(chars), 500)]
    assert values(spark, texts, X._fold_native) == [unicodedata.normalize("NFKC", t).casefold() for t in texts]


def test_terms(spark):
    rows = ["白鹤飞翔", "中", "一二三四五六七八", "一二三四五六七八九", "a bb 7 c3 x", "z" * 250, "中文abc1", None]
    got = values(spark, rows, X.lexical_terms)
    assert got[0] == ["白鹤", "鹤飞", "飞翔", "白鹤飞", "鹤飞翔", "白鹤飞翔"]
    assert got[1] == ["中"]
    assert got[2][-1] == rows[2] and len(got[2]) == 7 + 6 + 1
    assert len(got[3]) == 8 + 7
    assert got[4] == ["bb", "7", "c3"]
    assert got[5] == ["z" * 200]
    assert got[6] == ["中文", "中文", "abc1"]
    assert got[7] is None


def test_query_terms_drop_stop_words_and_stop_at_48(spark):
    assert values(spark, ["请问 多少 alpha alpha"], X.query_terms) == [["alpha"]]
    assert len(values(spark, [" ".join(f"t{i}" for i in range(60))], X.query_terms)[0]) == 48


@pytest.mark.parametrize("text, kind", [
    ("你好", "greeting"), ("您好呀！", "greeting"), ("hello", "greeting"), ("谢谢你", "thanks"), ("再见", "farewell"),
    ("你是谁？", "capability"), ("  thank \n you ", "thanks"), ("你好，苹果在哪儿", None), ("", None),
])
def test_small_talk(spark, text, kind):
    assert values(spark, [text], X.small_talk_kind) == [kind]


def test_strip_takes_all_python_blanks(spark):
    rows = ["\x1c\u2003 a \u3000\x85", "\n\r\tb"]
    assert values(spark, rows, X.strip) == [r.strip() for r in rows]


def test_tokens(spark):
    rows = ["", "a", "abcd", "货架", 'say "x"\n']
    assert values(spark, rows, X.estimate_tokens) == [math.ceil(len(r.encode()) / 3) for r in rows]
    import json
    assert values(spark, rows, X.evidence_tokens) == [math.ceil(len(json.dumps(r, ensure_ascii=False).encode()) / 3) for r in rows]


def test_meaningful_text_ignores_page_headings(spark):
    body = "## Page 12\n" + "字" * 39
    assert values(spark, [body, body + "x", "## Page 1\n" * 20], X.has_meaningful_text) == [False, True, False]


def test_document_ids(spark):
    rows = ["1", "01", "0", "-1", "9223372036854775807", "9223372036854775808", "x", "１"]
    assert values(spark, rows, X.canonical_document_id) == [1, None, None, None, 9223372036854775807, None, None, None]


def test_ignored_paths(spark):
    rows = [
        "照片/.DS_Store", "._窗花.png", "x/y/Thumbs.db", "__MACOSX/k", "旧/.Spotlight-V100/i.db",
        "旧/~$草稿.docx", "旧/草稿.docx", "a/.~lock.b#", "thumbs.db/x.txt",
    ]
    assert values(spark, rows, paths.is_ignored_source_path) == [True] * 6 + [False, True, False]


def test_safe_paths(spark):
    rows = ["a/b.txt", "/a", "a/../b", "..\\b", "C:\\x", "C:/x", "C:..\\x", "", ".", "./", "a\x00b", "\\\\srv\\share\\x", "a..b/c"]
    assert values(spark, rows, paths.is_safe_relative_path) == [True] + [False] * 11 + [True]


def test_folder_membership_and_names(spark):
    pairs = spark.createDataFrame([("a/b/c", "a/b"), ("a/bc/d", "a/b"), ("a/b", "a/b"), ("x", "")], "p string, f string")
    assert [r[0] for r in pairs.select(paths.path_in_folder(F.col("p"), F.col("f"))).collect()] == [True, False, False, True]
    assert values(spark, ["a/b/c.x", "c.x"], paths.source_directory_of) == ["a/b", "."]
    names = ["a.TXT", ".bashrc", "x.", "a.tar.gz", "none"]
    assert values(spark, names, paths.extension_of) == [".txt", "", "", ".gz", ""]


def test_cells(spark):
    numbers = [1.0, 1e7, 1e16, 1.5e-5, 0.0001, 123456.789, 0.1, -2.5e20, 1e22, float("inf"), 2.5e-308, 0.00012345678901234567]
    got = values(spark, numbers, lambda c: cells.table_cell_render(c, __import__("pyspark.sql.types", fromlist=["x"]).DoubleType()), "double")
    assert got == [("Infinity" if math.isinf(n) else str(n)) for n in numbers]
    ids = [1, 26, 27, 52, 53, 702, 703, 18278]
    assert values(spark, ids, cells.spreadsheet_column_name, "int") == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]


def test_bounded_lists(spark):
    rows = [["a", " a ", "b"], ["a", "b", " "], [" ", "a"], [], None]
    got = values(spark, rows, lambda c: B.bounded_string_list(c, 2, 10), "array<string>")
    assert [(r["value"], r["error"]) for r in got] == [
        (["a", "b"], None), (["a", "b"], None), (None, "blank item"), ([], None), (None, "not a list"),
    ]


def test_json_objects_in_replies(spark):
    rows = ['```json\n{"ok": true}\n```', 'Sure: {"a": {"b": 1}} done', '{"ok": tru', "[1, 2]", "no", '```\n[1]\n```']
    assert values(spark, rows, B.extract_json_object) == ['{"ok": true}', '{"a": {"b": 1}}', None, None, None, None]


def test_places(spark):
    rows = ['{"page":3}', '{"rows":"empty","sheet":" S "}', '{"section":"Section-4","segment":"1/2"}', '{"page":"3"}', "[]", "x", None, '{"page":true,"slide":2}']
    assert values(spark, rows, AN.human_source_location) == [
        "第 3 页", "工作表“S”", "第 4 部分·片段 1/2", AN.UNKNOWN_PLACE, AN.UNKNOWN_PLACE, AN.UNKNOWN_PLACE, AN.UNKNOWN_PLACE, "第 2 张幻灯片",
    ]


def test_first_terms_of_a_card_are_those_of_the_whole_text(spark):
    from foliary.functions.text import index_terms
    from foliary.plans import adapter as A

    lead = "ab " * 650
    texts = [
        "", " ", None, "alphabet " * 400, "one two alphabetical", lead + "straightforward nevertheless " * 30 + "alphabetical everything somewhere",
        lead + "exceptional" * 40 + " alphabetical everything somewhere completely", "x" * 2_500 + " alphabetical everything somewhere completely whatsoever",
        "everything somewhere completely whatsoever alphabetical " * 60, "漢字" * 1_200 + " ﬁnancially Straße everything somewhere completely whatsoever", lead + "caf" + "e\u0301" * 60 + " everything",
    ]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    terms = docs.withColumn("all", index_terms(F.col("text"))).select(
        "doc_id", F.slice(F.filter("all", lambda t: F.length(t) >= 5), 1, 5).alias("topics"), F.slice(F.filter("all", lambda t: F.length(t) >= 8), 1, 3).alias("entities")
    )
    found = A._card_scalars(docs).select("doc_id", "topics", "entities")
    assert sorted(found.collect()) == sorted(terms.collect())
