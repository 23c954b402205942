"""The pipeline's stages against plain loops, and the registered queries against their SQL."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from foliary.llm import queries, tokens
from tests.compare import difference, oracle
from tests.llm import test_hosts, test_leaks, test_nearcopies

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name], entry.oracle_sql()[name], spark, oracle(SF), SF)[0] == ""


def test_stages_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    triples = [(r.doc_id, r.text, r.source) for r in rows.values()]
    bad = test_hosts.bad_hosts(triples)
    left = {d for d, t, s in triples if not test_hosts.failed(test_hosts.measures(t)) and (s or "") not in bad}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mix", "token_shards"]
    for name, expected in (
        ("quality_rules", lambda ids: ids),
        ("near_dedup", lambda ids: {d for d, (_, root) in test_nearcopies.brute([(d, rows[d].text) for d in ids]).items() if d == root}),
        ("decontamination", lambda ids: ids - {d for d, _ in test_leaks.brute([(d, rows[d].text) for d in ids], items)}),
    ):
        docs = stages[name](spark, docs, SF)
        left = expected(left)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert Counter(r.doc_id for r in docs.collect()) == Counter(left), name
    mixed = stages["source_mix"](spark, docs, SF)
    counts = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(counts) <= left and max(counts.values()) <= 2
    words = {d: len(rows[d].text.split()) for d in left}
    assert abs(sum(n * words[d] for d, n in counts.items()) - 1.5 * sum(words.values())) <= 0.005 * sum(words.values())

    whole, start, expected = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for d in sorted(counts.elements()):
        ids = [*whole.encode(rows[d].text, add_special_tokens=False).ids, 0]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, SF).collect()), key=lambda r: r[1]) == expected


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", None, 1), (1, text, "en", None, 1), (None, text, None, "", None), (2, None, "en", "a", 0), (3, "", None, None, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == bool(given)


def test_stages_hand_python_few_texts_at_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    for name in ("near_dedup", "decontamination", "token_shards"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000, name
