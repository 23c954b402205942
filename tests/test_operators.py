"""Operators on small inputs with known results, and against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliary.functions.anchors import anchor
from foliary.operators import answers as W, chunking as C, folds, inventory as I, jobs as J, lexical as L, navigation as N, sizing, tables
from foliary.params import Params

RECORD = (
    "folder_id string, document_id string, part_id string, part_no int, source_path string, title string, document_type string, "
    "topics array<string>, entities array<string>, label string, summary string, body string"
)


def record(document, part, title, body):
    return (
        "depots", document, f"part-{part:03d}", part, f"仓储资料/{title}.md", title, "note", ["仓储"], ["北库", "南库"],
        "摘录", "只说大意。", body,
    )


def ask(spark, records, *questions, params=Params(lexical_candidate_parts=12)):
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id int, text string")
    found = L.top_candidates(asked, spark.createDataFrame(records, RECORD), params)
    return [[r for r in sorted(found.collect(), key=lambda r: r["rank"]) if r["question_id"] == i] for i in range(len(questions))]


def test_exact_facts_are_recalled(spark):
    records = [
        record("1", 1, "仓库钥匙", "红色仓库的编号为7731905524，管理员姓林。"),
        record("2", 3, "租船合约", "木船于2019年7月8日租出，押金在归还木船后退回。"),
    ]
    store, number, boat, nothing = ask(spark, records, "红色仓库编号？", "7731905524", "租船合约的押金几时退回？", "？")
    assert store[0]["document_id"] == "1" and number[0]["document_id"] == "1"
    assert (boat[0]["document_id"], boat[0]["part_id"]) == ("2", "part-003")
    assert nothing == []


def test_one_large_document_cannot_take_all_places(spark):
    records = [record("1", n, "盘点长表", f"货架清单，编到 {n} 号。") for n in range(1, 31)]
    records.append(record("2", 1, "另一份表", "货架清单，别处抄来。"))
    (found,) = ask(spark, records, "货架清单", params=Params(lexical_candidate_parts=5, lexical_max_parts_per_document=2))
    assert sum(r["document_id"] == "1" for r in found) == 2
    assert any(r["document_id"] == "2" for r in found)


def test_equal_scores_keep_path_order(spark):
    records = [record(str(d), 1, title, "alpha beta") for d, title in ((5, "b"), (3, "a"), (9, "c"))]
    (found,) = ask(spark, records, "alpha")
    assert [r["document_id"] for r in found] == ["3", "5", "9"]


def test_pieces_prefer_blank_lines_in_the_second_half():
    assert list(C.pieces_of("aaaa\n\nbb\ncccc", 8)) == ["aaaa", "bb\ncccc"]
    assert list(C.pieces_of("a\n\nbbbbb\nccccccc", 10)) == ["a\n\nbbbbb", "ccccccc"]
    assert list(C.pieces_of("x" * 25, 10)) == ["x" * 10, "x" * 10, "x" * 5]


def test_segments_and_fences(spark):
    draft = spark.createDataFrame([(1, 1, "这一段只为切分而写。\n\n" * 400)], "document_id long, draft_no int, body string")
    out = C.bound_drafts(draft.withColumn("anchors", anchor(page=F.lit(7))), 1000).collect()
    assert len(out) > 1 and all(len(r["body"]) <= 1000 and r["anchors"]["page"] == 7 for r in out)
    assert sorted(r["anchors"]["segment"] for r in out)[0] == f"1/{len(out)}"
    body = "```json\n{\n" + ",\n".join(f'"f{i}": "{"货架" * 50}"' for i in range(80)) + "\n}\n```"
    fenced = spark.createDataFrame([(1, body)], "document_id long, text string")
    chunks = [r["chunk"] for r in C.chunk_markdown(fenced, 1000).collect()]
    assert len(chunks) > 1 and all(c.count("```") == 2 and len(c) <= 1000 for c in chunks)


def test_slides(spark):
    deck = "lead <!-- Slide number: 2 -->\\nA\n<!--slide  number: 5-->B"
    out = C.split_marked_blocks(spark.createDataFrame([(1, deck), (2, "none")], "d long, text string")).orderBy("d", "draft_no").collect()
    assert [(r["d"], r["anchors"]["slide"]) for r in out] == [(1, 2), (1, 5), (2, 1)]
    assert out[0]["body"] == "<!-- Slide number: 2 -->\\nA" or out[0]["body"] == "<!-- Slide number: 2 -->\nA"
    assert out[2]["body"] == "none"


def test_tables(spark):
    rows = [(1, "Stock", 1, ["Shelf", "Boxes", "Share"])] + [
        (1, "Stock", n, [f"shelf {n - 1}", f"{(n - 1) * 30 + 0.5}", f"=B{n}/90"]) for n in range(2, 206)
    ]
    rows += [(2, "Empty", n, ["", None]) for n in range(1, 5)]
    frame = spark.createDataFrame(rows, "document_id long, sheet string, row_no long, cells array<string>")
    drafts = tables.table_rows_to_parts(frame, 200)
    out = drafts.orderBy("batch_no").collect()
    assert [r["anchors"]["rows"] for r in out] == ["1-200", "201-205"]
    assert "| 2 | shelf 1 | 30.5 | =B2/90 |" in out[0]["body"]
    marker = tables.empty_table_marker(drafts, frame.select("document_id", "sheet").distinct()).collect()
    assert [(r["sheet"], r["anchors"]["rows"]) for r in marker] == [("Empty", "empty")]


def first_fit_loop(sizes, limit, most):
    batch, used, held, out = 1, 0, 0, []
    for size in sizes:
        if held and (held >= most or used + size > limit):
            batch, used, held = batch + 1, 0, 0
        used, held = used + size, held + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [64, 4096])
def test_packing_equals_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    chance = random.Random(3)
    groups = {g: [chance.choice((1, 5, 30, 90, 400)) for _ in range(n)] for g, n in ((1, 1), (2, 64), (3, 65), (4, 700), (5, 24))}
    rows = [(g, i, s) for g, sizes in groups.items() for i, s in enumerate(sizes, 1)]
    frame = spark.createDataFrame(rows, "g int, pos long, size int")
    packed = folds.next_fit(frame, ["g"], "pos", "size", 100, 24).orderBy("g", "pos").collect()
    for g, sizes in groups.items():
        assert [r["batch_no"] for r in packed if r["g"] == g] == first_fit_loop(sizes, 100, 24)


def test_numbering_without_one_task_per_group(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("k"))
    out = sizing.number_rows(frame, ["g"], ["k"], F.floor(F.col("k") / 100)).collect()
    for g in range(3):
        ordered = sorted((r["k"], r["row_no"]) for r in out if r["g"] == g)
        assert [n for _, n in ordered] == list(range(1, len(ordered) + 1))
    ranged = sizing.number_sorted(frame.distinct(), ["k", "g"], "n").collect()
    assert [r["n"] for r in sorted(ranged, key=lambda r: (r["k"], r["g"]))] == list(range(1, len(ranged) + 1))


def test_evidence_budget_skips_and_goes_on(spark):
    texts = ["a" * 13, "b" * 25, "c" * 7, "d" * 4]  # 5, 9, 3 and 2 tokens once quoted
    rows = [(1, 1, i, "1", f"part-{i:03d}", t) for i, t in enumerate(texts, 1)]
    parts = spark.createDataFrame(rows, "question_id int, doc_order int, part_order int, document_id string, part_id string, content string")
    out = folds.evidence_budget(parts, spark.createDataFrame([(1, 10)], "question_id int, evidence_budget int")).orderBy("part_order").collect()
    assert [r["within_evidence_budget"] for r in out] == [True, False, True, True]
    assert out[1]["content"] is None


def test_history_limits(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", str(t % 10) * 11_999 + "xyz") for t in range(20)] + [(1, 20, "user", "  ")]
    out = folds.recent_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert [r["turn"] for r in out] == [16, 17, 18, 19] and {len(r["text"]) for r in out} == {12_000}


def test_elapsed(spark):
    start = datetime(2024, 1, 1)
    rows = [
        (1, start, None, "PAUSED", start + timedelta(seconds=30), 0.0),
        (2, start, None, "ACTIVE", None, 10.5),
        (3, None, None, "ACTIVE", None, 0.0),
        (4, start, start + timedelta(seconds=5), "ACTIVE", None, 2.5),
    ]
    jobs = spark.createDataFrame(rows, "job_id int, started_at timestamp, finished_at timestamp, control_state string, paused_at timestamp, paused_seconds double")
    out = jobs.select("job_id", J.elapsed_seconds(start + timedelta(seconds=100)).alias("s")).orderBy("job_id").collect()
    assert [r["s"] for r in out] == [30, 90, 0, 2]


FILES = "id long, relative_path string, filename string, extension string, size long, mtime_ns long, sha256 string, source_status string, conversion_status string, index_status string, last_error string"


def test_scan_transitions(spark):
    def row(i, path, status="PRESENT", index="INDEXED"):
        return (i, path, path, ".txt", 10, 100, "h", status, "READY", index, "old")

    previous = spark.createDataFrame(
        [row(1, "same.txt"), row(2, "bytes.txt"), row(3, "touched.txt"), row(4, "gone-new.txt", index="NOT_INDEXED"), row(5, "gone.txt"),
         row(6, "back.txt", status="MISSING", index="STALE"), row(7, "lost.txt", status="MISSING", index="STALE")], FILES)
    listing = spark.createDataFrame(
        [("same.txt", 10, 100, None), ("bytes.txt", 11, 200, "h2"), ("touched.txt", 10, 300, "h"), ("back.txt", 10, 100, "h"), ("new.txt", 1, 1, "n"), ("bad.txt", 1, 1, None)],
        "relative_path string, size long, mtime_ns long, sha256 string")
    changes = I.scan_diff(previous, listing)
    out = {r["relative_path"]: r for r in changes.collect()}
    assert {k: v["change"] for k, v in out.items()} == {
        "same.txt": "unchanged", "bytes.txt": "changed", "touched.txt": "unchanged", "gone-new.txt": "removed", "gone.txt": "missing",
        "back.txt": "unchanged", "lost.txt": "missing", "new.txt": "new", "bad.txt": "skipped",
    }
    assert (out["bytes.txt"]["conversion_status"], out["bytes.txt"]["index_status"], out["bytes.txt"]["last_error"]) == ("CHANGED", "STALE", None)
    assert (out["touched.txt"]["mtime_ns"], out["touched.txt"]["conversion_status"]) == (300, "READY")
    assert (out["gone.txt"]["source_status"], out["gone.txt"]["index_status"]) == ("MISSING", "STALE")
    assert out["back.txt"]["source_status"] == "PRESENT"
    assert tuple(I.scan_summary(changes).first()) == (5, 1, 1, 3, 1, 2, 1)


def test_fallback_selects_a_part_the_router_missed(spark):
    candidates = spark.createDataFrame([(1, "f", "1", "part-001", 1), (1, "f", "2", "part-001", 2), (1, "f", "1", "part-002", 3)], "question_id int, folder_id string, document_id string, part_id string, rank int")
    none_docs = spark.createDataFrame([], "question_id int, folder_id string, document_id string, display_reason string, doc_order int")
    none_parts = spark.createDataFrame([], "question_id int, folder_id string, document_id string, part_id string, part_order int, doc_order int")
    intents = spark.createDataFrame([(1, "answer")], "question_id int, intent string")
    confidence = spark.createDataFrame([(1, 0.2)], "question_id int, confidence double")
    params = Params(navigation_max_selected_documents=1, lexical_fallback_parts=3)
    added = N.lexical_fallback(none_docs, none_parts, candidates, intents, confidence, params)
    assert [(r["document_id"], r["part_id"]) for r in added.orderBy("fallback_order").collect()] == [("1", "part-001"), ("1", "part-002")]
    documents, parts = N.add_fallback(none_docs, none_parts, added)
    assert documents.count() == 1 and [r["part_order"] for r in parts.orderBy("part_order").collect()] == [1, 2]


def test_round_robin(spark):
    documents = spark.createDataFrame([(1, "f", "1", 1), (1, "f", "2", 2)], "question_id int, folder_id string, document_id string, doc_order int")
    rows = [(1, "f", d, f"part-{p:03d}", p) for d in ("1", "2") for p in range(1, 5)]
    parts = spark.createDataFrame(rows, "question_id int, folder_id string, document_id string, part_id string, part_order int")
    kept, omitted = N.cap_parts_round_robin(documents, parts, 4)
    assert sorted((r["document_id"], r["part_id"]) for r in kept.collect()) == [("1", "part-001"), ("1", "part-002"), ("2", "part-001"), ("2", "part-002")]
    assert omitted.first()["omitted_parts"] == 4


def test_answer_checks(spark):
    evidence = spark.createDataFrame([(1, "1", "part-001", "Evidence 1", 1), (1, "2", "part-001", "Evidence 2", 2)], "question_id int, document_id string, part_id string, label string, page int")
    allowed = W.evidence_anchors(evidence.withColumn("source_anchors", F.array(anchor(page=F.col("page")))))
    one, two = '{"page":1}', '{"page":2}'
    answer = spark.createDataFrame(
        [(1, [("1", "part-001", one, "Evidence 1"), ("1", "part-001", one, "other"), ("1", "part-001", two, "Evidence 1")],
          [("s", [("37", "1", one), ("52", "2", two), ("53", "2", two), ("8", "1", two)], "a"), ("t", [("1", "1", one), ("2", "1", two)], "a")],
          [("1",), ("999",), ("1",)])],
        "question_id int, citations array<struct<document_id: string, part_id: string, anchor: string, label: string>>, "
        "conflicts array<struct<subject: string, values: array<struct<value: string, document_id: string, anchor: string>>, analysis: string>>, "
        "downloads array<struct<document_id: string>>")
    assert W.validate_citations(answer, allowed).count() == 1
    assert [r["value"] for r in W.validate_conflicts(answer, allowed).orderBy("value_no").collect()] == ["37", "52", "53"]
    files = spark.createDataFrame([(1, "山川/游记.md", "游记.md", "PRESENT"), (2, "诗集.md", "诗集.md", "MISSING")], "id long, relative_path string, filename string, source_status string")
    documents = evidence.select("question_id", "document_id")
    assert [(r["filename"], r["relative_directory"]) for r in W.validate_downloads(answer, documents, files).collect()] == [("游记.md", "山川")]


def test_parameters_are_checked():
    for bad in ({"lexical_fallback_parts": 17}, {"lexical_max_parts_per_document": 81}, {"document_text_chars_per_part": 10}, {"answer_max_output_tokens": 128_000, "answer_context_tokens": 4_096}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_lost_heartbeats_stream(spark, tmp_path):
    from foliary.streaming.jobs import keyed_state, stream_stale_leases

    base = datetime(2024, 1, 1)
    beats = [(1, 0), (2, 0), (1, 100), (1, 50), (1, 150), (1, 150), (1, 400)]
    for n, (job, second) in enumerate(beats):
        spark.createDataFrame([(job, base + timedelta(seconds=second))], "job_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/b={n:02d}"))
    stream = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    with keyed_state(spark):
        query = stream_stale_leases(stream, 60, "60 seconds").writeStream.format("memory").queryName("lost").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    lost = {(r["job_id"], r["last_heartbeat"]) for r in spark.sql("SELECT * FROM lost").collect()}
    assert lost == {(2, base), (1, base + timedelta(seconds=150))}


def test_python_workers_get_few_texts_at_once(spark):
    """No batch of texts that a Python function gets is larger than TEXT_ROWS; a smaller setting of the session stays."""
    from pyspark.sql import types as T

    from foliary.operators.sizing import TEXT_ROWS
    from foliary.plans import adapter

    @F.pandas_udf(T.LongType())
    def rows_at_once(texts):
        return texts.map(lambda _: len(texts))

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = adapter.load(spark, "/root/testdata/sf0.01", "documents").unionByName(adapter.load(spark, "/root/testdata/sf0.01", "documents"))
        assert docs.coalesce(1).select(rows_at_once("text").alias("n")).agg(F.max("n")).first()[0] <= TEXT_ROWS
        spark.conf.set(name, "100")
        adapter.load(spark, "/root/testdata/sf0.01", "documents")
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
