"""Block-bounded scoring against plain sums, the plan of a stored search, and what a search reads."""

import random
import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from foliary import Params
from foliary.operators import lexical as L, scoring
from foliary.sources import artifacts

POSTING = "document_id long, part_no int, source_path string, length int, term string, weight int, folder_id string, part_id string"


def plain_best(part, term, units, terms, keep):
    score = defaultdict(int)
    for p, t, u in zip(part, term, units):
        if t in terms:
            score[p] += u
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:keep]


def test_lists_against_sums():
    rng = np.random.default_rng(2)
    for parts, terms, keep in ((1, 1, 1), (30, 5, 4), (4_000, 12, 20), (4_000, 12, 200), (9_000, 30, 10)):
        share = np.linspace(0.002, 0.9, terms)
        pairs = [(p, t) for t in range(terms) for p in np.flatnonzero(rng.random(parts) < share[t])]
        part, term = np.array(pairs or [(0, 0)]).T
        units = (rng.integers(1, 6, len(part)) * (1_000_000 / (1 + 40 * share[term]))).astype(np.int64)
        lists = scoring.Lists(part, term, units, parts, terms)
        read = every = 0
        for _ in range(25):
            mine = rng.choice(terms, size=min(terms, int(rng.integers(1, 9))), replace=False)
            found, scores, looked = lists.best(mine, keep)
            assert list(zip(found, scores)) == plain_best(part, term, units, set(mine.tolist()), keep)
            read, every = read + looked, every + int(np.isin(term, mine).sum())
            assert not lists.score.any()
        if parts == 9_000:
            assert read < 0.9 * every


def postings(spark, rows):
    return spark.createDataFrame(rows, POSTING)


def made(seed=4, documents=300):
    random.seed(seed)
    rows = []
    for d in range(documents):
        for n in range(1, 3):
            words = {f"w{int(random.paretovariate(0.7)) % 90}" for _ in range(30)}
            rows += [(d, n, f"p{d % 17}", 20 + d % 9, w, random.choice([1, 6, 10]), None, None) for w in words]
            rows.append((d, n, f"p{d % 17}", 20 + d % 9, "", 0, f"folder-{d % 5}", f"part-{n:03d}"))
    return rows


def test_ranked_equals_full_scores(spark):
    frame = postings(spark, made())
    stats = L.corpus_term_stats(frame)
    terms = spark.createDataFrame([(f"q{q}", f"w{(7 * q + 3 * k) % 120}") for q in range(12) for k in range(6)] + [("none", "unknown")], "question_id string, term string")
    whole = L._ranked(L.bm25_score(terms, frame, stats), 20)
    expected = {(r.question_id, r.rank, r.document_id, r.part_no, r.units) for r in whole.collect()}
    for limit in (scoring.BLOCK_TERMS, 10):
        blocks = list(scoring.asked_blocks(terms, L._weighed(stats), limit))
        assert limit > 10 or len(blocks) > 3
        found = [scoring.best_rows(L._wanted(frame, b).select("document_id", "part_no", "source_path", "term", "weight", "length").repartition("document_id", "part_no"), b, "string", 20, ["document_id", "part_no", "source_path"], False) for b in blocks]
        rows = found[0]
        for f in found[1:]:
            rows = rows.unionByName(f)
        assert {(r.question_id, r.rank, r.document_id, r.part_no, r.units) for r in L._ranked(rows, 20).collect()} == expected
    cost = {r.question_id: (r.read, r.every) for r in L.search_cost(terms, frame, stats, 20).collect()}
    assert set(cost) == {f"q{q}" for q in range(12)} and all(read <= every for read, every in cost.values())


def test_empty_inputs(spark):
    frame, none = postings(spark, made(documents=3)), postings(spark, [])
    asked = spark.createDataFrame([(1, "w1 w2")], "question_id long, text string")
    assert L.search_index(asked, none, L.corpus_term_stats(none), Params()).collect() == []
    assert L.search_index(asked.limit(0), frame, L.corpus_term_stats(frame), Params()).collect() == []


def test_stored_search_reads_wanted_buckets_alone(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    artifacts.write_lexical_index(postings(spark, made()), folder)
    stored, stats, _ = artifacts.read_lexical_index(spark, folder)
    asked = spark.createDataFrame([(1, "w3 w5")], "question_id long, text string")
    terms = L.question_terms(asked)
    ranked = L.rank_candidates(terms, stored, stats)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in line or "PartitionFilters: [bucket" in line for line in scans), plan
    # The exchange of postings stands above the filter by terms.
    exchange, semi = plan.index("Exchange hashpartitioning(document_id"), plan.index("LeftSemi")
    assert exchange < semi
    files = {f.split("/bucket=")[1].split("/")[0] for f in L._wanted(stored, scoring.asked_of(pa.table({"question_id": [1, 1], "term": ["w3", "w5"], "idf": [1.0, 1.0]}), 1.0)).inputFiles()}
    assert 0 < len(files) <= 64
    expected = L.search_index(asked, postings(spark, made()), L.corpus_term_stats(postings(spark, made())), Params())
    assert sorted(map(tuple, L.search_index(asked, stored, stats, Params()).collect())) == sorted(map(tuple, expected.collect()))


def _found_parts(seed=3, parts=400, terms=25):
    rng = np.random.default_rng(seed)
    found = [np.flatnonzero(rng.random(terms) < 0.3).astype(np.int32) for _ in range(parts)]
    table = pa.table({
        "document_id": pa.array(np.arange(parts) // 3), "part_no": pa.array((np.arange(parts) % 3 + 1).astype(np.int32)), "source_path": [f"p{i % 7}" for i in range(parts)],
        "length": pa.array(rng.integers(5, 40, parts).astype(np.int32)), "found": pa.array(found, pa.list_(pa.int32())),
        "weights": pa.array([rng.integers(1, 9, len(f)).astype(np.int32) for f in found], pa.list_(pa.int32())),
    })
    pairs = sorted({(q, int(t)) for q in range(15) for t in rng.choice(terms, 4)} | {(t % 15, t) for t in range(terms)})
    asked = scoring.asked_of(pa.table({"question_id": [q for q, _ in pairs], "term": [f"t{t:02d}" for _, t in pairs], "idf": [1.0 + t / 7 for _, t in pairs]}), 17.0)
    return table, asked


def test_slices_give_the_same_scores(monkeypatch):
    """Many slices of a partition: every score as a plain sum, the best rows among those of the slices, and little held at once."""
    table, asked = _found_parts()
    names, plain = ["document_id", "part_no", "source_path"], {}
    for r in table.to_pylist():
        for q in range(len(asked.questions)):
            mine = set(asked.term[asked.first[q] : asked.first[q + 1]].tolist())
            hit = [(t, w) for t, w in zip(r["found"], r["weights"]) if t in mine]
            if hit:
                units = scoring.gains(np.array([asked.idf[t] for t, _ in hit]), np.array([w for _, w in hit]), np.array([r["length"]] * len(hit)), asked.mean)
                plain[(asked.questions[q].as_py(), r["document_id"], r["part_no"])] = int(units.sum())
    monkeypatch.setattr(scoring, "SLICE", 150)
    monkeypatch.setattr(scoring, "HITS", 90)
    assert max(int(pa.compute.sum(pa.compute.list_value_length(t["found"])).as_py()) for t in scoring._parts_slices(iter(table.to_batches(64)), 150)) <= 150
    batches = list(scoring._all_of_parts(asked, names)(iter(table.to_batches(max_chunksize=64))))
    rows = [r for b in batches for r in b.to_pylist()]
    assert {(r["question_id"], r["document_id"], r["part_no"]): r["units"] for r in rows} == plain and len(rows) == len(plain)
    number = [(i, t, w) for i, (f, ws) in enumerate(zip(table["found"].to_pylist(), table["weights"].to_pylist())) for t, w in zip(f, ws)]
    spread = table.select([*names, "length"]).take(pa.array([i for i, _, _ in number]))
    spread = spread.append_column("term", pa.array([asked.terms[t].as_py() for _, t, _ in number])).append_column("weight", pa.array([w for _, _, w in number], pa.int32()))
    sizes = [t.num_rows for t in scoring._postings_slices(iter(spread.to_batches(max_chunksize=64)), 150)]
    assert sum(sizes) == spread.num_rows and max(sizes) < 150 + 64 and len(sizes) > 5
    for run, given in ((scoring._from_parts, table), (scoring._from_postings, spread)):
        best = defaultdict(list)
        for b in run(asked, 5, names)(iter(given.to_batches(max_chunksize=64))):
            for r in b.to_pylist():
                best[r["question_id"]].append((-r["units"], r["source_path"], r["document_id"], r["part_no"]))
        path = {(r["document_id"], r["part_no"]): r["source_path"] for r in table.to_pylist()}
        for q in best:
            whole = sorted((-u, path[d, n], d, n) for (asker, d, n), u in plain.items() if asker == q)
            assert sorted(best[q])[:5] == whole[:5]


def test_part_scores_equal_the_joins(spark):
    """Scores beside the parts are those of the joined postings, and no hit is exchanged."""
    from foliary.plans import adapter as A

    sf = "/root/testdata/sf0.001"
    questions, records = A.questions(spark, sf), A.records(spark, sf)
    stored = L.part_postings(L.part_search(records))
    joined = L.bm25_score(L.question_terms(questions), stored, L.corpus_term_stats(stored))
    found = L.part_scores(questions, records)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    columns = ["question_id", "document_id", "part_no", "source_path", "units"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, joined.select(columns).collect()))


def test_postings_are_made_and_written_without_a_shuffle(spark, tmp_path):
    """Weights of a term are summed over the fields of its part; neither that nor the written index moves a posting."""
    fields = ("f", "7", "a", 1, "p/a.txt", "red fox", "txt", ["red"], ["fox"], "Part 1", "red", "fox red hen")
    bare = ("f", "8", "b", 1, "q.txt", "", "txt", [], [], "Part 1", "", "")
    names = "folder_id string, document_id string, part_id string, part_no int, source_path string, title string, document_type string, topics array<string>, entities array<string>, label string, summary string, body string"
    made_of = L.part_postings(L.part_search(spark.createDataFrame([fields, bare], names)))
    assert "Exchange" not in made_of._jdf.queryExecution().executedPlan().toString()
    found = {(r["document_id"], r["term"]): r for r in made_of.collect()}
    assert found[7, "red"]["weight"] == 10 + 8 + 6 + 1 and found[7, "fox"]["weight"] == 10 + 8 + 1 and found[7, "hen"]["weight"] == 1
    assert found[7, ""]["weight"] == 0 and (found[7, ""]["folder_id"], found[8, ""]["part_id"]) == ("f", "b") and found[7, "red"]["folder_id"] is None
    tracker = spark._jsc.sc().statusStore().executorSummary("driver")
    before = tracker.totalShuffleWrite()
    artifacts._write(made_of, f"{tmp_path}/postings")
    assert spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() == before
    assert spark.read.parquet(f"{tmp_path}/postings").count() == made_of.count()
