"""Updates of a stored index against full builds: what is tokenised, what is dead, and what a search finds."""

import tempfile

from pyspark.sql import functions as F

from catalog import source_queries as Q
from foliary import Params
from foliary.operators import inventory as I, lexical as L
from foliary.plans import adapter as A, pipelines as PL
from foliary.sources import artifacts as AR, segments

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def searched(spark, folder):
    return rows(PL.search(spark, folder, A.questions(spark, SF).limit(40), A.FIXTURE))


def test_update_equals_full_build(spark):
    folder, whole = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    first, index, second = Q.updated(spark, SF, folder)
    assert (first, second) == (1, 2)
    files = A.source_files(spark, SF)
    eligible = I.eligible_documents(files)
    PL.publish(spark, PL.build_index(files, A.parts(spark, SF), A.cards(spark, SF), Params()), eligible, whole)
    stored, full = PL.stored_index(spark, folder), PL.stored_index(spark, whole)
    assert len(stored.segments) == 2 and len(full.segments) == 1
    columns = ["document_id", "part_no", "source_path", "length", "term", "weight", "folder_id", "part_id"]
    assert rows(stored.postings().select(columns)) == rows(full.postings().select(columns))
    assert rows(segments.stats_of(stored.counts)) == rows(segments.stats_of(full.counts))
    for name in ("root", "documents", "card_parts", "metadata", "signatures"):
        one, other = (AR.read_current_generation(spark, f, (name,))[name] for f in (folder, whole))
        assert rows(one.select(sorted(one.columns))) == rows(other.select(sorted(other.columns))), name
    assert searched(spark, folder) == searched(spark, whole)

    # Documents whose title, text or presence differs, and no others, have postings in the second segment.
    ids = {r[0] for r in eligible.select("id").collect()}
    expected = {i for i in ids if i % 10 in (3, 5, 6)}
    delta = spark.read.parquet(f"{folder}/postings/{stored.segments[1]}")
    assert {r[0] for r in delta.select("document_id").distinct().collect()} == expected
    earlier = {r[0] for r in I.eligible_documents(Q._earlier(spark, SF)[0]).select("id").collect()}
    assert {r.document_id for r in stored.dead.collect()} == {i for i in earlier if i not in ids or i in expected}

    # Nothing changed: an update without postings.
    again = PL.update_index(spark, folder, files, A.parts(spark, SF), A.cards(spark, SF), Params())
    assert again.postings.isEmpty() and again.gone.isEmpty()


def test_compaction(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    Q.updated(spark, SF, folder)
    before = searched(spark, folder)
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    files = A.source_files(spark, SF)
    gone = files.withColumn("source_status", F.when(F.col("id") % 10 == 8, F.lit("MISSING")).otherwise(F.col("source_status")))
    for state in (gone, files):
        index = PL.update_index(spark, folder, state, A.parts(spark, SF), A.cards(spark, SF), Params())
        PL.publish(spark, index, I.eligible_documents(state), folder)
        stored = PL.stored_index(spark, folder)
        if state is gone:
            assert len(stored.segments) == 1 and stored.dead.isEmpty()
            assert stored.postings().filter("document_id % 10 = 8").isEmpty()
    assert len(stored.segments) == 2 and searched(spark, folder) == before


def test_pruning_reaches_every_segment(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    Q.updated(spark, SF, folder)
    wanted = PL.stored_index(spark, folder).postings().filter(F.col("bucket") == 3)
    scans = [x for x in wanted._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x and "term" in x]
    assert len(scans) == 2 and all("(bucket" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans)
    assert L.indexed_parts(PL.stored_index(spark, folder).postings()).count() > 0
