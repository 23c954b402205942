"""Ingest over mixed files: every file ends READY, FAILED or UNSUPPORTED, in parts or rejects, once."""

from foliary.params import Params
from foliary.plans import pipelines
from foliary.sources import artifacts

FILES = {
    "a/good.txt": b"First words.\n\nSecond words.",
    "a/blank.txt": b"\n\t ",
    "a/bad.txt": b"\xff\xfe\x00",
    "b/page.html": b"<h1>Head</h1><p>Body</p>",
    "b/empty.html": b"<p></p>",
    "c/rows.csv": b"x,y\n1,2\n",
    "c/long.csv": b"x," + b"y" * 200_000 + b"\n",
    "c/broken.csv": b"x,y\n1,\"2\rz\n" + b"a\rb,c\n",
    "d/data.json": b'{"k": [1, 2]}',
    "d/data2.json": b'{"k": ',
    "e/photo.png": b"\x89PNG",
    "e/tool.exe": b"MZ",
}


def frames(spark):
    listing = spark.createDataFrame(
        [(p, len(c), 1, f"hash-{p}") for p, c in FILES.items()] + [("f/gone.txt", 3, 1, "hash-gone")],
        "relative_path string, size long, mtime_ns long, sha256 string",
    )
    contents = spark.createDataFrame([(p, bytearray(c)) for p, c in FILES.items()], "relative_path string, content binary")
    empty = spark.createDataFrame(
        [], "id long, relative_path string, filename string, extension string, size long, mtime_ns long, sha256 string,"
        " source_status string, conversion_status string, index_status string, last_error string"
    )
    return empty, listing, contents


def test_every_file_has_one_outcome(spark):
    previous, listing, contents = frames(spark)
    out = pipelines.ingest(previous, listing, contents, "2024-01-01T00:00:00+00:00", Params())
    rows = {r.relative_path: r for r in out.inventory.collect()}
    status = {p: r.conversion_status for p, r in rows.items()}
    ready = {"a/good.txt", "b/page.html", "c/rows.csv", "c/long.csv", "d/data.json"}
    assert {p for p, s in status.items() if s == "READY"} >= ready
    assert {p for p, s in status.items() if s == "UNSUPPORTED"} == {"e/photo.png", "e/tool.exe"}
    assert all(status[p] == "FAILED" for p in ("a/blank.txt", "a/bad.txt", "b/empty.html", "d/data2.json", "f/gone.txt"))
    assert rows["f/gone.txt"].last_error == "file cannot be read" and rows["a/blank.txt"].last_error == "no text"
    by_id = {r.id: p for p, r in rows.items()}
    with_parts = {by_id[r.document_id] for r in out.parts.select("document_id").distinct().collect()}
    rejected = [by_id[r.document_id] for r in out.rejects.collect()]
    assert len(rejected) == len(set(rejected)) and with_parts.isdisjoint(rejected)
    assert with_parts | set(rejected) == set(rows) and with_parts == {p for p, s in status.items() if s == "READY"}

    again = pipelines.ingest(out.inventory, listing, contents, "2024-01-02T00:00:00+00:00", Params())
    assert again.parts.count() == 0 and again.rejects.count() == 0
    assert {r.relative_path: r.conversion_status for r in again.inventory.collect()} == status


def test_generations_of_two_publishers(spark, tmp_path):
    frame = spark.range(3)
    path = str(tmp_path)
    assert artifacts.publish_generation(spark, {"root": frame}, path) == 1
    assert artifacts.publish_generation(spark, {"root": spark.range(5)}, path) == 2
    assert artifacts.read_current_generation(spark, path, ("root",))["root"].count() == 5
    assert artifacts.publish_generation(spark, {"root": frame}, path, validate=lambda w: w["root"]) is None
    assert artifacts.current_generation_number(spark, path) == 2
