"""Files, artifacts, generations, whole pipelines and streams over the tables."""

from urllib.parse import urlparse

from pyspark.sql import functions as F

from catalog import inventory_queries, sql
from catalog.index_queries import ROOT
from catalog.index_queries import SQL as INDEX_SQL
from catalog.inventory_queries import CHANGES, LISTING, JOBS
from catalog.navigation_queries import INPUTS
from catalog.check_queries import SQL as CHECK_SQL
from foliary.functions import register
from foliary.operators import folds, hierarchy as H, inventory as I, lexical as L, prompts
from foliary.operators.sizing import new_folder
from foliary.params import Params
from foliary.plans import adapter as A, pipelines as PL
from foliary.sources import artifacts as AR, files as S
from foliary.streaming import jobs as ST
from foliary.streaming.state import read_version


def scratch(spark, name):
    """A new folder for the files of one run, below the session's shared folder."""
    return new_folder(spark, name)


def _files(spark, sf, text, suffix="x"):
    """Contents of the documents as files: document_id and text or bytes."""
    return A.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), text.alias("text"))


def read_text_documents(spark, sf):
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(
        F.col("doc_id") % 4 == 1, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    ).otherwise(F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    docs, rejects = S.read_text_documents(A.load(spark, sf, "documents").select("doc_id", body.alias("content")))
    blank = F.lit(None).cast("string")
    return docs.withColumn("error", blank).unionByName(rejects.withColumn("text", blank))


def read_delimited_tables(spark, sf):
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",b|c\n\nlast,row,'), F.col("lang"))
    rows, _ = S.read_delimited_tables(_files(spark, sf, quoted), ",")
    return rows.select("document_id", "row_no", F.array_join("cells", "~").alias("cells"))


def read_json_documents(spark, sf):
    props = A.load(spark, sf, "events").select(F.col("event_id").alias("document_id"), F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("x"))).otherwise(F.concat(F.lit('{"z": '), "props", F.lit(', "a": [1, 2]}'))).alias("text"))
    good, bad = S.read_json_documents(props)
    return good.select("document_id", "body", F.lit(None).cast("string").alias("error")).unionByName(bad.select("document_id", F.lit(None).cast("string").alias("body"), "error"))


def read_xml_documents(spark, sf):
    text = F.concat(F.lit(" <d n='1'>"), F.regexp_replace("text", "[<&>]", " "), F.when(F.col("doc_id") % 5 == 0, F.lit("</e>")).otherwise(F.lit("</d> ")))
    good, bad = S.read_xml_documents(_files(spark, sf, text))
    return good.select("document_id", "body", F.lit(None).cast("string").alias("error")).unionByName(bad.select("document_id", F.lit(None).cast("string").alias("body"), "error"))


def html_pages_to_parts(spark, sf):
    return S.html_pages_to_parts(A.load(spark, sf, "pages").select("page_id", "html"), 8000).select("page_id", "draft_no", "anchors.section", "body")


def scan_source_tree(spark, sf):
    """The documents written out as a tree of text files, then listed."""
    root = scratch(spark, "tree")
    docs = A.load(spark, sf, "documents")
    docs.select("source", "lang", F.col("text")).write.partitionBy("source", "lang").mode("overwrite").text(root)
    tree = S.scan_source_tree(spark, root)
    return tree.groupBy(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1).alias("directory"), "extension").agg(F.sum("size").alias("bytes"))


def _manifests(spark, sf):
    parts, files = A.parts(spark, sf), A.source_files(spark, sf)
    return AR.part_manifests(parts, files, A.CONVERTED_AT), parts, files


def write_part_manifest(spark, sf):
    manifests, parts, _ = _manifests(spark, sf)
    folder = scratch(spark, "parts")
    AR.write_part_manifest(manifests, parts, folder)
    stored = spark.read.parquet(f"{folder}/manifests")
    return stored.select("document_id", "source_path", "status", "converter_version", F.size("parts").alias("n_parts"), F.sha2(F.array_join(F.transform("parts", lambda p: F.concat(p["path"], p["sha256"])), ","), 256).alias("digest"))


def read_part_manifest(spark, sf):
    manifests, parts, files = _manifests(spark, sf)
    doc = F.col("document_id")
    manifests = manifests.withColumn("status", F.when(doc % 20 == 1, F.lit("STAGED")).otherwise(F.col("status")))
    parts = parts.withColumn("markdown", F.when((doc % 20 == 2) & (F.col("part_no") == 1), F.lit("edited")).otherwise(F.col("markdown"))).filter(
        ~((doc % 20 == 3) & (F.col("part_no") == 1))
    )
    good, errors = AR.read_part_manifest(manifests, parts, files)
    counts = good.groupBy("document_id").agg(F.count("*").alias("n_parts"))
    return counts.withColumn("error", F.lit(None).cast("string")).unionByName(errors.withColumn("n_parts", F.lit(None).cast("long")))


def _compact(spark, sf):
    compact = H.compact_card(A.cards(spark, sf))
    return compact, H.folder_summary(compact, 12)


def write_folder_index(spark, sf):
    compact, folders = _compact(spark, sf)
    folder = scratch(spark, "folders")
    AR.write_folder_index(folders, compact, folder)
    stored = spark.read.json(folder)
    value = F.from_json("json", "folder_id string, document_count long, documents array<struct<document_id string>>")
    return stored.select(value.alias("v")).select("v.folder_id", "v.document_count", F.array_join(F.transform("v.documents", lambda d: d["document_id"]), ",").alias("document_ids"))


def write_root_index(spark, sf):
    compact, _ = _compact(spark, sf)
    folder = scratch(spark, "root")
    AR.write_root_index(H.build_root(compact, Params()), folder)
    return spark.read.json(folder).select("folder_id", "source_directory", "document_count", "index_path")


def write_lexical_index(spark, sf):
    folder = scratch(spark, "index")
    AR.write_lexical_index(L.part_postings(L.part_search(A.records(spark, sf))), folder)
    postings, stats, metadata = AR.read_lexical_index(spark, folder)
    found = L.search_index(A.questions(spark, sf), postings, stats, A.FIXTURE)
    return found


def _built(spark, sf):
    """An index to be published: several frames are written from the same cards and parts, which are stored."""
    files = A.source_files(spark, sf)
    return files, PL.build_index(files, A.stored_parts(spark, sf), A.stored_cards(spark, sf), Params())


def build_index(spark, sf):
    index = PL.build_index(A.source_files(spark, sf), A.parts(spark, sf), A.cards(spark, sf), Params())
    return index.root.select("folder_id", "source_directory", "document_count", F.array_join("document_types", "|").alias("document_types"))


def publish_generation(spark, sf):
    files, index = _built(spark, sf)
    folder = scratch(spark, "generation")
    number = PL.publish(spark, index, I.eligible_documents(files), folder)
    return AR.read_current_generation(spark, folder)["root"].select(F.lit(number).alias("generation"), "folder_id", "document_count")


def read_current_generation(spark, sf):
    """Two generations, the second one rejected because it lost documents: the first stays current."""
    files, index = _built(spark, sf)
    folder = scratch(spark, "generation")
    eligible = I.eligible_documents(files)
    PL.publish(spark, index, eligible, folder)
    half = PL.build_index(files.filter("id % 2 = 0"), A.stored_parts(spark, sf), A.stored_cards(spark, sf), Params())
    PL.publish(spark, half, eligible, folder)
    stored = AR.read_current_generation(spark, folder)
    return stored["documents"].select("folder_id", "document_id", "title")


def _earlier(spark, sf):
    """Files, parts and cards of an earlier day: some documents were not there, some had other texts or titles,
    and some were there that are not any more."""
    there = F.when(F.col("id") % 17 == 1, F.lit("PRESENT")).otherwise(F.col("source_status"))
    ready = F.when(F.col("id") % 17 == 1, F.lit("READY")).otherwise(F.col("conversion_status"))
    files = A.source_files(spark, sf).filter("id % 10 <> 3").withColumns({"source_status": there, "conversion_status": ready})
    text = F.when(F.col("document_id") % 10 == 6, F.concat(F.lit("earlier "), "markdown")).otherwise(F.col("markdown"))
    parts = A.stored_parts(spark, sf).withColumn("markdown", text).withColumn("sha256", F.sha2("markdown", 256))
    title = F.when(F.col("document_id").cast("long") % 10 == 5, F.reverse("title")).otherwise(F.col("title"))
    return files, parts, A.stored_cards(spark, sf).withColumn("title", title)


def updated(spark, sf, folder):
    """A generation of the earlier day, and one of today made from it by an update."""
    files, parts, cards = _earlier(spark, sf)
    first = PL.publish(spark, PL.build_index(files, parts, cards, Params()), I.eligible_documents(files), folder)
    today = A.source_files(spark, sf)
    index = PL.update_index(spark, folder, today, A.stored_parts(spark, sf), A.stored_cards(spark, sf), Params())
    return first, index, PL.publish(spark, index, I.eligible_documents(today), folder)


def incremental_index(spark, sf):
    folder = scratch(spark, "generation")
    updated(spark, sf, folder)
    stored = AR.read_current_generation(spark, folder)
    return stored["documents"].select("folder_id", "document_id", "title", "summary")


def incremental_search(spark, sf):
    folder = scratch(spark, "generation")
    updated(spark, sf, folder)
    found = PL.search(spark, folder, A.questions(spark, sf), A.FIXTURE)
    return found.select("question_id", "document_id", "part_id", "rank")


def search(spark, sf):
    files, index = _built(spark, sf)
    folder = scratch(spark, "generation")
    PL.publish(spark, index, I.eligible_documents(files), folder)
    found = PL.search(spark, folder, A.questions(spark, sf), A.FIXTURE)
    return found.select("question_id", "document_id", "part_id", "rank")


def _ingested(spark, sf):
    docs = A.documents(spark, sf)
    contents = docs.select("relative_path", F.encode("text", "UTF-8").alias("content"))
    extra = contents.withColumn("relative_path", F.concat(F.lit("new/"), "relative_path"))
    return PL.ingest(A.source_files(spark, sf), A.listing(spark, sf), contents.unionByName(extra), A.CONVERTED_AT, A.FIXTURE)


def ingest(spark, sf):
    out = _ingested(spark, sf)
    named = out.parts.join(out.inventory.select(F.col("id").alias("document_id"), "relative_path"), "document_id")
    return named.select("relative_path", "part_id", "anchors.section", "body")


def ingest_inventory(spark, sf):
    """Every file after the ingest with its final statuses."""
    return _ingested(spark, sf).inventory.select("relative_path", "source_status", "conversion_status", "last_error")


def assemble_answers(spark, sf):
    evidence = A.cited_evidence(spark, sf)
    documents = A.folder_documents(spark, sf).join(evidence.select("question_id", "document_id").distinct(), "document_id")
    return PL.assemble_answers(evidence, A.answers(spark, sf), documents, A.source_files(spark, sf))["citations"]


def part_prompt_rows(spark, sf):
    parts = A.parts(spark, sf)
    out = prompts.part_prompt_rows(parts, folds.batch_index_parts(parts), A.source_files(spark, sf), "Summarise.")
    return out.select("document_id", "batch_no", "bytes", "tokens", F.sha2("request", 256).alias("digest"))


def routing_prompt_rows(spark, sf):
    """Document routing requests: the parts of each document as entries, packed to a budget."""
    entry = F.to_json(F.struct("part_id", F.length("markdown").alias("size")))
    items = A.parts(spark, sf).select("document_id", F.col("part_no").alias("pos"), entry.alias("entry_json"), F.octet_length(entry).alias("bytes"))
    packed = folds.pack_batches(items, ["document_id"], "pos", "bytes", 60, 100, 300)
    asked = packed.withColumn("question", F.concat(F.lit("Q"), F.col("document_id").cast("string")))
    out = prompts.routing_prompt_rows(asked, ["document_id"], "documents", "folder_index", "Choose.")
    return out.select("document_id", "batch_no", "request", "bytes")


def answer_prompt_rows(spark, sf):
    cited = A.cited_evidence(spark, sf)
    texts = A.parts(spark, sf).select(F.col("document_id").cast("string").alias("document_id"), "part_id", F.col("markdown").alias("content"))
    evidence = cited.join(texts, ["document_id", "part_id"]).select(
        "question_id", F.col("document_id").cast("long").alias("doc_order"), F.col("rank").alias("part_order"), "document_id", "part_id", "label", "content", "source_anchors"
    )
    names = A.folder_documents(spark, sf).select("document_id", "title", F.concat("document_id", F.lit(".txt")).alias("filename"))
    documents = evidence.select("question_id", "document_id", "doc_order").distinct().join(names, "document_id").withColumn("source_modified_at", F.lit(None).cast("string"))
    out = prompts.answer_prompt_rows(A.questions(spark, sf), evidence, documents)
    return out.select("question_id", "bytes", F.sha2("request", 256).alias("digest"))


def register_functions(spark, sf):
    register.register_functions(spark)
    A.load(spark, sf, "documents").createOrReplaceTempView("registered_documents")
    return spark.sql(
        """SELECT doc_id, estimate_tokens(text) AS tokens, evidence_tokens(text) AS json_tokens, folder_id_of(concat(source, '/', lang)) AS folder_id,
 canonical_document_id(CAST(doc_id AS STRING)) AS id, array_join(lexical_runs(lexical_normalize(text)), ' ') AS terms FROM registered_documents"""
    )


def stream_scan_diff(spark, sf):
    """A later listing as a stream of several files a batch, applied when its scan is complete."""
    folder = scratch(spark, "scan")
    files = A.source_files(spark, sf)
    later = A.listing(spark, sf)
    marker = later.agg(F.count("*").alias("scan_rows"))
    later = later.withColumn("scan_rows", F.lit(None).cast("long")).unionByName(marker, allowMissingColumns=True).withColumn("scan_id", F.lit(1).cast("long"))
    later.repartition(8).write.parquet(f"{folder}/in")
    listings = spark.readStream.schema(later.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    query = ST.stream_scan_diff(listings, files, f"{folder}/state", f"{folder}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return read_version(spark, f"{folder}/state").drop("id")


def stream_job_progress(spark, sf):
    folder = scratch(spark, "progress")
    items = A.job_items(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    items.repartition(4, "item_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = ST.stream_job_progress(stream, f"{folder}/state", f"{folder}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return ST.current_progress(spark, f"{folder}/state")


def stream_stale_leases(spark, sf):
    """Heartbeats in files of a tenth of the time each, up to five minutes out of order, one file a batch."""
    folder = scratch(spark, "leases")
    beats = A.load(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    low, high = beats.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    moved = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(300)) - low
    part = F.floor(moved * 10 / (high - low + 300))
    for k in range(10):
        beats.filter(part == k).drop("event_id").repartition(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with ST.keyed_state(spark):
        told = ST.stream_stale_leases(stream, 3600, "10 minutes").writeStream.outputMode("append")
        query = told.option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/out").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.schema("job_id long, last_heartbeat timestamp").parquet(f"{folder}/out").withColumn("last_heartbeat", F.col("last_heartbeat").cast("timestamp_ntz"))


QUERIES = {
    f.__name__: f
    for f in (
        read_text_documents, read_delimited_tables, read_json_documents, read_xml_documents, html_pages_to_parts, scan_source_tree,
        write_part_manifest, read_part_manifest, write_folder_index, write_root_index, write_lexical_index, build_index, publish_generation,
        read_current_generation, incremental_index, incremental_search, search, ingest, ingest_inventory, assemble_answers, part_prompt_rows, routing_prompt_rows, answer_prompt_rows, register_functions,
        stream_scan_diff, stream_job_progress, stream_stale_leases,
    )
}

_ELIGIBLE = "eligible AS MATERIALIZED (SELECT d.* FROM docs d JOIN files f ON f.id = d.document_id WHERE source_status = 'PRESENT' AND conversion_status = 'READY')"
_ONLY = sql.parts().replace("    FROM documents\n  )\n)", "    FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 7 >= 3\n  )\n)", 1)
_EVENT_JSON = "'{' || chr(10) || '  \"a\": [' || chr(10) || '    1,' || chr(10) || '    2' || chr(10) || '  ],' || chr(10) || '  \"z\": {' || chr(10) || '    \"k\": ' || regexp_extract(props, '[0-9]+') || chr(10) || '  }' || chr(10) || '}'"

SQL = {
    "read_text_documents": "SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN text END AS text, CASE WHEN doc_id % 4 = 1 THEN 'not UTF-8' END AS error FROM documents",
    "read_delimited_tables": """SELECT doc_id AS document_id, 1::BIGINT AS row_no, replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>') || '~b\\|c' AS cells FROM documents
UNION ALL SELECT doc_id, 2, '' FROM documents UNION ALL SELECT doc_id, 3, 'last~row~' || lang FROM documents""",
    "read_json_documents": f"""SELECT event_id AS document_id, CASE WHEN event_id % 5 <> 0 THEN '```json' || chr(10) || {_EVENT_JSON} || chr(10) || '```' END AS body,
 CASE WHEN event_id % 5 = 0 THEN 'not JSON' END AS error FROM events""",
    "read_xml_documents": """SELECT doc_id AS document_id, CASE WHEN doc_id % 5 <> 0 THEN '```xml' || chr(10) || '<d n=''1''>' || regexp_replace(text, '[<&>]', ' ', 'g') || '</d>' || chr(10) || '```' END AS body,
 CASE WHEN doc_id % 5 = 0 THEN 'not XML' END AS error FROM documents""",
    "scan_source_tree": "SELECT 'source=' || source || '/lang=' || lang AS directory, '.txt' AS extension, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL",
    "write_part_manifest": sql.with_(
        sql.parts(),
        select="""SELECT document_id, relative_path AS source_path, 'READY' AS status, 'document-conversion-v4' AS converter_version, n_parts::INTEGER AS n_parts, digest
FROM docs JOIN (SELECT document_id, count(*) AS n_parts, sha256(string_agg(part_id || '.md' || sha256, ',' ORDER BY part_no)) AS digest FROM parts GROUP BY document_id) USING (document_id)""",
    ),
    "read_part_manifest": sql.with_(
        sql.parts(),
        select="""SELECT document_id, CASE WHEN document_id % 20 NOT IN (1, 2, 3) THEN count(*) END AS n_parts,
 CASE document_id % 20 WHEN 1 THEN 'manifest does not match its source' WHEN 2 THEN 'part hash mismatch' WHEN 3 THEN 'part is missing' END AS error FROM parts GROUP BY document_id""",
    ),
    "write_folder_index": sql.with_(
        sql.parts(),
        select="SELECT folder_id, count(*) AS document_count, string_agg(document_id::VARCHAR, ',' ORDER BY relative_path) AS document_ids FROM docs GROUP BY folder_id",
    ),
    "write_root_index": sql.with_(
        sql.parts(), select="SELECT folder_id, source_directory, count(*) AS document_count, 'folders/' || folder_id || '.json' AS index_path FROM docs GROUP BY ALL"
    ),
    "write_lexical_index": sql.search("SELECT * FROM candidates"),
    "build_index": sql.with_(
        sql.FILES, sql.parts(), _ELIGIBLE, select="SELECT folder_id, source_directory, count(*) AS document_count, lang AS document_types FROM eligible GROUP BY ALL"
    ),
    "publish_generation": sql.with_(sql.FILES, sql.parts(), _ELIGIBLE, select="SELECT 1 AS generation, folder_id, count(*) AS document_count FROM eligible GROUP BY ALL"),
    "read_current_generation": sql.with_(sql.FILES, sql.parts(), _ELIGIBLE, select="SELECT folder_id, document_id::VARCHAR AS document_id, title FROM eligible"),
    "incremental_index": sql.with_(
        sql.FILES, sql.parts(), _ELIGIBLE, select="SELECT folder_id, document_id::VARCHAR AS document_id, title, substr(summary, 1, 600) AS summary FROM eligible"
    ),
    "incremental_search": sql.with_(_ONLY, sql.lexical(), sql.query_terms(), sql.ranked(), select="SELECT question_id, document_id, part_id, rank FROM candidates"),
    "search": sql.with_(_ONLY, sql.lexical(), sql.query_terms(), sql.ranked(), select="SELECT question_id, document_id, part_id, rank FROM candidates"),
    "ingest": sql.with_(
        sql.FILES, LISTING, CHANGES,
        f"todo AS MATERIALIZED (SELECT c.relative_path, trim(text, {sql.BLANK}) AS clean FROM changes c JOIN (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS p, text FROM documents) d ON d.p = regexp_replace(c.relative_path, '^new/', '') WHERE source_status = 'PRESENT' AND conversion_status IN ('NEW', 'CHANGED') AND change NOT IN ('removed', 'skipped'))",
        sql.cut("todo", "relative_path", "clean", 1000),
        select="SELECT relative_path, 'part-' || lpad(n::VARCHAR, 3, '0') AS part_id, 'section-' || n AS section, chunk AS body FROM cut",
    ),
    "ingest_inventory": sql.with_(
        sql.FILES, LISTING, CHANGES,
        select=f"""SELECT relative_path, source_status, CASE WHEN NOT due THEN conversion_status WHEN clean = '' THEN 'FAILED' ELSE 'READY' END AS conversion_status,
 CASE WHEN NOT due THEN last_error WHEN clean = '' THEN 'no text' END AS last_error
 FROM (SELECT c.*, trim(text, {sql.BLANK}) AS clean, c.source_status = 'PRESENT' AND c.conversion_status IN ('NEW', 'CHANGED') AS due
   FROM changes c LEFT JOIN (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS p, text FROM documents) d ON d.p = regexp_replace(c.relative_path, '^new/', '')
   WHERE change NOT IN ('removed', 'skipped'))""",
    ),
    "assemble_answers": CHECK_SQL["citation_source_join"],
    "part_prompt_rows": sql.with_(
        sql.parts(), "sized AS MATERIALIZED (SELECT document_id, part_no, length(markdown) AS size FROM parts)",
        inventory_queries._next_fit(30000, 24),
        select="""SELECT document_id, batch_no, strlen(request)::INTEGER AS bytes, ((strlen(request) + 2) // 3)::INTEGER AS tokens, sha256(request) AS digest FROM (
 SELECT document_id, batch_no, 'Summarise.' || chr(10) || chr(10) || 'source_path: "' || relative_path || '"' || chr(10) || 'source_extension: ".txt"' || chr(10) || chr(10)
 || string_agg('<markdown-part id="' || part_id || '">' || chr(10) || 'anchors: {"section": "' || section || '"}' || chr(10) || markdown || chr(10) || '</markdown-part>', chr(10) || chr(10) ORDER BY part_no) AS request
 FROM packed JOIN parts USING (document_id, part_no) JOIN docs USING (document_id) GROUP BY document_id, batch_no, relative_path)""",
    ),
    "routing_prompt_rows": sql.with_(
        sql.parts(),
        """entries AS MATERIALIZED (SELECT document_id, part_no, '{"part_id":"' || part_id || '","size":' || length(markdown) || '}' AS entry FROM parts),
sized AS MATERIALIZED (SELECT document_id, part_no, strlen(entry) + 1 AS size FROM entries)""",
        inventory_queries._next_fit(3 * (300 - 100 - 128) - 60 + 1, 1000000),
        select="""SELECT document_id, batch_no, request, strlen(request)::INTEGER AS bytes FROM (
 SELECT document_id, batch_no, 'Choose.' || chr(10) || chr(10) || 'user_question:' || chr(10) || 'Q' || document_id || chr(10) || chr(10) || 'folder_index:' || chr(10)
 || '{"documents":[' || string_agg(entry, ',' ORDER BY part_no) || ']}' AS request FROM packed JOIN entries USING (document_id, part_no) GROUP BY document_id, batch_no)""",
    ),
    "answer_prompt_rows": sql.search(
        """SELECT question_id, strlen(request)::INTEGER AS bytes, sha256(request) AS digest FROM (
 SELECT item_id AS question_id, '{"user_question":' || to_json(text)::VARCHAR || ',"selected_markdown_parts":[' || coalesce(markdown_parts, '') || '],"source_metadata":[' || coalesce(sources, '') || ']}' AS request
 FROM benchmark LEFT JOIN (SELECT question_id AS item_id, string_agg('{"document_id":"' || document_id || '","part_id":"' || part_id || '","markdown":' || to_json(markdown)::VARCHAR || '}', ',' ORDER BY document_id, rank) AS markdown_parts
   FROM evid GROUP BY question_id) USING (item_id)
 LEFT JOIN (SELECT question_id AS item_id, string_agg('{"document_id":"' || document_id || '","title":' || to_json(title)::VARCHAR || ',"filename":"' || document_id || '.txt","source_modified_at":null,"parts":[' || cited || ']}', ',' ORDER BY document_id) AS sources
   FROM (SELECT question_id, document_id, title, string_agg('{"part_id":"' || part_id || '","citation_label":"' || label || '","anchors":[' || to_json('{"section":"' || section || '"}')::VARCHAR || ']}', ',' ORDER BY rank) AS cited
         FROM evid JOIN docs USING (document_id) GROUP BY ALL) GROUP BY question_id) USING (item_id))""",
        INPUTS,
        """evid AS MATERIALIZED (SELECT c.question_id, c.rank, p.document_id, p.part_id, p.label, p.section, p.markdown
  FROM candidates c JOIN card_parts k USING (folder_id, document_id, part_id) JOIN parts p ON p.document_id = c.document_id::BIGINT AND p.part_id = c.part_id WHERE c.rank <= 6)""",
    ),
    "register_functions": f"""SELECT doc_id, ((strlen(text) + 2) // 3)::INTEGER AS tokens, ((strlen(to_json(text)::VARCHAR) + 2) // 3)::INTEGER AS json_tokens,
 'folder-' || sha256(source || '/' || lang)[1:16] AS folder_id, CASE WHEN doc_id > 0 THEN doc_id END AS id, array_to_string({sql.terms("text")}, ' ') AS terms FROM documents""",
    "stream_scan_diff": sql.with_(
        sql.FILES, LISTING, CHANGES, select="SELECT * EXCLUDE (id, change, unsafe_skipped) FROM changes WHERE change NOT IN ('removed', 'skipped')"
    ),
    "stream_stale_leases": """
WITH h AS (SELECT DISTINCT user_id AS job_id, ts FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS later FROM h),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT job_id, ts AS last_heartbeat FROM n, w
WHERE (later IS NULL OR later > ts + INTERVAL 1 HOUR) AND ts + INTERVAL 1 HOUR <= mark""",
    "stream_job_progress": sql.with_(JOBS, select="SELECT job_id, completed_items, failed_items FROM jobs"),
}
