"""Inventory, jobs, conversations and packing over the tables."""

from datetime import datetime

from pyspark.sql import functions as F

from catalog import sql
from foliary.operators import folds, inventory as I, jobs as J
from foliary.params import PRESENT
from foliary.plans import adapter as A


def _changes(spark, sf):
    return I.scan_diff(A.source_files(spark, sf), A.listing(spark, sf))


def scan_diff(spark, sf):
    return _changes(spark, sf)


def scan_summary(spark, sf):
    return I.scan_summary(_changes(spark, sf))


def scan_candidates(spark, sf):
    return I.scan_candidates(A.source_files(spark, sf), A.listing(spark, sf))


def dispatch_by_extension(spark, sf):
    extension = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".csv", ".html", ".exe", ".pdf", "")]), (F.col("id") % 6 + 1).cast("int"))
    files = A.source_files(spark, sf).withColumn("extension", extension)
    return I.dispatch_by_extension(files).select("id", "extension", "extractor", "conversion_status")


def eligible_documents(spark, sf):
    return I.eligible_documents(A.source_files(spark, sf)).select("id", "relative_path")


def needs_conversion(spark, sf):
    return I.needs_conversion(A.source_files(spark, sf), retry_failed=True).select("id", "conversion_status")


def needs_reconversion(spark, sf):
    return I.needs_reconversion(A.source_files(spark, sf)).select("id")


def folder_conversion_set(spark, sf):
    return I.folder_conversion_set(A.source_files(spark, sf), "src1/en").select("id", "relative_path")


def _requested(spark, sf):
    return A.load(spark, sf, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), (F.col("event_id") * 3 % 1500 + 1).alias("id")
    )


def selected_files_check(spark, sf):
    return I.selected_files_check(_requested(spark, sf), A.source_files(spark, sf))


def source_references(spark, sf):
    return I.source_references(_requested(spark, sf), A.source_files(spark, sf))


def inventory_order(spark, sf):
    return I.inventory_order(A.source_files(spark, sf)).select("relative_path", "id")


def library_view(spark, sf):
    return I.library_view(A.source_files(spark, sf))


def library_search(spark, sf):
    return I.library_search(A.source_files(spark, sf), " SRC3/E ").select("id", "relative_path")


def folder_tree_rollup(spark, sf):
    return I.folder_tree_rollup(A.source_files(spark, sf))


def folder_listing(spark, sf):
    return I.folder_listing(A.source_files(spark, sf), "src3")


def snapshot_guard(spark, sf):
    snapshot = I.eligible_documents(A.source_files(spark, sf)).select("id", "relative_path", "sha256")
    return I.snapshot_guard(snapshot, I.inventory_after(_changes(spark, sf)))


def content_changed_guard(spark, sf):
    return I.content_changed_guard(A.source_files(spark, sf), A.listing(spark, sf))


def job_progress(spark, sf):
    return J.job_progress(A.job_items(spark, sf))


def job_outcome(spark, sf):
    return J.job_outcome(J.job_progress(A.job_items(spark, sf)))


def job_progress_ratio(spark, sf):
    return J.job_progress_ratio(A.jobs(spark, sf))


_NOW = datetime(2024, 3, 1)


def elapsed_seconds(spark, sf):
    return A.jobs(spark, sf).select("job_id", J.elapsed_seconds(_NOW).alias("elapsed"))


def job_list(spark, sf):
    return J.job_list(A.jobs(spark, sf)).select("job_id", "created_at", "status")


def current_job(spark, sf):
    return J.current_job(A.jobs(spark, sf)).select("job_id", "created_at", "status")


def stale_leases(spark, sf):
    jobs = A.jobs(spark, sf)
    now = jobs.agg(F.max("heartbeat_at")).scalar()
    return J.stale_leases(jobs, now, 3600).select("job_id", "heartbeat_at")


def load_conversation_log(spark, sf):
    return A.messages(spark, sf)


def recent_history(spark, sf):
    return folds.recent_history(A.messages(spark, sf))


def lexical_query_text(spark, sf):
    history, questions = A.conversation_questions(spark, sf)
    return folds.lexical_query_text(folds.recent_history(history), questions)


def part_char_totals(spark, sf):
    return folds.part_char_totals(A.parts(spark, sf))


def batch_index_parts(spark, sf):
    return folds.batch_index_parts(A.parts(spark, sf))


def document_plan(spark, sf):
    return folds.document_plan(A.parts(spark, sf))


def pack_batches(spark, sf):
    items = A.parts(spark, sf).select("document_id", "part_no", F.octet_length("markdown").alias("bytes"))
    return folds.pack_batches(items, ["document_id"], "part_no", "bytes", 300, 200, 1400)


def evidence_budget(spark, sf):
    parts = A.parts(spark, sf)
    selected = parts.select(
        F.col("document_id").alias("question_id"), F.lit(1).alias("doc_order"), F.col("part_no").alias("part_order"),
        F.col("document_id").cast("string").alias("document_id"), "part_id", F.substring("markdown", F.lit(1), (F.col("part_no") * 37 % 5 + 1) * 200).alias("content"),
    )
    budgets = parts.select(F.col("document_id").alias("question_id")).distinct().withColumn("evidence_budget", F.lit(500))
    out = folds.evidence_budget(selected, budgets)
    return out.select("question_id", "part_id", "estimated_tokens", "within_evidence_budget")


QUERIES = {
    f.__name__: f
    for f in (
        scan_diff, scan_summary, scan_candidates, dispatch_by_extension, eligible_documents, needs_conversion, needs_reconversion,
        folder_conversion_set, selected_files_check, source_references, inventory_order, library_view, library_search,
        folder_tree_rollup, folder_listing, snapshot_guard, content_changed_guard, job_progress, job_outcome, job_progress_ratio,
        elapsed_seconds, job_list, current_job, stale_leases, load_conversation_log, recent_history, lexical_query_text,
        part_char_totals, batch_index_parts, document_plan, pack_batches, evidence_budget,
    )
}

LISTING = """
listing AS MATERIALIZED (
  SELECT relative_path, size + CASE WHEN d % 13 = 0 THEN 1 ELSE 0 END AS size,
         mtime_ns + CASE WHEN d % 13 = 0 OR d % 19 = 0 THEN 5000000000 ELSE 0 END AS mtime_ns,
         CASE WHEN d % 29 = 0 THEN NULL WHEN d % 13 = 0 THEN sha256(sha256 || '!') ELSE sha256 END AS sha256
  FROM (SELECT *, id - 1 AS d FROM files) WHERE d % 11 <> 0
  UNION ALL
  SELECT 'new/' || relative_path, size, mtime_ns, CASE WHEN (id - 1) % 29 = 0 THEN NULL ELSE sha256 END FROM files WHERE (id - 1) % 23 = 0
)"""
CHANGES = """
joined AS (
  SELECT f.*, n.relative_path AS n_path, n.size AS n_size, n.mtime_ns AS n_mtime, n.sha256 AS n_sha,
         n.relative_path IS NOT NULL AND (f.id IS NULL OR f.source_status <> 'PRESENT' OR f.size <> n.size OR f.mtime_ns <> n.mtime_ns) AS asked
  FROM files f FULL JOIN listing n ON f.relative_path = n.relative_path
),
tagged AS (
  SELECT *, CASE WHEN id IS NULL AND n_sha IS NULL THEN 'skipped' WHEN id IS NULL THEN 'new'
                 WHEN n_path IS NOT NULL AND NOT asked THEN 'unchanged'
                 WHEN asked AND n_sha <> sha256 THEN 'changed' WHEN asked AND n_sha IS NOT NULL THEN 'unchanged'
                 WHEN index_status = 'NOT_INDEXED' THEN 'removed' ELSE 'missing' END AS change,
         asked AND n_sha IS NOT NULL AS fresh
  FROM joined
),
changes AS MATERIALIZED (
  SELECT id, coalesce(relative_path, n_path) AS relative_path,
         CASE WHEN fresh THEN regexp_extract(coalesce(relative_path, n_path), '[^/]*$') ELSE filename END AS filename,
         CASE WHEN fresh THEN '.txt' ELSE extension END AS extension,
         CASE WHEN fresh THEN n_size ELSE size END AS size, CASE WHEN fresh THEN n_mtime ELSE mtime_ns END AS mtime_ns,
         CASE WHEN change IN ('new', 'changed') THEN n_sha ELSE sha256 END AS sha256,
         CASE WHEN fresh THEN 'PRESENT' WHEN change = 'missing' THEN 'MISSING' ELSE source_status END AS source_status,
         CASE change WHEN 'new' THEN 'NEW' WHEN 'changed' THEN 'CHANGED' ELSE conversion_status END AS conversion_status,
         CASE WHEN change = 'new' THEN 'NOT_INDEXED'
              WHEN (change = 'changed' OR (change = 'missing' AND source_status <> 'MISSING')) AND index_status = 'INDEXED' THEN 'STALE'
              ELSE index_status END AS index_status,
         CASE WHEN change NOT IN ('new', 'changed') THEN last_error END AS last_error,
         change, CASE WHEN asked AND n_sha IS NULL THEN 1 ELSE 0 END AS unsafe_skipped
  FROM tagged
)"""
JOBS = """
items AS (
  SELECT user_id AS job_id, event_id AS item_id, ts,
         CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status
  FROM events
),
jobs AS (
  SELECT job_id, min(ts) AS created_at, CASE WHEN job_id % 6 <> 0 THEN min(ts) END AS started_at,
         CASE WHEN job_id % 4 = 0 THEN max(ts) END AS finished_at,
         CASE WHEN job_id % 4 = 1 THEN max(ts) - INTERVAL 1 HOUR END AS paused_at, (job_id % 7) * 1.5::DOUBLE AS paused_seconds,
         CASE WHEN job_id % 9 <> 0 THEN max(ts) END AS heartbeat_at, count(*) AS total_items,
         count(*) FILTER (WHERE status = 'COMPLETED') AS completed_items, count(*) FILTER (WHERE status = 'FAILED') AS failed_items,
         CASE job_id % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'RUNNING' ELSE 'QUEUED' END AS status,
         CASE WHEN job_id % 4 = 1 THEN 'PAUSED' WHEN job_id % 10 = 3 THEN 'STOPPED' ELSE 'ACTIVE' END AS control_state
  FROM items GROUP BY job_id
)"""
_REQUESTED = "requested AS (SELECT user_id AS request_id, event_id AS pos, event_id * 3 % 1500 + 1 AS id FROM events)"
_MESSAGES = "messages AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_HISTORY = f"""
recent AS (
  SELECT conv_id, turn, role, substr(trim(text, {sql.BLANK}), 1, 12000) AS text, age FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM history) WHERE age <= 12
),
folded(conv_id, age, turn, role, kept, left_over) AS (
  SELECT conv_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 48000::BIGINT FROM (SELECT DISTINCT conv_id FROM recent)
  UNION ALL
  SELECT r.conv_id, r.age, r.turn, r.role, substr(r.text, 1, f.left_over), f.left_over - length(substr(r.text, 1, f.left_over))
  FROM folded f JOIN recent r ON r.conv_id = f.conv_id AND r.age = f.age + 1
)"""


def _next_fit(limit: int, most: int) -> str:
    return f"""
packed(document_id, part_no, batch_no, used, held) AS (
  SELECT document_id, part_no, 1, size, 1 FROM sized WHERE part_no = 1
  UNION ALL
  SELECT s.document_id, s.part_no,
         CASE WHEN p.held >= {most} OR p.used + s.size > {limit} THEN p.batch_no + 1 ELSE p.batch_no END,
         CASE WHEN p.held >= {most} OR p.used + s.size > {limit} THEN s.size ELSE p.used + s.size END,
         CASE WHEN p.held >= {most} OR p.used + s.size > {limit} THEN 1 ELSE p.held + 1 END
  FROM packed p JOIN sized s ON s.document_id = p.document_id AND s.part_no = p.part_no + 1
)"""


_SIZED = "sized AS MATERIALIZED (SELECT document_id, part_no, length(markdown) AS size FROM parts)"
_ROOM = 3 * (1400 - 200 - 128) - 300 + 1

SQL = {
    "scan_diff": sql.with_(sql.FILES, LISTING, CHANGES, select="SELECT * FROM changes"),
    "scan_summary": sql.with_(
        sql.FILES, LISTING, CHANGES,
        select="""SELECT count(*) FILTER (WHERE change IN ('new', 'changed', 'unchanged')) AS scanned, count(*) FILTER (WHERE change = 'new') AS new,
 count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged,
 count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'missing') AS missing,
 sum(unsafe_skipped)::BIGINT AS unsafe_skipped FROM changes""",
    ),
    "scan_candidates": sql.with_(sql.FILES, LISTING, CHANGES, select="SELECT n_path AS relative_path FROM joined WHERE asked"),
    "dispatch_by_extension": sql.with_(
        sql.FILES,
        select="""SELECT id, CASE id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.html' WHEN 3 THEN '.exe' WHEN 4 THEN '.pdf' ELSE '' END AS extension,
 CASE id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'delimited' WHEN 2 THEN 'html' WHEN 4 THEN 'pdf' END AS extractor,
 CASE WHEN id % 6 IN (3, 5) THEN 'UNSUPPORTED' ELSE conversion_status END AS conversion_status FROM files""",
    ),
    "eligible_documents": sql.with_(sql.FILES, select="SELECT id, relative_path FROM files WHERE source_status = 'PRESENT' AND conversion_status = 'READY'"),
    "needs_conversion": sql.with_(sql.FILES, select="SELECT id, conversion_status FROM files WHERE source_status = 'PRESENT' AND conversion_status IN ('NEW', 'CHANGED', 'FAILED')"),
    "needs_reconversion": sql.with_(sql.FILES, select="SELECT id FROM files WHERE source_status = 'PRESENT' AND conversion_status NOT IN ('QUEUED', 'CONVERTING')"),
    "folder_conversion_set": sql.with_(
        sql.FILES,
        select="SELECT id, relative_path FROM files WHERE relative_path LIKE 'src1/en/%' AND source_status = 'PRESENT' AND conversion_status IN ('NEW', 'CHANGED', 'FAILED', 'UNSUPPORTED')",
    ),
    "selected_files_check": sql.with_(
        sql.FILES, _REQUESTED,
        select="""SELECT r.id, pos, CASE WHEN source_status IS NULL THEN 'missing' WHEN source_status <> 'PRESENT' THEN 'not_present'
 WHEN conversion_status = 'READY' THEN 'ineligible' ELSE 'ok' END AS verdict
FROM (SELECT id, min(pos) AS pos FROM requested GROUP BY id) r LEFT JOIN files f USING (id)""",
    ),
    "source_references": sql.with_(
        sql.FILES, _REQUESTED,
        select="""SELECT request_id, pos, id::VARCHAR AS document_id, filename, relative_path, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS relative_directory,
 CASE WHEN source_status = 'PRESENT' THEN '/api/files/' || id || '/download' END AS download_url, source_status = 'PRESENT' AS available
FROM requested JOIN files USING (id)""",
    ),
    "inventory_order": sql.with_(sql.FILES, select="SELECT relative_path, id FROM files ORDER BY 1, 2"),
    "library_view": sql.with_(
        sql.FILES,
        select="""SELECT id, relative_path, filename, extension, size, index_status, source_status = 'PRESENT' AS available,
 CASE WHEN source_status = 'PRESENT' THEN '/api/files/' || id || '/view' END AS view_url,
 CASE WHEN source_status = 'PRESENT' THEN '/api/files/' || id || '/download' END AS download_url FROM files""",
    ),
    "library_search": sql.with_(sql.FILES, select="SELECT id, relative_path FROM files WHERE index_status = 'INDEXED' AND contains(lower(relative_path), 'src3/e')"),
    "folder_tree_rollup": """SELECT folder_path, count(*) AS n_files FROM (
 SELECT '' AS folder_path FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT source || '/' || lang FROM documents) GROUP BY folder_path""",
    "folder_listing": """SELECT 'folder' AS kind, lang AS name, count(*) AS file_count, 0::BIGINT AS subfolder_count
FROM documents WHERE source = 'src3' AND doc_id % 5 >= 2 GROUP BY lang""",
    "snapshot_guard": sql.with_(
        sql.FILES, LISTING, CHANGES,
        select="""SELECT * FROM (SELECT f.id, CASE WHEN c.id IS NULL THEN 'not eligible' WHEN c.sha256 <> f.sha256 THEN 'content changed' END AS reason
FROM files f LEFT JOIN (SELECT * FROM changes WHERE change NOT IN ('removed', 'skipped') AND source_status = 'PRESENT' AND conversion_status = 'READY') c ON c.id = f.id
WHERE f.source_status = 'PRESENT' AND f.conversion_status = 'READY') WHERE reason IS NOT NULL""",
    ),
    "content_changed_guard": sql.with_(
        sql.FILES, LISTING,
        select="""SELECT id, relative_path, f.sha256 AS expected, l.sha256 AS actual FROM files f LEFT JOIN listing l USING (relative_path)
WHERE l.sha256 IS NULL OR l.sha256 <> f.sha256""",
    ),
    "job_progress": sql.with_(JOBS, select="SELECT job_id, completed_items, failed_items FROM jobs"),
    "job_outcome": sql.with_(
        JOBS,
        select="""SELECT job_id, CASE WHEN failed_items > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
 CASE WHEN failed_items > 0 THEN failed_items || ' background item(s) failed' END AS error FROM jobs""",
    ),
    "job_progress_ratio": sql.with_(JOBS, select="SELECT job_id, least(100.0::DOUBLE, (completed_items + failed_items)::DOUBLE / total_items * 100) AS percent FROM jobs"),
    "elapsed_seconds": sql.with_(
        JOBS,
        select="""SELECT job_id, CASE WHEN started_at IS NULL THEN 0 ELSE greatest(0, round_even(
 (epoch_us(coalesce(finished_at, CASE WHEN control_state = 'PAUSED' THEN paused_at END, TIMESTAMP '2024-03-01')) - epoch_us(started_at)) / 1e6 - paused_seconds, 0)) END::BIGINT AS elapsed FROM jobs""",
    ),
    "job_list": sql.with_(JOBS, select="SELECT job_id, created_at, status FROM jobs ORDER BY created_at DESC, job_id DESC"),
    "current_job": sql.with_(
        JOBS,
        select="SELECT job_id, created_at, status FROM jobs WHERE status IN ('PENDING', 'QUEUED', 'RUNNING') AND control_state <> 'STOPPED' ORDER BY created_at DESC, job_id DESC LIMIT 1",
    ),
    "stale_leases": sql.with_(
        JOBS,
        select="""SELECT job_id, heartbeat_at FROM jobs WHERE status = 'RUNNING' AND control_state = 'ACTIVE'
 AND (heartbeat_at IS NULL OR heartbeat_at < (SELECT max(heartbeat_at) FROM jobs) - INTERVAL 1 HOUR)""",
    ),
    "load_conversation_log": "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')",
    "recent_history": sql.with_(
        _MESSAGES.replace("messages", "history", 1), _HISTORY,
        select="SELECT conv_id, turn, role, kept AS text FROM folded WHERE age > 0 AND length(kept) > 0",
    ),
    "lexical_query_text": sql.with_(
        _MESSAGES,
        "asked AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM messages WHERE role = 'user') WHERE k = 1)",
        "history AS (SELECT m.* FROM messages m JOIN asked a ON a.conv_id = m.conv_id AND m.turn < a.turn)",
        _HISTORY,
        select="""SELECT a.conv_id, CASE WHEN said IS NULL THEN a.text ELSE said || chr(10) || a.text END AS text
FROM asked a LEFT JOIN (SELECT conv_id, string_agg(kept, chr(10) ORDER BY turn) AS said FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM folded WHERE role = 'user' AND length(kept) > 0) WHERE k <= 3 GROUP BY conv_id) s USING (conv_id)""",
    ),
    "part_char_totals": sql.with_(sql.parts(), select="SELECT document_id, sum(length(markdown))::BIGINT AS chars, count(*) AS part_count FROM parts GROUP BY document_id"),
    "batch_index_parts": sql.with_(
        sql.parts(), _SIZED, _next_fit(30000, 24),
        select="SELECT document_id, part_no::INTEGER AS part_no, s.size::INTEGER AS chars, batch_no FROM packed JOIN sized s USING (document_id, part_no)",
    ),
    "document_plan": sql.with_(
        sql.parts(), _SIZED, _next_fit(30000, 24),
        select="""SELECT document_id, sum(size)::BIGINT AS chars, count(*) AS part_count, sum(size) > 60000 OR count(*) > 24 AS hierarchical,
 CASE WHEN sum(size) > 60000 OR count(*) > 24 THEN max(batch_no) ELSE 1 END::INTEGER AS batches FROM packed JOIN sized USING (document_id, part_no) GROUP BY document_id""",
    ),
    "pack_batches": sql.with_(
        sql.parts(), "sized AS MATERIALIZED (SELECT document_id, part_no, strlen(markdown) + 1 AS size FROM parts)", _next_fit(_ROOM, 1000000),
        select=f"SELECT document_id, part_no::INTEGER AS part_no, (size - 1)::INTEGER AS bytes, batch_no, size <= {_ROOM} AS fits FROM packed JOIN sized USING (document_id, part_no)",
    ),
    "evidence_budget": sql.with_(
        sql.parts(),
        """sized AS MATERIALIZED (SELECT document_id, part_no, part_id, (strlen(to_json(substr(markdown, 1, (part_no * 37 % 5 + 1) * 200))::VARCHAR) + 2) // 3 AS size FROM parts),
taken(document_id, part_no, used, fits) AS (
  SELECT document_id, part_no, CASE WHEN size <= 500 THEN size ELSE 0 END, size <= 500 FROM sized WHERE part_no = 1
  UNION ALL
  SELECT s.document_id, s.part_no, t.used + CASE WHEN t.used + s.size <= 500 THEN s.size ELSE 0 END, t.used + s.size <= 500
  FROM taken t JOIN sized s ON s.document_id = t.document_id AND s.part_no = t.part_no + 1
)""",
        select="SELECT document_id AS question_id, part_id, size::INTEGER AS estimated_tokens, fits AS within_evidence_budget FROM taken JOIN sized USING (document_id, part_no)",
    ),
}
