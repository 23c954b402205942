"""Navigation over the candidates of all benchmark questions."""

from functools import lru_cache

from pyspark.sql import functions as F

from catalog import sql
from foliary.operators import folds, navigation as N
from foliary.params import Params
from foliary.plans import adapter as A
from foliary.plans import pipelines

PARAMS = Params()
BUDGET = 3000


def _inputs(spark, sf):
    return A.candidates(spark, sf), A.root_folders(spark, sf), A.card_parts(spark, sf)


@lru_cache(maxsize=4)
def _navigation_of(application, spark, sf):
    found, root, card_parts = _inputs(spark, sf)
    return pipelines.navigate(
        found, root, A.folder_documents(spark, sf), card_parts, A.folder_selection(spark, sf), A.document_selection(spark, sf), PARAMS
    )


def _nav(spark, sf):
    return _navigation_of(spark.sparkContext.applicationId, spark, sf)


def folder_whitelist(spark, sf):
    found, root, _ = _inputs(spark, sf)
    kept, foreign = N.folder_whitelist(found, root)
    counts = kept.groupBy("question_id").agg(F.count("*").alias("kept"))
    return counts.join(foreign, "question_id", "full").fillna(0)


def part_whitelist(spark, sf):
    found, _, card_parts = _inputs(spark, sf)
    kept, unknown = N.part_whitelist(found, card_parts)
    counts = kept.groupBy("question_id").agg(F.count("*").alias("kept"))
    return counts.join(unknown, "question_id", "full").fillna(0)


def best_rank_per_document(spark, sf):
    return N.best_rank_per_document(A.candidates(spark, sf))


def consensus_intent(spark, sf):
    return N.consensus_intent(A.folder_selection(spark, sf))


def select_folders(spark, sf):
    found, root, _ = _inputs(spark, sf)
    kept, _ = N.folder_whitelist(found, root)
    return N.select_folders(kept, A.folder_selection(spark, sf), root)[0].select("question_id", "folder_id", "folder_order", "display_reason", "source_directory")


def need_more_information(spark, sf):
    responses = A.folder_selection(spark, sf)
    chosen = _nav(spark, sf).folders.filter("question_id % 2 = 0")
    return N.need_more_information(responses, chosen)


def cap_folders(spark, sf):
    return N.cap_folders(_nav(spark, sf).folders, 3).select("question_id", "folder_id", "folder_order")


def document_card_join(spark, sf):
    return _nav(spark, sf).routing.select("question_id", "folder_id", "document_id", "best_rank", "title")


def order_folder_documents(spark, sf):
    return N.order_folder_documents(_nav(spark, sf).routing).select("question_id", "folder_id", "document_id", "best_rank")


def neighbour_context(spark, sf):
    found, _, card_parts = _inputs(spark, sf)
    return N.neighbour_context(card_parts, found).select("question_id", "document_id", "part_id", "part_no", "lexical_rank", "label")


def _whitelisted(spark, sf):
    _, _, card_parts = _inputs(spark, sf)
    return N.selection_whitelist(A.document_selection(spark, sf), _nav(spark, sf).routing, card_parts)


def selection_whitelist(spark, sf):
    documents, parts, _, _ = _whitelisted(spark, sf)
    return parts.select("question_id", "folder_id", "document_id", "response_no", "part_id")


def merge_selections(spark, sf):
    documents, parts, _, _ = _whitelisted(spark, sf)
    merged, rows = N.merge_selections(documents, parts)
    keys = ["question_id", "folder_id", "document_id"]
    return merged.drop("_at").join(rows, keys, "left").select(*keys, "display_reason", "part_id", "part_order")


def cap_documents(spark, sf):
    documents, parts, _, _ = _whitelisted(spark, sf)
    merged, _ = N.merge_selections(documents, parts)
    kept, reached = N.cap_documents(merged, N.cap_folders(_nav(spark, sf).folders, 12), 5)
    out = reached.join(kept.select("question_id", "folder_id", "document_id", "doc_order"), ["question_id", "folder_id"], "left")
    return out.select("question_id", "folder_id", "document_id", "doc_order", "reached", "limit_reached")


def min_confidence(spark, sf):
    return _nav(spark, sf).confidence


def cap_parts_round_robin(spark, sf):
    documents, parts, _, _ = _whitelisted(spark, sf)
    merged, rows = N.merge_selections(documents, parts)
    chosen, _ = N.cap_documents(merged, N.cap_folders(_nav(spark, sf).folders, 12), 12)
    kept, _ = N.cap_parts_round_robin(chosen, rows, 5)
    return kept.select("question_id", "document_id", "part_id", "part_order", "doc_order")


def lexical_fallback(spark, sf):
    return _nav(spark, sf).added


def selection_counters(spark, sf):
    return _nav(spark, sf).counters


def navigate(spark, sf):
    nav = _nav(spark, sf)
    return nav.parts.join(nav.confidence, "question_id").select("question_id", "folder_id", "document_id", "part_id", "part_order", "doc_order", "confidence")


def source_record_join(spark, sf):
    out = N.source_record_join(_nav(spark, sf).documents, A.source_files(spark, sf))
    return out.select("question_id", "document_id", "filename", "relative_path", "source_status", "source_modified_at")


def evidence_content_join(spark, sf):
    out = N.evidence_content_join(_nav(spark, sf).parts, A.parts(spark, sf))
    return out.select("question_id", "document_id", "part_id", F.sha2("content", 256).alias("content_hash"))


def _evidence(spark, sf):
    nav = _nav(spark, sf)
    budgets = nav.intents.select("question_id", F.lit(BUDGET).alias("evidence_budget"))
    return pipelines.evidence(nav, A.parts(spark, sf), budgets)


def eligible_evidence(spark, sf):
    out = folds.eligible_evidence(_evidence(spark, sf))
    return out.select("question_id", "document_id", "part_id", "estimated_tokens", F.sha2("content", 256).alias("content_hash"))


def split_routing_document(spark, sf):
    parts = A.card_parts(spark, sf).join(A.parts(spark, sf).select(F.col("document_id").cast("string").alias("document_id"), "part_id", F.octet_length("markdown").alias("bytes")), ["document_id", "part_id"])
    sized = parts.groupBy("folder_id", "document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part_id", "bytes"))), lambda p: F.struct(p["part_id"].alias("part_id"), p["bytes"].alias("bytes"), F.lit(60).alias("bare_bytes"))).alias("parts")
    ).withColumn("head_bytes", F.lit(900)).withColumn("bare_bytes", F.lit(200))
    routing = _nav(spark, sf).routing.select("question_id", "folder_id", "document_id").join(sized, ["folder_id", "document_id"])
    return N.split_routing_document(routing, 2200)


QUERIES = {
    f.__name__: f
    for f in (
        folder_whitelist, part_whitelist, best_rank_per_document, consensus_intent, select_folders, need_more_information, cap_folders,
        document_card_join, order_folder_documents, neighbour_context, selection_whitelist, merge_selections, cap_documents, min_confidence,
        cap_parts_round_robin, lexical_fallback, selection_counters, navigate, source_record_join, evidence_content_join, eligible_evidence,
        split_routing_document,
    )
}

INPUTS = """
root_folders AS MATERIALIZED (SELECT DISTINCT folder_id, source_directory FROM docs WHERE source_directory NOT LIKE 'src7/%'),
card_parts AS MATERIALIZED (SELECT folder_id, document_id::VARCHAR AS document_id, part_no, part_id, label FROM parts JOIN docs USING (document_id)
  WHERE NOT (document_id % 13 = 4 AND part_no = 1)),
picks AS (SELECT question_id, max(folder_id) FILTER (WHERE rank = 1) AS f1, max(folder_id) FILTER (WHERE rank = 2) AS f2,
  max(folder_id) FILTER (WHERE rank = 5) AS f5 FROM candidates GROUP BY question_id),
intents AS (SELECT question_id, CASE WHEN question_id % 9 = 0 THEN 'small_talk' ELSE 'answer' END AS intent FROM picks),
mentions AS (
  SELECT question_id, 0 AS response_no, 0 AS pos, f2 AS folder_id, 'router A' AS reason FROM picks WHERE f2 IS NOT NULL
  UNION ALL SELECT question_id, 0, 1, 'folder-x', 'router A' FROM picks
  UNION ALL SELECT question_id, 1, 0, f5, 'router B' FROM picks WHERE f5 IS NOT NULL
  UNION ALL SELECT question_id, 1, 1, f1, 'router B' FROM picks WHERE f1 IS NOT NULL AND f1 IS DISTINCT FROM f5
  UNION ALL SELECT question_id, 1, 2, c, 'router B' FROM picks, (SELECT 'folder-' || sha256('src3/es')[1:16] AS c)
    WHERE question_id % 3 = 0 AND c IS DISTINCT FROM f5 AND c IS DISTINCT FROM f1
),
kept AS MATERIALIZED (SELECT * FROM candidates WHERE folder_id IN (SELECT folder_id FROM root_folders)),
all_folders AS MATERIALIZED (
  SELECT question_id, folder_id, arg_min(reason, place) AS display_reason, row_number() OVER (PARTITION BY question_id ORDER BY min(place)) AS folder_order
  FROM (SELECT question_id, folder_id, 'Local lexical recall found matching indexed terms.' AS reason, [0, rank, 0] AS place FROM kept
        UNION ALL SELECT question_id, folder_id, reason, [1, response_no, pos] FROM mentions WHERE folder_id IN (SELECT folder_id FROM root_folders))
  GROUP BY question_id, folder_id
),
folders AS MATERIALIZED (SELECT * FROM all_folders WHERE question_id % 9 <> 0),
routed AS MATERIALIZED (SELECT * FROM folders WHERE folder_order <= 12),
ranks AS MATERIALIZED (SELECT question_id, folder_id, document_id, min(rank) AS best_rank FROM kept GROUP BY ALL),
routing AS MATERIALIZED (
  SELECT r.question_id, r.folder_id, k.document_id, k.best_rank FROM routed r JOIN ranks k USING (question_id, folder_id)
  UNION ALL
  SELECT r.question_id, r.folder_id, d.document_id::VARCHAR, NULL FROM routed r JOIN docs d USING (folder_id)
  WHERE NOT EXISTS (SELECT 1 FROM ranks k WHERE k.question_id = r.question_id AND k.folder_id = r.folder_id)
),
sel_docs AS MATERIALIZED (
  SELECT question_id, folder_id, document_id, row_number() OVER (PARTITION BY question_id, folder_id ORDER BY min(rank)) - 1 AS doc_pos
  FROM candidates WHERE rank <= 8 GROUP BY question_id, folder_id, document_id
),
sel_parts AS MATERIALIZED (
  SELECT question_id, folder_id, document_id, 0 AS response_no, doc_pos, row_number() OVER (PARTITION BY question_id, folder_id, document_id ORDER BY rank) AS part_pos, part_id
  FROM candidates JOIN sel_docs USING (question_id, folder_id, document_id) WHERE rank <= 8
),
choice_parts AS MATERIALIZED (
  SELECT c.*, p.part_id IS NOT NULL AS valid FROM (
    SELECT * FROM sel_parts
    UNION ALL SELECT question_id, folder_id, document_id, 1, 0, 0, 'part-999' FROM sel_docs WHERE doc_pos = 0
    UNION ALL SELECT question_id, folder_id, document_id, 1, 0, part_pos, part_id FROM sel_parts WHERE doc_pos = 0
    UNION ALL SELECT question_id, folder_id, document_id, 1, 0, 1000, 'part-001' FROM sel_docs d WHERE doc_pos = 0
      AND NOT EXISTS (SELECT 1 FROM sel_parts s WHERE s.question_id = d.question_id AND s.document_id = d.document_id AND s.part_id = 'part-001')
  ) c JOIN routing USING (question_id, folder_id, document_id)
  LEFT JOIN card_parts p ON p.folder_id = c.folder_id AND p.document_id = c.document_id AND p.part_id = c.part_id
),
merged AS MATERIALIZED (SELECT s.* FROM sel_docs s JOIN routing USING (question_id, folder_id, document_id)),
merged_parts AS MATERIALIZED (
  SELECT question_id, folder_id, document_id, part_id, row_number() OVER (PARTITION BY question_id, folder_id, document_id ORDER BY min([response_no, doc_pos, part_pos])) AS part_order
  FROM choice_parts WHERE valid GROUP BY question_id, folder_id, document_id, part_id
)"""


def _capped(limit: int, name: str = "") -> str:
    return f"""
reached{name} AS MATERIALIZED (
  SELECT question_id, folder_id, folder_order, ahead < {limit} AS reached,
         bool_or(ahead >= {limit}) OVER (PARTITION BY question_id) OR sum(n) OVER (PARTITION BY question_id) > {limit} AS limit_reached
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY question_id ORDER BY folder_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM (SELECT r.question_id, r.folder_id, r.folder_order, count(m.document_id) AS n FROM routed r LEFT JOIN merged m USING (question_id, folder_id) GROUP BY ALL))
),
chosen{name} AS MATERIALIZED (
  SELECT * FROM (SELECT question_id, folder_id, document_id, row_number() OVER (PARTITION BY question_id ORDER BY folder_order, doc_pos) AS doc_order
                 FROM merged JOIN routed USING (question_id, folder_id)) WHERE doc_order <= {limit}
)"""


AFTER = """
confidence AS MATERIALIZED (
  SELECT question_id, coalesce((SELECT CASE WHEN question_id % 4 = 0 THEN 0.2 ELSE 0.7 END FROM reached r
    WHERE reached AND r.question_id = i.question_id AND EXISTS (SELECT 1 FROM sel_docs s WHERE s.question_id = r.question_id AND s.folder_id = r.folder_id) LIMIT 1), 0)::DOUBLE AS confidence
  FROM intents i WHERE intent <> 'small_talk'
),
turns AS MATERIALIZED (
  SELECT m.*, doc_order, row_number() OVER (PARTITION BY question_id ORDER BY part_order, doc_order) AS turn FROM merged_parts m JOIN chosen USING (question_id, folder_id, document_id)
),
held AS MATERIALIZED (SELECT * FROM turns WHERE turn <= 16),
valid_candidates AS MATERIALIZED (SELECT k.* FROM kept k JOIN routed USING (question_id, folder_id) JOIN card_parts USING (folder_id, document_id, part_id)),
open_candidates AS (
  SELECT v.question_id, v.folder_id, v.document_id, v.part_id, v.rank, c.doc_order IS NULL AS new_document, least(greatest(0, 16 - n_parts), 8) AS part_slots, 12 - n_docs AS doc_slots
  FROM valid_candidates v
  JOIN (SELECT question_id, confidence, (SELECT count(*) FROM held h WHERE h.question_id = f.question_id) AS n_parts,
               (SELECT count(*) FROM chosen h WHERE h.question_id = f.question_id) AS n_docs FROM confidence f) u USING (question_id)
  LEFT JOIN chosen c USING (question_id, folder_id, document_id)
  WHERE (n_parts = 0 OR confidence < 0.45) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.question_id = v.question_id AND h.document_id = v.document_id AND h.part_id = v.part_id)
),
added AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS fallback_order FROM (
      SELECT *, dense_rank() OVER (PARTITION BY question_id, new_document ORDER BY first_rank) AS place FROM (
        SELECT *, min(rank) OVER (PARTITION BY question_id, document_id) AS first_rank FROM open_candidates))
    WHERE NOT new_document OR place <= doc_slots) WHERE fallback_order <= part_slots
),
final_docs AS MATERIALIZED (
  SELECT question_id, folder_id, document_id, doc_order FROM chosen
  UNION ALL
  SELECT question_id, folder_id, document_id, coalesce((SELECT max(doc_order) FROM chosen c WHERE c.question_id = a.question_id), 0)
         + row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) FROM added a WHERE new_document GROUP BY question_id, folder_id, document_id
),
final_parts AS MATERIALIZED (
  SELECT question_id, folder_id, document_id, part_id, part_order, doc_order FROM held
  UNION ALL
  SELECT a.question_id, a.folder_id, a.document_id, a.part_id,
         coalesce((SELECT max(part_order) FROM held h WHERE h.question_id = a.question_id AND h.document_id = a.document_id), 0)
         + row_number() OVER (PARTITION BY a.question_id, a.document_id ORDER BY a.rank), d.doc_order
  FROM added a JOIN final_docs d USING (question_id, folder_id, document_id)
)"""

EVIDENCE = """
lined AS MATERIALIZED (
  SELECT f.question_id, f.document_id, f.part_id, p.sha256, (strlen(to_json(markdown)::VARCHAR) + 2) // 3 AS tokens, row_number() OVER (PARTITION BY f.question_id ORDER BY doc_order, part_order) AS line
  FROM final_parts f JOIN parts p ON p.document_id = f.document_id::BIGINT AND p.part_id = f.part_id
),
taken(question_id, line, used, fits) AS (
  SELECT question_id, line, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END, tokens <= 3000 FROM lined WHERE line = 1
  UNION ALL
  SELECT l.question_id, l.line, t.used + CASE WHEN t.used + tokens <= 3000 THEN tokens ELSE 0 END, t.used + tokens <= 3000
  FROM taken t JOIN lined l ON l.question_id = t.question_id AND l.line = t.line + 1
)"""


def found(select: str, *more: str) -> str:
    return sql.search(select, INPUTS, *more)


def navigated(select: str, *more: str) -> str:
    return sql.search(select, INPUTS, _capped(12), AFTER, *more)


_SPLIT = """
card_sizes AS MATERIALIZED (SELECT c.document_id, c.folder_id, c.part_id, row_number() OVER (PARTITION BY c.document_id ORDER BY c.part_no) AS line, strlen(markdown) + 1 AS cost,
  sum(strlen(markdown) + 1) OVER (PARTITION BY c.document_id) AS total FROM card_parts c JOIN parts p ON p.document_id = c.document_id::BIGINT AND p.part_id = c.part_id),
spread(document_id, line, no, used, reduced) AS (
  SELECT document_id, line, 1, CASE WHEN cost > 2000 THEN 61 ELSE cost END, cost > 2000 FROM card_sizes WHERE line = 1 AND 900 + total > 2200
  UNION ALL
  SELECT c.document_id, c.line, CASE WHEN s.used + c.cost <= 2000 THEN s.no ELSE s.no + 1 END,
         CASE WHEN s.used + c.cost <= 2000 THEN s.used + c.cost WHEN c.cost > 2000 THEN 61 ELSE c.cost END, NOT s.used + c.cost <= 2000 AND c.cost > 2000
  FROM spread s JOIN card_sizes c ON c.document_id = s.document_id AND c.line = s.line + 1
)"""

SQL = {
    "folder_whitelist": found(
        """SELECT question_id, count(*) FILTER (WHERE r.folder_id IS NOT NULL) AS kept, count(*) FILTER (WHERE r.folder_id IS NULL) AS invalid_lexical
FROM candidates LEFT JOIN root_folders r USING (folder_id) GROUP BY question_id"""
    ),
    "part_whitelist": found(
        """SELECT question_id, count(p.part_no) AS kept, count(*) - count(p.part_no) AS invalid_lexical
FROM candidates LEFT JOIN card_parts p USING (folder_id, document_id, part_id) GROUP BY question_id"""
    ),
    "best_rank_per_document": found("SELECT question_id, folder_id, document_id, min(rank) AS best_rank FROM candidates GROUP BY ALL"),
    "consensus_intent": found("SELECT question_id, intent FROM intents"),
    "select_folders": found("SELECT question_id, folder_id, folder_order::INTEGER AS folder_order, display_reason, source_directory FROM all_folders JOIN root_folders USING (folder_id)"),
    "need_more_information": found(
        "SELECT question_id, NOT (question_id % 2 = 0 AND EXISTS (SELECT 1 FROM folders f WHERE f.question_id = i.question_id)) AS need_more_information FROM intents i"
    ),
    "cap_folders": found("SELECT question_id, folder_id, folder_order::INTEGER AS folder_order FROM folders WHERE folder_order <= 3"),
    "document_card_join": found("SELECT question_id, routing.folder_id, routing.document_id, best_rank, title FROM routing JOIN docs ON docs.document_id = routing.document_id::BIGINT"),
    "order_folder_documents": found("SELECT question_id, folder_id, document_id, best_rank FROM routing"),
    "neighbour_context": found(
        """SELECT n.question_id, p.document_id, p.part_id, p.part_no::INTEGER AS part_no, c.rank AS lexical_rank, p.label
FROM (SELECT DISTINCT question_id, folder_id, document_id, part_no + d AS part_no FROM candidates JOIN card_parts USING (folder_id, document_id, part_id), (VALUES (-1), (0), (1)) AS v(d)) n
JOIN card_parts p USING (folder_id, document_id, part_no) LEFT JOIN candidates c ON c.question_id = n.question_id AND c.document_id = p.document_id AND c.part_id = p.part_id"""
    ),
    "selection_whitelist": found("SELECT question_id, folder_id, document_id, response_no, part_id FROM choice_parts WHERE valid"),
    "merge_selections": found(
        """SELECT question_id, folder_id, document_id, 'doc ' || document_id AS display_reason, part_id, part_order::INTEGER AS part_order
FROM merged LEFT JOIN merged_parts USING (question_id, folder_id, document_id)"""
    ),
    "cap_documents": found(
        "SELECT question_id, folder_id, document_id, doc_order::INTEGER AS doc_order, reached, limit_reached FROM reached LEFT JOIN chosen USING (question_id, folder_id)", _capped(5)
    ),
    "min_confidence": navigated("SELECT question_id, confidence FROM confidence"),
    "cap_parts_round_robin": navigated("SELECT question_id, document_id, part_id, part_order::INTEGER AS part_order, doc_order::INTEGER AS doc_order FROM turns WHERE turn <= 5"),
    "lexical_fallback": navigated("SELECT question_id, folder_id, document_id, part_id, rank, fallback_order::INTEGER AS fallback_order, new_document FROM added"),
    "selection_counters": navigated(
        """SELECT question_id,
 (SELECT count(*) FROM reached r WHERE r.question_id = i.question_id AND reached AND EXISTS (SELECT 1 FROM sel_docs s WHERE s.question_id = r.question_id AND s.folder_id = r.folder_id)) AS invalid_documents,
 (SELECT count(*) FROM choice_parts c JOIN reached r USING (question_id, folder_id) WHERE c.question_id = i.question_id AND reached AND NOT valid) AS invalid_parts,
 (SELECT count(*) FROM mentions m LEFT JOIN root_folders f USING (folder_id) WHERE m.question_id = i.question_id AND f.folder_id IS NULL) AS invalid_folders,
 (SELECT count(*) FROM candidates c LEFT JOIN root_folders f USING (folder_id) WHERE c.question_id = i.question_id AND f.folder_id IS NULL)
 + (SELECT count(*) FROM kept k JOIN routed USING (question_id, folder_id) LEFT JOIN card_parts p USING (folder_id, document_id, part_id) WHERE k.question_id = i.question_id AND p.part_no IS NULL) AS invalid_lexical,
 (SELECT count(*) FROM turns t WHERE t.question_id = i.question_id AND turn > 16) AS omitted_parts,
 (SELECT count(*) FROM added a WHERE a.question_id = i.question_id) AS fallback_parts
FROM intents i WHERE intent <> 'small_talk'"""
    ),
    "navigate": navigated(
        "SELECT question_id, folder_id, document_id, part_id, part_order::INTEGER AS part_order, doc_order::INTEGER AS doc_order, confidence FROM final_parts JOIN confidence USING (question_id)"
    ),
    "source_record_join": navigated(
        """SELECT question_id, document_id, (id - 1) || '.txt' AS filename, relative_path, source_status, make_timestamp((1700000000000000000 + (id - 1) * 1000000000) // 1000) AS source_modified_at
FROM final_docs JOIN files ON files.id = final_docs.document_id::BIGINT""",
        sql.FILES,
    ),
    "evidence_content_join": navigated(
        "SELECT question_id, f.document_id, f.part_id, sha256 AS content_hash FROM final_parts f JOIN parts p ON p.document_id = f.document_id::BIGINT AND p.part_id = f.part_id"
    ),
    "eligible_evidence": navigated(
        "SELECT question_id, document_id, part_id, tokens::INTEGER AS estimated_tokens, sha256 AS content_hash FROM taken JOIN lined USING (question_id, line) WHERE fits", EVIDENCE
    ),
    "split_routing_document": found(
        """SELECT r.question_id, r.folder_id, r.document_id, 900 + total > 2200 AS compressed, coalesce(no, 1) AS record_no, part_id, coalesce(reduced, false) AS reduced, true AS fits
FROM routing r JOIN card_sizes c USING (folder_id, document_id) LEFT JOIN spread s ON s.document_id = c.document_id AND s.line = c.line""",
        _SPLIT,
    ),
}
