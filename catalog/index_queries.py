"""Cards, folders, root and generations over the tables."""

from pyspark.sql import functions as F

from catalog import sql
from foliary.operators import folds, hierarchy as H, inventory as I
from foliary.params import Params
from foliary.plans import adapter as A


def _compact(spark, sf):
    return H.compact_card(A.cards(spark, sf))


def compact_card(spark, sf):
    out = _compact(spark, sf)
    return out.select("folder_id", "document_id", "title", "summary", F.array_join("topics", ",").alias("topics"), F.array_join("entities", ",").alias("entities"), "card_path")


def group_cards_by_folder(spark, sf):
    files = I.eligible_documents(A.source_files(spark, sf))
    return H.group_cards_by_folder(files, A.cards(spark, sf)).select("folder_id", "source_directory", "document_id", "source_path")


def folder_summary(spark, sf):
    return H.folder_summary(_compact(spark, sf), 12)


def term_folder_counts(spark, sf):
    return H.term_folder_counts(_compact(spark, sf), "topics")


def rank_root_terms(spark, sf):
    out = H.rank_root_terms(_compact(spark, sf), "topics", 20)
    return out.select("folder_id", F.array_join("topics", ",").alias("topics"))


def unique_document_values(spark, sf):
    out = H.unique_document_values(_compact(spark, sf), "title", 8, "titles")
    return out.select("folder_id", F.array_join("titles", "|").alias("titles"))


def build_root(spark, sf):
    out = H.build_root(_compact(spark, sf), Params())
    lists = ("document_types", "topics", "entities", "representative_titles")
    return out.select("folder_id", "source_directory", "summary", "document_count", *[F.array_join(c, "|").alias(c) for c in lists], "index_path")


def _generations(spark, sf):
    status = F.when(F.col("event_type") == "signup", F.lit("BUILDING")).when(F.col("event_type") == "view", F.lit("VALIDATED")).when(F.col("event_type") == "click", F.lit("ACTIVE")).when(F.col("event_type") == "purchase", F.lit("SUPERSEDED")).otherwise(F.lit("FAILED"))
    return A.load(spark, sf, "events").select((F.col("event_id") + 1).alias("generation_number"), status.alias("status"), F.col("ts").alias("activated_at"))


def root_document_count(spark, sf):
    root = H.folder_summary(_compact(spark, sf), 12)
    return H.root_document_count(root, _generations(spark, sf))


def latest_generation(spark, sf):
    return H.latest_generation(_generations(spark, sf), activate=True)


def folder_reuse_set(spark, sf):
    desired = _compact(spark, sf)
    doc = F.col("document_id").cast("long")
    current = desired.filter(doc % 97 != 1)
    refreshed = desired.filter(doc % 89 == 2).select("document_id")
    return H.folder_reuse_set(desired, current, refreshed)


def index_card_cache_key(spark, sf):
    return H.index_card_cache_key(A.parts(spark, sf), A.source_files(spark, sf), "m1")


def batch_cache_key(spark, sf):
    parts = A.parts(spark, sf)
    return H.batch_cache_key(parts, folds.batch_index_parts(parts), A.source_files(spark, sf), "m1")


def _requests(spark, sf):
    """Repeated inputs: the lines of all documents, keyed by their digest."""
    lines = A.load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    items = lines.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("position"), F.sha2("line", 256).alias("digest"))
    cache = items.filter(F.substring("digest", 1, 1).isin("0", "1", "2")).select("digest").distinct()
    return items, cache


def cache_reuse_join(spark, sf):
    items, cache = _requests(spark, sf)
    served, pending = H.cache_reuse_join(items, cache)
    return served.withColumn("state", F.lit("cached")).unionByName(pending.withColumn("state", F.lit("pending")))


def fan_out_plan(spark, sf):
    return H.fan_out_plan(_requests(spark, sf)[0])


def fan_out_totals(spark, sf):
    return H.fan_out_totals(*_requests(spark, sf))


def refresh_plan(spark, sf):
    files = I.eligible_documents(A.source_files(spark, sf))
    parts = A.parts(spark, sf)
    ids = files.select(F.col("id").alias("document_id"))
    cached = ids.filter(F.col("document_id") % 3 == 0)
    batches = folds.batch_index_parts(parts).filter(F.col("batch_no") % 2 == 1).select("document_id", "batch_no").distinct()
    return H.refresh_plan(files, cached, folds.document_plan(parts), batches)


def explode_card_parts(spark, sf):
    return H.explode_card_parts(A.cards(spark, sf)).select("document_id", "part_no", "part_id", "label", "summary", "md_path")


def cards_with_artifacts(spark, sf):
    short = A.parts(spark, sf).filter(~((F.col("document_id") % 10 == 3) & (F.col("part_no") == 2)))
    out = H.cards_with_artifacts(A.cards(spark, sf), short)
    return out.select("folder_id", "document_id", "part_id", "label", "summary", F.sha2("body", 256).alias("body_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        compact_card, group_cards_by_folder, folder_summary, term_folder_counts, rank_root_terms, unique_document_values, build_root,
        root_document_count, latest_generation, folder_reuse_set, index_card_cache_key, batch_cache_key, cache_reuse_join, fan_out_plan,
        fan_out_totals, refresh_plan, explode_card_parts, cards_with_artifacts,
    )
}

ROOT = """
topic_rows AS (SELECT folder_id, relative_path, document_id, generate_subscripts(topics, 1) AS pos, unnest(topics) AS term FROM docs),
entity_rows AS (SELECT folder_id, relative_path, document_id, generate_subscripts(entities, 1) AS pos, unnest(entities) AS term FROM docs),
topic_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY folders, coverage DESC, relative_path, document_id, pos, term) AS k,
         row_number() OVER (PARTITION BY folder_id ORDER BY coverage DESC, relative_path, document_id, pos) AS used_k
  FROM (SELECT folder_id, term, count(*) AS coverage, unnest(min(struct_pack(relative_path, document_id, pos))) FROM topic_rows GROUP BY folder_id, term)
  JOIN (SELECT term, count(DISTINCT folder_id) AS folders FROM topic_rows GROUP BY term) USING (term)
),
entity_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY folders, coverage DESC, relative_path, document_id, pos, term) AS k
  FROM (SELECT folder_id, term, count(*) AS coverage, unnest(min(struct_pack(relative_path, document_id, pos))) FROM entity_rows GROUP BY folder_id, term)
  JOIN (SELECT term, count(DISTINCT folder_id) AS folders FROM entity_rows GROUP BY term) USING (term)
),
title_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY first_path) AS k FROM (SELECT folder_id, trim(title) AS title, min(relative_path) AS first_path FROM docs GROUP BY ALL)
),
folder_heads AS (
  SELECT folder_id, source_directory, document_count, substr(source_directory || ': ' || document_count || ' document(s). ' ||
         CASE WHEN topics IS NOT NULL THEN 'Topics: ' || topics || '.' ELSE titles END, 1, 800) AS summary
  FROM (SELECT folder_id, source_directory, count(*) AS document_count FROM docs GROUP BY ALL)
  LEFT JOIN (SELECT folder_id, string_agg(term, ', ' ORDER BY used_k) AS topics FROM topic_ranks WHERE used_k <= 12 GROUP BY folder_id) USING (folder_id)
  LEFT JOIN (SELECT folder_id, string_agg(title, ', ' ORDER BY k) AS titles FROM (
    SELECT folder_id, title, row_number() OVER (PARTITION BY folder_id ORDER BY relative_path) AS k FROM docs) WHERE k <= 5 GROUP BY folder_id) USING (folder_id)
)"""
_GENERATIONS = """generations AS (SELECT event_id + 1 AS generation_number, ts AS activated_at,
 CASE event_type WHEN 'signup' THEN 'BUILDING' WHEN 'view' THEN 'VALIDATED' WHEN 'click' THEN 'ACTIVE' WHEN 'purchase' THEN 'SUPERSEDED' ELSE 'FAILED' END AS status FROM events)"""
_ITEMS = """items AS MATERIALIZED (SELECT doc_id * 100000 + n - 1 AS position, sha256(line) AS digest FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"""
_SIZED = "sized AS MATERIALIZED (SELECT document_id, part_no, length(markdown) AS size FROM parts)"


def _packed():
    from catalog.inventory_queries import _next_fit

    return _next_fit(30000, 24)


SQL = {
    "compact_card": sql.with_(
        sql.parts(),
        select="""SELECT folder_id, document_id::VARCHAR AS document_id, title, substr(summary, 1, 600) AS summary, array_to_string(topics, ',') AS topics,
 array_to_string(entities, ',') AS entities, 'md/' || document_id || '/card.json' AS card_path FROM docs""",
    ),
    "group_cards_by_folder": sql.with_(
        sql.FILES, sql.parts(),
        select="""SELECT folder_id, source_directory, document_id::VARCHAR AS document_id, d.relative_path AS source_path FROM docs d
JOIN files f ON f.id = d.document_id WHERE source_status = 'PRESENT' AND conversion_status = 'READY'""",
    ),
    "folder_summary": sql.with_(sql.parts(), ROOT, select="SELECT folder_id, source_directory, document_count, summary FROM folder_heads"),
    "term_folder_counts": sql.with_(sql.parts(), ROOT, select="SELECT term, count(DISTINCT folder_id) AS folders FROM topic_rows GROUP BY term"),
    "rank_root_terms": sql.with_(sql.parts(), ROOT, select="SELECT folder_id, string_agg(term, ',' ORDER BY k) AS topics FROM topic_ranks WHERE k <= 20 GROUP BY folder_id"),
    "unique_document_values": sql.with_(sql.parts(), ROOT, select="SELECT folder_id, string_agg(title, '|' ORDER BY k) AS titles FROM title_ranks WHERE k <= 8 GROUP BY folder_id"),
    "build_root": sql.with_(
        sql.parts(), ROOT,
        select="""SELECT folder_id, source_directory, summary, document_count, split_part(source_directory, '/', 2) AS document_types,
 coalesce((SELECT string_agg(term, '|' ORDER BY k) FROM topic_ranks t WHERE t.folder_id = h.folder_id AND k <= 20), '') AS topics,
 coalesce((SELECT string_agg(term, '|' ORDER BY k) FROM entity_ranks t WHERE t.folder_id = h.folder_id AND k <= 16), '') AS entities,
 (SELECT string_agg(title, '|' ORDER BY k) FROM title_ranks t WHERE t.folder_id = h.folder_id AND k <= 8) AS representative_titles,
 'folders/' || folder_id || '.json' AS index_path FROM folder_heads h""",
    ),
    "root_document_count": sql.with_(
        _GENERATIONS,
        select="""SELECT (SELECT max(generation_number) FROM generations WHERE status = 'ACTIVE') AS current_generation,
 (SELECT max(activated_at) FROM generations WHERE status = 'ACTIVE') AS last_generated, count(*) AS document_count, count(DISTINCT source || '/' || lang) AS folder_count FROM documents""",
    ),
    "latest_generation": sql.with_(
        _GENERATIONS,
        select="""SELECT generation_number, CASE WHEN status IN ('BUILDING', 'VALIDATED') THEN 'FAILED' WHEN status = 'ACTIVE' THEN 'SUPERSEDED' ELSE status END AS status FROM generations
UNION ALL SELECT max(generation_number) + 1, 'ACTIVE' FROM generations""",
    ),
    "folder_reuse_set": """SELECT 'folder-' || sha256(source || '/' || lang)[1:16] AS folder_id,
 count(*) FILTER (WHERE (doc_id + 1) % 97 = 1 OR (doc_id + 1) % 89 = 2) = 0 AS reuse FROM documents GROUP BY source, lang""",
    "index_card_cache_key": sql.with_(
        sql.parts(),
        select="""SELECT document_id, sha256(concat_ws(chr(0), 'index-card-v2', 'm1', relative_path, source_sha256, ids)) AS cache_key
FROM docs JOIN (SELECT document_id, string_agg(part_id, chr(0) ORDER BY part_no) AS ids FROM parts GROUP BY ALL) USING (document_id)""",
    ),
    "batch_cache_key": sql.with_(
        sql.parts(), _SIZED, _packed(),
        select="""SELECT document_id, batch_no, sha256(concat_ws(chr(0), 'index-part-batch-v1', 'm1', source_sha256, texts)) AS cache_key
FROM docs JOIN (SELECT document_id, batch_no, string_agg(part_id || chr(0) || markdown, chr(0) ORDER BY part_no) AS texts
  FROM packed JOIN parts USING (document_id, part_no) GROUP BY ALL) USING (document_id)""",
    ),
    "cache_reuse_join": sql.with_(_ITEMS, select="SELECT position, digest, CASE WHEN digest[1] IN ('0', '1', '2') THEN 'cached' ELSE 'pending' END AS state FROM items"),
    "fan_out_plan": sql.with_(_ITEMS, select="SELECT digest, min(position) AS first_position, count(*) AS uses FROM items GROUP BY digest"),
    "fan_out_totals": sql.with_(
        _ITEMS,
        select="""SELECT count(*) AS total_items, count(*) FILTER (WHERE digest[1] IN ('0', '1', '2')) AS cache_hit_items,
 count(DISTINCT digest) FILTER (WHERE digest[1] NOT IN ('0', '1', '2')) AS model_requests FROM items""",
    ),
    "refresh_plan": sql.with_(
        sql.FILES, sql.parts(), _SIZED, _packed(),
        """planned AS (SELECT id, index_status <> 'INDEXED' AS refresh, id % 3 = 0 AS hit, big, CASE WHEN big THEN (batches + 1) // 2 ELSE 0 END AS cached, batches
 FROM files JOIN (SELECT document_id AS id, sum(size) > 60000 OR count(*) > 24 AS big, max(batch_no) AS batches FROM packed JOIN sized USING (document_id, part_no) GROUP BY ALL) USING (id)
 WHERE source_status = 'PRESENT' AND conversion_status = 'READY')""",
        select="""SELECT count(*) AS total_documents, count(*) FILTER (WHERE refresh) AS documents_to_refresh, count(*) FILTER (WHERE NOT refresh) AS documents_reused,
 count(*) FILTER (WHERE refresh AND hit) AS document_card_cache_hits, coalesce(sum(cached) FILTER (WHERE refresh AND NOT hit), 0)::BIGINT AS batch_cache_hits,
 coalesce(sum(CASE WHEN big THEN batches - cached + 1 ELSE 1 END) FILTER (WHERE refresh AND NOT hit), 0)::BIGINT AS model_requests_total FROM planned""",
    ),
    "explode_card_parts": sql.with_(
        sql.parts(),
        select="SELECT document_id::VARCHAR AS document_id, part_no::INTEGER AS part_no, part_id, label, part_summary AS summary, 'md/' || document_id || '/' || part_id || '.md' AS md_path FROM parts",
    ),
    "cards_with_artifacts": sql.with_(
        sql.parts(),
        select="""SELECT folder_id, document_id::VARCHAR AS document_id, part_id, label, part_summary AS summary, sha256 AS body_hash FROM parts JOIN docs USING (document_id)
WHERE NOT (document_id % 10 = 3 AND document_id IN (SELECT document_id FROM parts WHERE part_no = 2))""",
    ),
}
