"""SQL fragments shared by the DuckDB statements: the adapter projections as common tables."""

from foliary.functions.text import STOP_TERMS

BLANK = "(' ' || chr(9) || chr(10) || chr(13))"
FOLD = "replace(lower({x}), 'ß', 'ss')"


def terms(x: str) -> str:
    """List of lexical terms (Latin tables only)."""
    return (
        f"list_filter(regexp_extract_all({FOLD.format(x=x)}, '[a-z0-9]+'),"
        " lambda t: length(t) >= 2 or regexp_full_match(t, '[0-9]'))"
    )


def distinct(items: str) -> str:
    """Ordered distinct list."""
    return f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"


FILES = """
files AS MATERIALIZED (
  SELECT doc_id + 1 AS id, source || '/' || lang || '/' || doc_id || '.txt' AS relative_path,
         doc_id || '.txt' AS filename, '.txt' AS extension, strlen(text)::BIGINT AS size,
         1700000000000000000 + doc_id * 1000000000 AS mtime_ns, sha256(text) AS sha256,
         CASE WHEN doc_id % 17 = 0 THEN 'MISSING' ELSE 'PRESENT' END AS source_status,
         CASE doc_id % 7 WHEN 0 THEN 'NEW' WHEN 1 THEN 'CHANGED' WHEN 2 THEN 'FAILED' ELSE 'READY' END AS conversion_status,
         CASE doc_id % 5 WHEN 0 THEN 'NOT_INDEXED' WHEN 1 THEN 'STALE' ELSE 'INDEXED' END AS index_status,
         CASE WHEN doc_id % 7 = 2 THEN 'conversion failed' END AS last_error
  FROM documents
)"""


def cut(source: str, key: str, text: str, limit: int, name: str = "cut", where: str = "true") -> str:
    """Recursive cutting of `text` into chunks; needs WITH RECURSIVE. Gives `{name}(key, n, chunk)`."""
    return f"""
{name}_steps({key}, n, chunk, rest) AS (
  SELECT {key}, 0, NULL::VARCHAR, {text} FROM {source} WHERE {where}
  UNION ALL
  SELECT {key}, n + 1,
         CASE WHEN length(rest) <= {limit} THEN rest ELSE trim(substr(rest, 1, sp), {BLANK}) END,
         CASE WHEN length(rest) <= {limit} THEN '' ELSE ltrim(substr(rest, sp + 1), {BLANK}) END
  FROM (
    SELECT {key}, n, rest,
           CASE WHEN two >= {limit} // 2 THEN two WHEN one >= {limit} // 2 THEN one ELSE {limit} END AS sp
    FROM (
      SELECT {key}, n, rest,
             CASE WHEN strpos(back, chr(10) || chr(10)) > 0
                  THEN {limit} - strpos(back, chr(10) || chr(10)) - 1 ELSE -1 END AS two,
             CASE WHEN strpos(back, chr(10)) > 0 THEN {limit} - strpos(back, chr(10)) ELSE -1 END AS one
      FROM (SELECT *, reverse(substr(rest, 1, {limit})) AS back FROM {name}_steps WHERE rest <> '')
    )
  )
),
{name} AS MATERIALIZED (SELECT {key}, n, chunk FROM {name}_steps WHERE n > 0)"""


def parts(limit: int = 1000) -> str:
    """`docs` (document scalars) and `parts` (numbered Markdown parts). Needs WITH RECURSIVE."""
    words = terms("text")
    five = "list_filter(terms, lambda t: length(t) >= 5)"
    eight = "list_filter(terms, lambda t: length(t) >= 8)"
    return f"""
docs AS MATERIALIZED (
  SELECT document_id, relative_path, source_directory, 'folder-' || sha256(source_directory)[1:16] AS folder_id,
         source_sha256, lang, clean, substr(split_part(clean, chr(10), 1), 1, 300) AS title,
         substr(clean, 1, 4000) AS summary,
         ({distinct(five)})[1:5] AS topics, ({distinct(eight)})[1:3] AS entities
  FROM (
    SELECT doc_id + 1 AS document_id, source || '/' || lang || '/' || doc_id || '.txt' AS relative_path,
           source || '/' || lang AS source_directory, sha256(text) AS source_sha256, lang,
           trim(text, {BLANK}) AS clean, {words} AS terms
    FROM documents
  )
),
{cut("docs", "document_id", "clean", limit)},
parts AS MATERIALIZED (
  SELECT *, sha256(markdown) AS sha256 FROM (
    SELECT document_id, n AS part_no, 'part-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS part_id,
           'section-' || n AS section, chunk AS body, 'Part ' || n AS label,
           substr(split_part(chunk, chr(10), 1), 1, 2000) AS part_summary,
           '---' || chr(10) || 'document_id: ' || document_id || chr(10)
           || 'source_path: "' || relative_path || '"' || chr(10)
           || 'source_sha256: "' || source_sha256 || '"' || chr(10)
           || 'part_id: "part-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') || '"' || chr(10)
           || 'converted_at: "2024-01-01T00:00:00+00:00"' || chr(10)
           || 'converter_version: "document-conversion-v4"' || chr(10)
           || 'section: "section-' || n || '"' || chr(10) || '---' || chr(10) || chr(10)
           || chunk || chr(10) AS markdown
    FROM cut JOIN docs USING (document_id)
  )
)"""


STOP = "[" + ", ".join(f"'{t}'" for t in STOP_TERMS) + "]"


def lexical(limit: int = 1000) -> str:
    """After `parts`: `part_field_terms`, `postings`, `lengths`, `term_stats`, `corpus`."""
    return f"""
part_fields AS (
  SELECT document_id, part_no, part_id, folder_id, relative_path AS source_path, f.field, f.weight, f.txt
  FROM parts JOIN docs USING (document_id),
  LATERAL (VALUES
    ('source_path', 12, relative_path), ('title', 10, title || ' ' || lang),
    ('metadata', 8, array_to_string(list_concat(topics, entities), ' ')),
    ('part_summary', 6, label || ' ' || part_summary), ('body', 1, markdown)) AS f(field, weight, txt)
),
part_field_terms AS MATERIALIZED (
  SELECT DISTINCT document_id, part_no, part_id, folder_id, source_path, field, weight, term
  FROM (SELECT *, unnest({terms("txt")}) AS term FROM part_fields)
),
postings AS MATERIALIZED (
  SELECT document_id, part_no, part_id, folder_id, source_path, term, sum(weight)::INTEGER AS weight
  FROM part_field_terms GROUP BY ALL
),
lengths AS MATERIALIZED (
  SELECT document_id, part_no, part_id, folder_id, source_path, count(*) AS length
  FROM part_field_terms GROUP BY ALL
),
corpus AS MATERIALIZED (SELECT count(*) AS n, avg(length) AS mean_length FROM lengths),
term_stats AS MATERIALIZED (SELECT term, count(*) AS document_frequency FROM postings GROUP BY term)"""


def query_terms(source: str = "SELECT item_id AS question_id, text FROM benchmark") -> str:
    return f"""
query_terms AS MATERIALIZED (
  SELECT question_id, term FROM (
    SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS k
    FROM (
      SELECT question_id, term, min(pos) AS pos FROM (
        SELECT question_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
        FROM (SELECT question_id, {terms("text")} AS t FROM ({source}))
      ) WHERE NOT list_contains({STOP}, term) GROUP BY ALL
    )
  ) WHERE k <= 48
)"""


def ranked(limit: int = 80, per_document: int = 12) -> str:
    """After `lexical` and `query_terms`: `scores`, `ranked`, `candidates`."""
    return f"""
scores AS MATERIALIZED (
  SELECT question_id, p.folder_id, p.document_id, p.part_id, p.part_no, p.source_path,
         sum(round(idf * (weight * 2.2::DOUBLE) / (weight + 1.2::DOUBLE * ((1 - 0.75::DOUBLE)
             + 0.75::DOUBLE * l.length / c.mean_length)) * 1e12)::BIGINT)::BIGINT AS units
  FROM query_terms q
  JOIN (SELECT term, CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END AS idf
        FROM (SELECT term, ln((n - document_frequency + 0.5::DOUBLE) / (document_frequency + 0.5::DOUBLE)) AS raw
              FROM term_stats, corpus)) s USING (term)
  JOIN (SELECT document_id, part_no, part_id, folder_id, source_path, term, weight::DOUBLE AS weight FROM postings) p
       USING (term)
  JOIN lengths l ON l.document_id = p.document_id AND l.part_no = p.part_no, corpus c
  GROUP BY ALL
),
ranked AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY units DESC, source_path, document_id, part_no) AS rank
    FROM scores) WHERE rank <= 200
),
candidates AS MATERIALIZED (
  SELECT question_id, folder_id, document_id::VARCHAR AS document_id, part_id, rank::INTEGER AS rank,
         round(-units / 1e12, 6) AS score
  FROM (
    SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY rank) AS share FROM ranked)
    WHERE share <= {per_document}
  ) WHERE rank <= {limit}
)"""


def with_(*tables: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(t.strip() for t in tables) + "\n" + select


def search(select: str, *more: str) -> str:
    """Statement over everything up to `candidates`."""
    return with_(parts(), lexical(), query_terms(), ranked(), *more, select=select)
