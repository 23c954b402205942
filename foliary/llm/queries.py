"""One registered query per operator over its whole table, and the DuckDB statement where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliary.llm import alignment, collocations, dialogues, hosts, leaks, lines, mixing, nearcopies, pages, sanitising, suffixes, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(_table(spark, sf_dir, "pages"))


def op2_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_units(_table(spark, sf_dir, "documents"))


def op3_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.findings(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_unlabelled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_dictionary_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stored(spark, _table(spark, sf_dir, "documents"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judged(_table(spark, sf_dir, "documents"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.components(_table(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.perspectives(_table(spark, sf_dir, "conversations"))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitising.report(_table(spark, sf_dir, "documents"))


def op10_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op11_top_order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"))


def op13_columnwise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_host_paths": op1_host_paths,
    "op2_line_hashes": op2_line_hashes,
    "op3_simhash_leaks": op3_simhash_leaks,
    "op4_unlabelled_toxicity": op4_unlabelled_toxicity,
    "op5_dictionary_shards": op5_dictionary_shards,
    "op6_host_rules": op6_host_rules,
    "op7_hyperminhash": op7_hyperminhash,
    "op8_perspectives": op8_perspectives,
    "op9_disclosure": op9_disclosure,
    "op10_subset_sum_mix": op10_subset_sum_mix,
    "op11_top_order_rollup": op11_top_order_rollup,
    "op12_token_spans": op12_token_spans,
    "op13_columnwise_suffixes": op13_columnwise_suffixes,
}

_HOST_RULES = ("few_words", "repeats", "symbols", "dup_lines")
_SIZE = """
CASE WHEN {r}_mean * (1 - {r}_mean) <= 0
       OR {r}_var - {r}_mean * (1 - {r}_mean) * share <= {r}_mean * (1 - {r}_mean) * 1e-6 THEN 1e6
     ELSE least(1e6, greatest(1.0,
       ({r}_mean * (1 - {r}_mean) - ({r}_var - {r}_mean * (1 - {r}_mean) * share))
       / ({r}_var - {r}_mean * (1 - {r}_mean) * share))) END"""

SQL = {
    "op8_perspectives": """
WITH t AS (
  SELECT conv_id, coalesce(translate(role, '<|>' || chr(10) || chr(13), ''), 'unknown') AS role,
         replace(coalesce(text, ''), '<|im_', '<|im-') AS said, turn
  FROM conversations
),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, said) AS n FROM t),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM n WHERE role <> 'system'),
h AS (
  SELECT n.conv_id, speaker, n, said, role = speaker AS own, '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant'
         WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
),
o AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS piece,
         sum(length(head || said) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY n) - length(head || said) - 11 AS place
  FROM h
)
SELECT conv_id, speaker, ((n - 1) // 64)::INTEGER AS block, count(*)::INTEGER AS n_turns, min(place)::BIGINT AS start,
       string_agg(piece, '' ORDER BY n) AS text,
       coalesce(string_agg((place + length(head))::BIGINT || ':' || (place + length(head || said) + 10)::BIGINT, ',' ORDER BY n)
                FILTER (own), '') AS spans
FROM o GROUP BY conv_id, speaker, (n - 1) // 64
""",
    "op6_host_rules": f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         CASE WHEN regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) <> ''
              THEN lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))
              ELSE coalesce(source, '') END AS host
  FROM documents
),
g AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM g) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid
),
m AS MATERIALIZED (
  SELECT doc_id, host, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
),
h AS (
  SELECT host, count(*) AS documents, count_if(n_words < 50) AS few_words,
         count_if(100 * n_repeat_words > 50 * n_words) AS repeats, count_if(10 * n_symbols > word_chars) AS symbols,
         count_if(5 * n_dup_lines > n_words) AS dup_lines
  FROM m GROUP BY host
),
means AS (SELECT count(*) / sum(documents) AS share, sum(documents) AS total,
  {', '.join(f'sum({r}) / sum(documents) AS {r}_mean' for r in _HOST_RULES)} FROM h),
prior AS (SELECT any_value(share) AS share,
  {', '.join(f'any_value({r}_mean) AS {r}_mean, sum(documents * ({r} / documents - {r}_mean) ** 2) / any_value(total) AS {r}_var' for r in _HOST_RULES)}
  FROM h, means),
bad AS (
  SELECT host FROM h, prior
  WHERE greatest({', '.join(f'({r} + {r}_mean * ({_SIZE.format(r=r)})) / (documents + ({_SIZE.format(r=r)}))' for r in _HOST_RULES)}) > 0.9
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND host NOT IN (SELECT host FROM bad) AS kept
FROM m
""",
    "op11_top_order_rollup": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13),
         'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9)), chr(10))) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS MATERIALIZED (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM i),
total AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS n FROM t GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS n FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (
  SELECT lang, x, y, max(n) AS n FROM (SELECT lang, w1 AS x, w2 AS y, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY ALL
),
cut AS (
  SELECT f.lang, f.w1 || ' ' || f.w2 AS phrase, f.n AS a, 1 AS k, a.n AS l, b.n AS r
  FROM f2 f JOIN f1 a ON a.lang = f.lang AND a.w1 = f.w1 JOIN f1 b ON b.lang = f.lang AND b.w1 = f.w2
  LEFT JOIN inside i ON i.lang = f.lang AND i.x = f.w1 AND i.y = f.w2
  WHERE f.n >= 10 AND (i.n IS NULL OR 100 * i.n < 50 * f.n)
  UNION ALL
  SELECT f.lang, f.w1 || ' ' || f.w2 || ' ' || f.w3, f.n, 1, a.n, b.n
  FROM f3 f JOIN f1 a ON a.lang = f.lang AND a.w1 = f.w1 JOIN f2 b ON b.lang = f.lang AND b.w1 = f.w2 AND b.w2 = f.w3
  UNION ALL
  SELECT f.lang, f.w1 || ' ' || f.w2 || ' ' || f.w3, f.n, 2, a.n, b.n
  FROM f3 f JOIN f2 a ON a.lang = f.lang AND a.w1 = f.w1 AND a.w2 = f.w2 JOIN f1 b ON b.lang = f.lang AND b.w1 = f.w3
),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
best AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM low WHERE nth = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM best JOIN total USING (lang) WHERE rank <= 2000
""",
}
