"""Search queries and their SQL."""

from pyspark.sql import functions as F

from catalog import sql
from foliary.operators import lexical as L
from foliary.operators.sizing import settled
from foliary.plans import adapter as A
from foliary.functions import text as X


def _search(spark, sf):
    return L.part_search(A.records(spark, sf))


def top_candidates(spark, sf):
    return L.top_candidates(A.questions(spark, sf), A.records(spark, sf), A.FIXTURE)


def lexical_terms(spark, sf):
    return A.load(spark, sf, "documents").select("doc_id", F.array_join(X.lexical_terms(F.col("text")), " ").alias("terms"))


def lexical_normalize(spark, sf):
    return A.load(spark, sf, "documents").select("doc_id", X.lexical_normalize(F.col("text")).alias("folded"))


def index_terms(spark, sf):
    return A.load(spark, sf, "documents").select("doc_id", F.posexplode(X.index_terms(F.col("text"))).alias("pos", "term"))


def query_terms(spark, sf):
    return A.questions(spark, sf).select(
        "question_id", F.posexplode(X.query_terms(F.col("text"))).alias("pos", "term")
    )


def explode_part_terms(spark, sf):
    return L.explode_part_terms(_search(spark, sf)).select("document_id", "part_id", "field", "term")


def corpus_term_stats(spark, sf):
    stats = L.corpus_term_stats(L.part_postings(_search(spark, sf)))
    return stats.select(
        "term", "document_frequency",
        F.when(F.col("term") == L.EVERY_PART, F.round("mean_length", 6)).alias("mean_length"),
    )


def search_postings(spark, sf):
    terms = L.question_terms(A.questions(spark, sf))
    hits = L.search_postings(terms, L.part_postings(_search(spark, sf)))
    return hits.select("question_id", "term", "document_id", "part_no", "weight", "length")


def bm25_score(spark, sf):
    return L.part_scores(A.questions(spark, sf), A.records(spark, sf)).select(
        "question_id", "document_id", "part_no", F.round(-F.col("units") / L.UNITS, 6).alias("score")
    )


def _ranked(spark, sf):
    postings = settled(L.part_postings(_search(spark, sf)))
    return L.rank_candidates(L.question_terms(A.questions(spark, sf)), postings, L.corpus_term_stats(postings))


def rank_candidates(spark, sf):
    return _ranked(spark, sf).select("question_id", "document_id", "part_no", "rank")


def diversify_candidates(spark, sf):
    return L.diversify_candidates(_ranked(spark, sf), 2, 40).select("question_id", "document_id", "part_no", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        top_candidates, lexical_terms, lexical_normalize, index_terms, query_terms, explode_part_terms,
        corpus_term_stats, search_postings, bm25_score, rank_candidates, diversify_candidates,
    )
}

_WORDS = sql.terms("text")
_BASE = (sql.parts(), sql.lexical())
_SCORED = (*_BASE, sql.query_terms(), sql.ranked())

SQL = {
    "top_candidates": sql.search("SELECT * FROM candidates"),
    "lexical_terms": f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS terms FROM documents",
    "lexical_normalize": "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents",
    "index_terms": f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INTEGER AS pos, term FROM (
  SELECT doc_id, term, min(p) AS first FROM (
    SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS p
    FROM (SELECT doc_id, {_WORDS} AS t FROM documents)) GROUP BY ALL)""",
    "query_terms": f"""
SELECT question_id, pos::INTEGER AS pos, term FROM (
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY first) - 1 AS pos, term FROM (
    SELECT question_id, term, min(p) AS first FROM (
      SELECT question_id, unnest(t) AS term, generate_subscripts(t, 1) AS p
      FROM (SELECT item_id AS question_id, {_WORDS} AS t FROM benchmark)) GROUP BY ALL)) WHERE pos < 48""",
    "explode_part_terms": sql.with_(
        *_BASE, select="SELECT document_id, part_id, field, term FROM part_field_terms"
    ),
    "corpus_term_stats": sql.with_(
        *_BASE,
        select="""SELECT term, document_frequency, NULL::DOUBLE AS mean_length FROM term_stats
UNION ALL SELECT '', n, round(mean_length, 6) FROM corpus""",
    ),
    "search_postings": sql.with_(
        *_BASE, sql.query_terms(),
        select="""SELECT question_id, term, p.document_id, p.part_no::INTEGER AS part_no, weight, length::INTEGER AS length
FROM query_terms JOIN postings p USING (term) JOIN lengths l ON l.document_id = p.document_id AND l.part_no = p.part_no""",
    ),
    "bm25_score": sql.with_(
        *_SCORED,
        select="SELECT question_id, document_id, part_no::INTEGER AS part_no, round(-units / 1e12, 6) AS score FROM scores",
    ),
    "rank_candidates": sql.with_(
        *_SCORED, select="SELECT question_id, document_id, part_no::INTEGER AS part_no, rank::INTEGER AS rank FROM ranked"
    ),
    "diversify_candidates": sql.with_(
        *_BASE, sql.query_terms(), sql.ranked(40, 2),
        select="SELECT question_id, document_id::BIGINT AS document_id, split_part(part_id, '-', 2)::INTEGER AS part_no, rank FROM candidates",
    ),
}
