"""Queries of the search family over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..sources import scratch_folder
from .registry import SQL, query, table

PHRASE = "the license"
TERMS = "licensed under license"
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}\p{Pc}]+|_'), lambda x: x <> '')"


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license')")
def search_like(spark, folder):
    return search.like(table(spark, folder, "documents"), "license").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed') AND contains(lower(text), 'under') AND contains(lower(text), 'license')")
def search_terms_all(spark, folder):
    return search.all_terms(table(spark, folder, "documents"), TERMS).select("doc_id")


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under license') THEN 1 WHEN contains(lower(text), 'licensed') AND contains(lower(text), 'under') AND contains(lower(text), 'license') THEN 2
  WHEN contains(lower(text), 'licensed') OR contains(lower(text), 'under') OR contains(lower(text), 'license') THEN 3 END AS tier FROM documents) SELECT doc_id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""
)
def search_cascade(spark, folder):
    return search.cascade(table(spark, folder, "documents"), TERMS).select("doc_id", "tier")


@query(
    f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS length, len(list_filter(w, lambda x: x = 'mit')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, ((a > 0)::INT + (b > 0)::INT)::INT AS hits, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0"""
)
def search_bm25(spark, folder):
    return search.bm25(table(spark, folder, "documents"), "MIT license").withColumn("score", F.round("score", 6))


@query(SQL["search_bm25"])
def search_index(spark, folder):
    """BM25 from an index that is written once and read by the buckets of the query's terms."""
    at = scratch_folder(spark, "index")
    search.build_index(table(spark, folder, "documents"), at)
    return search.bm25_of_index(spark, at, "MIT license").withColumn("score", F.round("score", 6))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'the license') THEN 'exact' WHEN contains(lower(text), 'the') AND contains(lower(text), 'license') THEN 'all_terms' WHEN contains(lower(text), 'the') OR contains(lower(text), 'license') THEN 'partial_terms' ELSE 'unknown' END AS quality, (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT)::INT AS hits FROM documents")
def search_match_quality(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", search.match_quality(text, PHRASE).alias("quality"), search.token_hits(text, PHRASE).alias("hits"))


@query(
    """WITH a AS (SELECT doc_id, text, greatest(instr(lower(text), 'license') - 1, 0) AS pos FROM documents WHERE contains(lower(text), 'license')), b AS (SELECT *, greatest(pos - 48, 0) AS s, least(length(text), pos + 7 + 96) AS e FROM a),
c AS (SELECT *, substring(text, s + 1, e - s) AS cut FROM b), h AS (SELECT *, instr(lower(cut), 'license') AS h FROM c)
SELECT doc_id, (CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(cut, 1, h - 1) || '[' || substring(cut, h, 7) || ']' || substring(cut, h + 7) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) AS snippet FROM h"""
)
def search_snippets(spark, folder):
    found = search.like(table(spark, folder, "documents"), "license")
    return found.select("doc_id", search.snippet(F.col("text"), "license").alias("snippet"))


@query(f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def search_postings(spark, folder):
    index = search.postings(table(spark, folder, "documents"))
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))
