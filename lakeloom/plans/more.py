"""Further queries: single counters, summaries, alignment, windows of events, argmax and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import bigrams, ratio
from ..operators import pages, routing, structure, web
from .quality import COUNTERS, _scored
from .registry import query, table
from .structure import _ELEMENTS


@query(COUNTERS + "SELECT doc_id, table_like_lines FROM q WHERE table_like_lines > 0")
def table_like_lines(spark, folder):
    return _scored(spark, folder).filter("table_like_lines > 0").select("doc_id", "table_like_lines")


@query(COUNTERS + "SELECT doc_id, footnote_like_lines, round(footnote_like_lines::DOUBLE / greatest(nonempty_lines, 1)::DOUBLE, 3) AS density FROM q")
def footnote_density(spark, folder):
    return _scored(spark, folder).select("doc_id", "footnote_like_lines", ratio(F.col("footnote_like_lines"), F.greatest(F.col("nonempty_lines"), F.lit(1))).alias("density"))


@query(COUNTERS + "SELECT doc_id, html_tag_lines, replacement_chars FROM q")
def html_residue_lines(spark, folder):
    return _scored(spark, folder).select("doc_id", "html_tag_lines", "replacement_chars")


@query(COUNTERS + "SELECT doc_id, short_line_ratio, short_line_ratio > 0.45 AND nonempty_lines > 30 AS penalised FROM q")
def short_line_ratio(spark, folder):
    return _scored(spark, folder).select("doc_id", "short_line_ratio", ((F.col("short_line_ratio") > 0.45) & (F.col("nonempty_lines") > 30)).alias("penalised"))


@query(
    COUNTERS
    + """SELECT count(*) AS total, round(avg(headings), 3) AS avg_headings, round(avg(characters), 3) AS avg_characters, sum(table_like_lines)::BIGINT AS table_like_lines, sum(repeated_noise_lines)::BIGINT AS repeated_noise_lines,
 round(sum(page_headings)::DOUBLE / greatest(sum(headings), 1)::DOUBLE, 3) AS page_heading_ratio, count(*) FILTER (level IN ('review', 'poor')) AS review_or_poor FROM q"""
)
def quality_regression_summary(spark, folder):
    s = F.sum
    return _scored(spark, folder).agg(
        F.count("*").alias("total"),
        F.round(F.avg("headings"), 3).alias("avg_headings"),
        F.round(F.avg("characters"), 3).alias("avg_characters"),
        s("table_like_lines").alias("table_like_lines"),
        s("repeated_noise_lines").alias("repeated_noise_lines"),
        ratio(s("page_headings"), F.greatest(s("headings"), F.lit(1))).alias("page_heading_ratio"),
        F.count_if(F.col("level").isin("review", "poor")).alias("review_or_poor"),
    )


@query(COUNTERS + "SELECT d.source, arg_min(q.doc_id, [-q.score, -q.headings, q.doc_id]) AS best_id, max(q.score)::BIGINT AS best_score FROM q JOIN documents d ON d.doc_id = q.doc_id GROUP BY d.source")
def best_by_source(spark, folder):
    return _scored(spark, folder).groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("score"), -F.col("headings"), "doc_id")).alias("best_id"), F.max("score").alias("best_score"))


@query(COUNTERS + "SELECT level, count(*) AS documents, count(*) FILTER (score < 50) AS under_50, round(median(score), 3) AS median_score FROM q GROUP BY level")
def score_spread(spark, folder):
    return _scored(spark, folder).groupBy("level").agg(F.count("*").alias("documents"), F.count_if(F.col("score") < 50).alias("under_50"), F.round(F.median("score"), 3).alias("median_score"))


@query(_ELEMENTS + "SELECT type, count(*) AS elements, count(DISTINCT doc_id) AS documents, max(chars)::BIGINT AS longest FROM elements GROUP BY type")
def element_types(spark, folder):
    rows = structure.elements(table(spark, folder, "documents"))
    return rows.groupBy("type").agg(F.count("*").alias("elements"), F.countDistinct("doc_id").alias("documents"), F.max("chars").cast("long").alias("longest"))


@query()
def near_duplicate_turns(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("ordinal"), F.col("role").alias("name"), "text", F.lit("").alias("image_hash"))
    return pages.mark_duplicates(turns).select("book", "ordinal", "duplicate_group", "represents")


@query()
def outline_alignment(spark, folder):
    rows = table(spark, folder, "pages")
    outline = rows.select(F.col("page_id").alias("source"), F.explode(web.nav_titles(F.col("html"))).alias("title"))
    return routing.outline_alignment(outline, web.headings(rows).select(F.col("page_id").alias("source"), "title"))


@query("SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_windows(spark, folder):
    rows = table(spark, folder, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return rows.select(F.unix_micros("window.start").alias("start_us"), "event_type", "events", "users")


@query("SELECT o_custkey, arg_max(o_orderkey, [o_totalprice, -o_orderkey]) AS best_order, count(*) AS orders FROM orders GROUP BY o_custkey")
def best_order_of_customer(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"), F.count("*").alias("orders"))


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def customers_rollup(spark, folder):
    nations = F.broadcast(table(spark, folder, "nation"))  # 25 and 5 rows by definition
    rows = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def records_only_in_baseline(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, folder, "supplier").select("s_suppkey"))


@query("SELECT count(*) AS documents, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents")
def corpus_summary(spark, folder):
    return table(spark, folder, "documents").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query(r"SELECT item_id, len(list_distinct(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)))) AS pairs FROM (SELECT item_id, lower(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS t FROM benchmark)")
def benchmark_shingles(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", F.size(bigrams("text")).cast("long").alias("pairs"))


@query("SELECT quality, toxic, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_matrix(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unscored_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")
