"""Queries of the quality and review families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, review
from .registry import query, table

# Lines and counters in SQL; patterns are RE2's spelling of the rules in functions/headings.py.
_WS = r"[\s\p{Z}]"
LINES = rf"""
raw AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS ls FROM documents),
pieces AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM raw),
lines AS (SELECT doc_id, pos, line, regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') AS t, regexp_replace(line, '{_WS}+', '', 'g') AS k FROM pieces)"""
_KEY = r"""regexp_replace(regexp_replace(regexp_replace(k, '^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]+', ''), '[\-—–_·•]+第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$', ''), '^[\-—–_·•]+|[\-—–_·•]+$', '', 'g')"""
KEYED = rf"""
keyed0 AS (SELECT *, {_KEY} AS kk FROM lines WHERE t <> ''),
keyed AS (SELECT *, CASE WHEN t LIKE '#%' OR regexp_matches(t, '(?i)^<!--\s*Page\s+\d+\s*-->\s*$') OR regexp_matches(k, '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\d+|Part\w+)') OR regexp_matches(k, '^\d{{1,4}}$') OR length(kk) > 24 OR regexp_matches(kk, '[。！？!?；;：:，,、]$') THEN '' ELSE kk END AS key FROM keyed0)"""
COUNTERS = (
    "WITH"
    + LINES
    + ","
    + KEYED
    + r""",
noise AS (SELECT doc_id, sum(n) AS repeated_noise_lines FROM (SELECT doc_id, key, count(*) AS n FROM keyed WHERE key <> '' GROUP BY ALL HAVING count(*) >= 4) GROUP BY ALL),
counted AS (SELECT doc_id, count(*) AS nonempty_lines,
  count(*) FILTER (regexp_matches(t, '^#{1,6}\s+\S')) AS headings,
  count(*) FILTER (regexp_matches(t, '(?i)^#{1,6}\s+(page|第?\s*\d+\s*页|p\.?\s*\d+)\b')) AS page_headings,
  count(*) FILTER (regexp_matches(t, '^(第\s*)?\d{1,4}\s*(页)?$')) AS page_number_lines,
  count(*) FILTER (regexp_matches(t, '^(\[\^?\d+\]|\(\d+\)|\d+[.、])') OR t LIKE '%脚注%' OR t LIKE '%注释%') AS footnote_like_lines,
  count(*) FILTER (regexp_matches(t, '(?i)</?(div|span|p|br|html|body|section|aside|st)\b')) AS html_tag_lines,
  count(*) FILTER (regexp_matches(t, '\|.*\|') OR contains(t, chr(9))) AS table_like_lines,
  count(*) FILTER (length(t) <= 8 AND NOT regexp_matches(t, '^#{1,6}\s+')) AS short FROM lines WHERE t <> '' GROUP BY doc_id),
q0 AS (SELECT d.doc_id, length(coalesce(d.text, '')) AS characters, coalesce(nonempty_lines, 0) AS nonempty_lines, coalesce(headings, 0) AS headings, coalesce(page_headings, 0) AS page_headings,
  coalesce(page_number_lines, 0) AS page_number_lines, coalesce(footnote_like_lines, 0) AS footnote_like_lines, coalesce(html_tag_lines, 0) AS html_tag_lines, coalesce(table_like_lines, 0) AS table_like_lines,
  length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(65533), '')) AS replacement_chars, coalesce(repeated_noise_lines, 0)::BIGINT AS repeated_noise_lines,
  round(coalesce(short, 0)::DOUBLE / greatest(coalesce(nonempty_lines, 0), 1)::DOUBLE, 3) AS short_line_ratio
  FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN noise n ON n.doc_id = d.doc_id),
q1 AS (SELECT *, greatest(0, least(100, 100 - (CASE WHEN characters < 500 THEN 45 ELSE 0 END) - (CASE WHEN headings = 0 AND characters >= 1000 THEN 25 ELSE 0 END)
  - (CASE WHEN headings > 0 AND page_headings / greatest(headings, 1) > 0.7 THEN 25 ELSE 0 END) - (CASE WHEN page_number_lines / greatest(nonempty_lines, 1) > 0.08 THEN 12 ELSE 0 END)
  - (CASE WHEN footnote_like_lines / greatest(nonempty_lines, 1) > 0.18 THEN 10 ELSE 0 END) - least(15, html_tag_lines) - least(20, replacement_chars)
  - (CASE WHEN short_line_ratio > 0.45 AND nonempty_lines > 30 THEN 10 ELSE 0 END) - (CASE WHEN repeated_noise_lines >= 4 THEN least(12, repeated_noise_lines // 2) ELSE 0 END))) AS score FROM q0),
q AS (SELECT *, CASE WHEN score >= 85 THEN 'good' WHEN score >= 65 THEN 'review' ELSE 'poor' END AS level FROM q1),
cats AS (SELECT *, list_filter([CASE WHEN headings = 0 THEN 'weak_heading_structure' END, CASE WHEN short_line_ratio >= 0.35 OR replacement_chars > 0 OR (short_line_ratio > 0.45 AND nonempty_lines > 30) THEN 'ocr_noise_or_linebreaks' END,
  CASE WHEN html_tag_lines > 0 THEN 'html_or_toc_residue' END, CASE WHEN page_number_lines > 0 THEN 'page_number_noise' END, CASE WHEN table_like_lines > 0 THEN 'table_or_layout_review' END], lambda x: x IS NOT NULL) AS found FROM q),
queue AS (SELECT *, CASE WHEN len(found) = 0 THEN ['manual_review_unknown'] ELSE found END AS categories,
  CASE WHEN list_contains(found, 'weak_heading_structure') THEN 'structure_repair' WHEN list_contains(found, 'ocr_noise_or_linebreaks') THEN 'ocr_cleanup' WHEN list_contains(found, 'html_or_toc_residue') THEN 'markdown_cleanup'
  WHEN list_contains(found, 'table_or_layout_review') THEN 'table_layout_review' ELSE 'manual_review' END AS focus FROM cats WHERE level IN ('review', 'poor', 'failed'))
"""
)
_COUNTERS = ["nonempty_lines", "headings", "page_headings", "page_number_lines", "footnote_like_lines", "html_tag_lines", "table_like_lines", "replacement_chars", "repeated_noise_lines"]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.scored(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return rows.drop("text").withColumns({c: F.col(c).cast("long") for c in [*_COUNTERS, "score"]})


@query(COUNTERS + "SELECT doc_id, characters, " + ", ".join(_COUNTERS) + ", short_line_ratio, score::BIGINT AS score, level FROM q")
def md_quality_score(spark, folder):
    return _scored(spark, folder).select("doc_id", "characters", *_COUNTERS, "short_line_ratio", "score", "level")


@query(COUNTERS + "SELECT level, count(*) AS documents, avg(score) AS mean_score, max(score)::BIGINT AS best, min(score)::BIGINT AS worst FROM q GROUP BY level")
def md_quality_level_counts(spark, folder):
    return _scored(spark, folder).groupBy("level").agg(F.count("*").alias("documents"), F.avg("score").alias("mean_score"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query(
    COUNTERS
    + """SELECT risk, count(*) AS documents FROM (SELECT unnest(CASE WHEN characters = 0 OR nonempty_lines = 0 THEN ['empty_document'] ELSE list_filter([
  CASE WHEN characters >= 500 AND headings = 0 THEN 'heading_hierarchy_missing' END, CASE WHEN page_number_lines / greatest(nonempty_lines, 1) > 0.08 OR repeated_noise_lines >= 4 THEN 'page_number_noise' END,
  CASE WHEN table_like_lines > 0 THEN 'table_structure_risk' END], lambda x: x IS NOT NULL) END) AS risk FROM q) GROUP BY risk"""
)
def md_quality_risks(spark, folder):
    return quality.risks(_scored(spark, folder)).select(F.explode("risks").alias("risk")).groupBy("risk").agg(F.count("*").alias("documents"))


@query(COUNTERS + "SELECT doc_id, score::BIGINT AS score, level, array_to_string(categories, ',') AS categories, focus FROM queue")
def quality_queue(spark, folder):
    rows = quality.queue(_scored(spark, folder))
    return rows.select("doc_id", "score", "level", F.array_join("categories", ",").alias("categories"), "focus")


@query(COUNTERS + "SELECT category, count(*) AS documents FROM (SELECT unnest(categories) AS category FROM queue) GROUP BY category")
def quality_queue_categories(spark, folder):
    return quality.queue(_scored(spark, folder)).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("documents"))


@query(COUNTERS + "SELECT focus, level, count(*) AS documents FROM queue GROUP BY ROLLUP (focus, level)")
def issue_focus_counts(spark, folder):
    return quality.queue(_scored(spark, folder)).rollup("focus", "level").agg(F.count("*").alias("documents"))


_ENTRIES = """, entries AS (SELECT q.doc_id, q.score, q.level, CASE WHEN q.characters = 0 THEN 'failed' ELSE 'ok' END AS status, q.short_line_ratio >= 0.9 AS scanned_likely,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted' WHEN l.toxic = 1 THEN 'review' WHEN l.doc_id IS NOT NULL THEN 'pending' END AS human_status, l.quality::DOUBLE AS human_score
  FROM q LEFT JOIN (SELECT doc_id, arg_max(quality, quality * 2 + toxic) AS quality, arg_max(toxic, quality * 2 + toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = q.doc_id),
listed AS (SELECT *, coalesce(human_status, '') <> 'accepted' AND (status = 'failed' OR level IN ('review', 'poor') OR scanned_likely) AS listed FROM entries),
decided AS (SELECT *, CASE WHEN human_status = 'accepted' THEN 'accept_manual' WHEN human_status = 'review' THEN 'manual_review' WHEN status = 'failed' THEN 'failed_retry' WHEN level = 'poor' THEN 'rerun_or_manual_review'
  WHEN listed AND scanned_likely THEN 'manual_review' WHEN listed THEN 'review_before_accept' ELSE 'accept' END AS decision FROM listed)
"""


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder)
    rows = rows.select("doc_id", "score", "level", F.when(F.col("characters") == 0, "failed").otherwise("ok").alias("status"), (F.col("short_line_ratio") >= 0.9).alias("scanned_likely"))
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("toxic") == 1, "review").otherwise("pending")
    manual = table(spark, folder, "labels").select("doc_id", status.alias("human_status"), F.col("quality").cast("double").alias("human_score"), (F.col("quality") * 2 + F.col("toxic")).alias("ordinal"))
    return review.merge_manual(rows, manual, "doc_id", "ordinal")


@query(COUNTERS + _ENTRIES + "SELECT doc_id, score::BIGINT AS score, level, status, human_status, human_score FROM entries")
def review_merge(spark, folder):
    return _entries(spark, folder).select("doc_id", "score", "level", "status", "human_status", "human_score")


@query(COUNTERS + _ENTRIES + "SELECT doc_id, score::BIGINT AS score, level, status FROM listed WHERE listed")
def review_checklist(spark, folder):
    return review.on_checklist(_entries(spark, folder)).select("doc_id", "score", "level", "status")


def _decided(spark, folder):
    rows = _entries(spark, folder)
    listed = review.on_checklist(rows.withColumn("listed", F.lit(True)))
    # the flag is the checklist's own rule, so no second pass over the documents is joined
    due = (F.col("status") == "failed") | F.col("level").isin("review", "poor") | F.col("scanned_likely")
    rows = rows.withColumn("listed", (F.coalesce("human_status", F.lit("")) != "accepted") & due)
    assert set(listed.columns) == set(rows.columns)
    return review.disposition(rows)


@query(COUNTERS + _ENTRIES + "SELECT doc_id, decision, list_position(['failed_retry','rerun_or_manual_review','manual_review','review_before_accept','accept_manual','accept'], decision) - 1 AS decision_rank FROM decided")
def review_decisions(spark, folder):
    return _decided(spark, folder).select("doc_id", "decision", F.col("decision_rank").cast("int"))


@query(COUNTERS + _ENTRIES + "SELECT decision, level, count(*) AS documents FROM decided GROUP BY ALL")
def review_decision_counts(spark, folder):
    return _decided(spark, folder).groupBy("decision", "level").agg(F.count("*").alias("documents"))


@query(COUNTERS + _ENTRIES + "SELECT human_status, level, count(*) AS documents FROM entries GROUP BY ALL")
def review_agreement(spark, folder):
    return _entries(spark, folder).groupBy("human_status", "level").agg(F.count("*").alias("documents"))
