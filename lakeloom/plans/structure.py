"""Queries of the structure family over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headings as H
from ..operators import structure
from .quality import LINES
from .registry import query, table

_DOCUMENT_KEY = r"""CASE WHEN k = '' OR regexp_matches(t, '^(?:#|\||>|-|\*|<!--)') OR regexp_matches(k, '^第[一二三四五六七八九十百零〇\d]+[章篇部卷节条]\s*\S') OR regexp_matches(k, '^(?:（[一二三四五六七八九十百零〇]+）|\([一二三四五六七八九十百零〇]+\))\S')
 OR regexp_matches(k, '^\d{1,2}[.、]\s*\S') OR regexp_matches(k, '^(?:（\d{1,2}）|\(\d{1,2}\))\S') OR regexp_matches(k, '^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$') OR length(kk) > 32 OR regexp_matches(kk, '[。！？!?；;：:，,、]$') THEN '' ELSE lower(kk) END"""
_KK = r"""regexp_replace(regexp_replace(regexp_replace(k, '^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]+', ''), '[\-—–_·•]+第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$', ''), '^[\-—–_·•]+|[\-—–_·•]+$', '', 'g')"""
_KEYED = "WITH" + LINES + f", doc_keys AS (SELECT doc_id, pos, t, {_DOCUMENT_KEY} AS key FROM (SELECT *, {_KK} AS kk FROM lines)) "


def _lines(spark, folder):
    return structure.line_table(table(spark, folder, "documents"))


@query("WITH" + LINES + "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (t <> '') AS n_text, max(length(t)) AS longest, avg(length(t)) AS mean_length FROM lines GROUP BY doc_id")
def line_stats(spark, folder):
    return _lines(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("t") != "").alias("n_text"), F.max(F.length("t")).cast("long").alias("longest"), F.avg(F.length("t")).alias("mean_length"))


@query(_KEYED + "SELECT doc_id, key, count(*) AS times FROM doc_keys WHERE key <> '' GROUP BY ALL HAVING count(*) >= 2")
def repeated_noise_lines(spark, folder):
    rows = _lines(spark, folder).withColumn("key", H.document_key("line")).filter("key <> ''")
    return rows.groupBy("doc_id", "key").agg(F.count("*").alias("times")).filter("times >= 2")


@query("WITH" + LINES + r"SELECT doc_id, count(*) AS page_numbers FROM lines WHERE regexp_matches(k, '^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$') GROUP BY doc_id")
def page_number_lines(spark, folder):
    return _lines(spark, folder).filter(H.is_page_number("line")).groupBy("doc_id").agg(F.count("*").alias("page_numbers"))


@query(
    _KEYED
    + """, counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS same FROM doc_keys)
SELECT doc_id, count(*) AS n_removed FROM counted WHERE key <> '' AND same >= 4 AND (length(key) <= 20 OR same >= 6) GROUP BY doc_id"""
)
def repeated_header_footer(spark, folder):
    rows = structure.noise_kinds(_lines(spark, folder))
    return rows.filter("kind = 'repeated_header_footer'").groupBy("doc_id").agg(F.count("*").alias("n_removed"))


@query(
    _KEYED
    + """, b AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM doc_keys WHERE NOT (key = '' AND t = ''))
SELECT doc_id, count(*) AS twins FROM b WHERE key <> '' AND key = before GROUP BY doc_id"""
)
def consecutive_duplicate_lines(spark, folder):
    from pyspark.sql import Window

    rows = _lines(spark, folder).withColumn("key", H.document_key("line")).filter("not (key = '' and t = '')")
    before = F.lag("key").over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("before", before).filter("key <> '' and key = before").groupBy("doc_id").agg(F.count("*").alias("twins"))


@query(
    "WITH"
    + LINES
    + r""", p AS (SELECT doc_id, pos, length(t) - length(replace(t, '|', '')) AS n FROM lines), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM p WHERE n >= 2)
SELECT doc_id, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end, count(*) AS n_rows, max(n) + 1 AS n_columns FROM i GROUP BY doc_id, island"""
)
def markdown_table_islands(spark, folder):
    rows = structure.table_islands(_lines(spark, folder))
    return rows.select("doc_id", *(F.col(c).cast("long") for c in ("line_start", "line_end", "n_rows", "n_columns")))


@query(
    "WITH"
    + LINES
    + r""", b AS (SELECT *, CASE WHEN t = '' THEN 1 ELSE 0 END AS blank FROM lines), g AS (SELECT *, sum(blank) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM b)
SELECT doc_id, count(*) AS blocks, max(n) AS most_lines FROM (SELECT doc_id, block, count(*) AS n FROM g WHERE t <> '' GROUP BY ALL) GROUP BY doc_id"""
)
def line_blocks(spark, folder):
    from pyspark.sql import Window

    rows = _lines(spark, folder).withColumn("block", F.count_if(F.col("t") == "").over(Window.partitionBy("doc_id").orderBy("pos")))
    blocks = rows.filter("t <> ''").groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("n").alias("most_lines"))


_ELEMENTS = (
    "WITH"
    + LINES
    + r""", f AS (SELECT *, (t LIKE '```%')::INT AS fence FROM lines), f2 AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM f),
kinds AS (SELECT *, CASE WHEN fence = 1 OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(t, '(?i)^(<!--\s*page[:=]\s*\d{1,5}\s*-->|\[page\s+\d{1,5}\]|---\s*page\s+\d{1,5}\s*---)$') THEN 'page_break'
  WHEN regexp_matches(t, '^#{1,6}\s+\S') THEN 'title' WHEN t = '' THEN 'blank' ELSE 'text' END AS kind FROM f2),
marks AS (SELECT *, CASE WHEN (fence = 1 AND fences % 2 = 1) OR kind IN ('page_break', 'title') OR coalesce(lag(kind) OVER w <> kind, true) THEN 1 ELSE 0 END AS new FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
blocks AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM marks),
raws AS (SELECT doc_id, block, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end, first(kind) AS kind, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS raw FROM blocks WHERE kind <> 'blank' GROUP BY doc_id, block),
elements AS (SELECT doc_id, line_start, line_end, CASE WHEN kind IN ('page_break', 'title') THEN kind WHEN kind = 'code' THEN 'code_block' WHEN raw LIKE '|%' AND contains(raw, chr(10) || '|') THEN 'table'
  WHEN len(list_filter(string_split(raw, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:[-*+]|\d+[.)])\s+') AND x <> '')) = 0 THEN 'list' WHEN regexp_matches(raw, '^!\[.*?\]\(.+?\)') THEN 'image' ELSE 'narrative_text' END AS type,
  CASE WHEN kind = 'page_break' THEN 0 WHEN kind = 'title' THEN length(regexp_replace(raw, '^#+\s+', '')) ELSE length(raw) END AS chars FROM raws) """
)


@query(_ELEMENTS + "SELECT doc_id, line_start, line_end, type, chars FROM elements")
def document_elements(spark, folder):
    rows = structure.elements(table(spark, folder, "documents"))
    return rows.select("doc_id", F.col("line_start").cast("long"), F.col("line_end").cast("long"), "type", F.col("chars").cast("long"))


@query(_ELEMENTS + "SELECT doc_id, type, count(*) AS elements, sum(chars)::BIGINT AS chars FROM elements GROUP BY ALL")
def element_summary(spark, folder):
    rows = structure.elements(table(spark, folder, "documents"))
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("elements"), F.sum("chars").alias("chars"))


@query(
    _ELEMENTS.replace("WITH", "WITH RECURSIVE", 1)
    + """, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS n FROM elements WHERE type <> 'page_break'),
walk AS (SELECT doc_id, n, 1 AS chunk, greatest(chars, 1) AS size FROM e WHERE n = 1 UNION ALL SELECT e.doc_id, e.n, CASE WHEN e.type = 'title' OR walk.size + greatest(e.chars, 1) > 1800 THEN walk.chunk + 1 ELSE walk.chunk END,
  CASE WHEN e.type = 'title' OR walk.size + greatest(e.chars, 1) > 1800 THEN greatest(e.chars, 1) ELSE walk.size + greatest(e.chars, 1) END FROM walk JOIN e ON e.doc_id = walk.doc_id AND e.n = walk.n + 1)
SELECT w.doc_id, w.chunk::BIGINT AS chunk, min(line_start) AS line_start, max(line_end) AS line_end, count(*) AS blocks, sum(greatest(chars, 1))::BIGINT AS chars FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.n = w.n GROUP BY ALL"""
)
def chunk_map(spark, folder):
    rows = structure.chunks(structure.elements(table(spark, folder, "documents")))
    return rows.select("doc_id", F.col("chunk").cast("long"), F.col("first").cast("long").alias("line_start"), F.col("last").cast("long").alias("line_end"), F.col("blocks").cast("long"), F.col("chars").cast("long"))
