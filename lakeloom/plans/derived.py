"""Inputs that the driver's tables do not hold, derived from them by one expression for both engines: marked-up lines,
files, blocks on pages, runs of jobs. The expressions use only what Spark SQL and DuckDB spell alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: A line of Markdown of twenty kinds from a raw line.
MARKED = """CASE (doc_id * 3 + pos) % 20
 WHEN 0 THEN concat('# ', substr(raw, 1, 30)) WHEN 1 THEN concat('第', pos % 9 + 1, '章 ', substr(raw, 1, 12)) WHEN 2 THEN concat('| ', substr(raw, 1, 9), ' | ', pos, ' | ', length(raw), ' |')
 WHEN 3 THEN concat('- ', substr(raw, 1, 25)) WHEN 4 THEN concat('', pos % 400) WHEN 5 THEN concat(substr(raw, 1, 20), ' ...... ', pos) WHEN 6 THEN ''
 WHEN 7 THEN concat('（一）', substr(raw, 1, 14)) WHEN 8 THEN concat('<div>', substr(raw, 1, 10), '</div>') WHEN 9 THEN concat('> ', substr(raw, 1, 18)) WHEN 10 THEN concat('$x_', pos, ' = ', length(raw), ' + y$')
 WHEN 11 THEN concat('Error: ', substr(raw, 1, 20)) WHEN 12 THEN concat('![](https://example.org/', pos, '.png)') WHEN 13 THEN concat('•', substr(raw, 1, 8)) WHEN 14 THEN concat('[^', pos, ']: ', substr(raw, 1, 20))
 WHEN 15 THEN concat('1  2  3  4  ', pos) WHEN 16 THEN 'running header' WHEN 17 THEN '附录 A' WHEN 18 THEN concat('## Page ', pos) ELSE substr(raw, 1, 60) END"""
#: The path of a file of many kinds, and of one name from a title.
PATHS = """concat('in/', CASE WHEN page_id % 11 = 0 THEN '.cache/' ELSE '' END, CASE page_id % 5 WHEN 0 THEN 'ocr/' WHEN 1 THEN 'screenshot/' ELSE 'books/' END,
 CASE page_id % 7 WHEN 0 THEN 'Chinese  scan' WHEN 1 THEN 'english:lowres' WHEN 2 THEN 'info?graphic infographic' WHEN 3 THEN 'page-' WHEN 4 THEN 'a lowres' ELSE 'Some Title' END, page_id,
 CASE page_id % 17 WHEN 0 THEN '.epub' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.html' WHEN 4 THEN '.csv' WHEN 5 THEN '.tsv' WHEN 6 THEN '.mobi' WHEN 7 THEN '.azw3' WHEN 8 THEN '.txt' WHEN 9 THEN '.rtf' WHEN 10 THEN '.odt' WHEN 11 THEN '.png' WHEN 12 THEN '.fb2' WHEN 13 THEN '.xlsx' WHEN 14 THEN '.md' WHEN 15 THEN '.zip' ELSE '' END)"""
#: The run of a job from an event.
RUNS = """event_id AS id, concat('job-', user_id) AS job, CASE event_id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' WHEN 2 THEN 'timeout' WHEN 3 THEN 'skipped' WHEN 4 THEN NULL ELSE 'ok' END AS status,
 CASE user_id % 5 WHEN 0 THEN 'rapidocr' WHEN 1 THEN 'cnocr' WHEN 2 THEN 'umi' WHEN 3 THEN '' ELSE 'MonkeyOCR-worker' END AS provider, CASE event_id % 6 WHEN 0 THEN 'docling_doc' WHEN 1 THEN 'scanned_pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'pdf' WHEN 4 THEN NULL ELSE 'complex_pdf' END AS category,
 value AS seconds, (event_id * 7) % 40 AS chars, (event_id * 3) % 11 AS blocks, (event_id * 3) % 11 - event_id % 2 * ((event_id * 3) % 11 % 4) AS boxes,
 CASE event_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'review' WHEN 2 THEN 'poor' ELSE NULL END AS level, user_id % 100 AS score, event_id % 3 AS headings, event_id % 8 AS table_lines, event_id % 5 AS expected_lines, event_id % 7 AS artifacts, event_id % 3 AS failed_artifacts, event_type AS kind"""
#: Blocks on a page of 600 x 800 from lines.
BLOCKS = """doc_id AS page, pos AS block, substr(raw, 1, 30) AS text, CASE WHEN pos % 2 = 0 OR doc_id % 3 = 0 THEN 40.0 ELSE 330.0 END + pos % 3 AS x1, CASE WHEN pos % 2 = 0 OR doc_id % 3 = 0 THEN 40.0 ELSE 330.0 END + pos % 3 + 100.0 + length(raw) % 130 AS x2,
 (pos * 37 + doc_id) % 770 + 0.0 AS y1, (pos * 37 + doc_id) % 770 + 20.0 AS y2, CASE pos % 13 WHEN 0 THEN 'title' WHEN 1 THEN 'image' WHEN 2 THEN 'table' WHEN 3 THEN 'footnote' WHEN 4 THEN 'header' WHEN 5 THEN 'formula' WHEN 6 THEN 'page_number' ELSE 'text' END AS kind, (pos * 13 + doc_id) % 120 / 100.0 AS score"""

RAW_SQL = "raws AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS pos FROM documents)"
LINES_SQL = f"WITH {RAW_SQL}, lines AS (SELECT doc_id, pos, {MARKED} AS line FROM raws), marked AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY doc_id) "
BLOCKS_SQL = f"WITH {RAW_SQL}, blocks AS (SELECT {BLOCKS} FROM raws) "
FILES_SQL = f"WITH files AS (SELECT page_id, {PATHS} AS path FROM pages) "
RUNS_SQL = f"WITH runs AS (SELECT {RUNS} FROM events) "


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))


def marked_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, pos, line."""
    return raw_lines(spark, folder).selectExpr("doc_id", "pos", f"{MARKED} AS line")


def marked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text: the marked lines of each document, made in its row."""
    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda raw, pos: F.struct(raw.alias("raw"), pos.alias("pos")))
    rows = table(spark, folder, "documents").select("doc_id", each.alias("items"))
    inner = MARKED.replace("pos", "i.pos").replace("(raw", "(i.raw").replace(" raw", " i.raw")
    return rows.selectExpr("doc_id", f"array_join(transform(items, i -> {inner}), '\n') AS text")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return raw_lines(spark, folder).selectExpr(*_columns(BLOCKS))


def files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").selectExpr("page_id", f"{PATHS} AS path")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*_columns(RUNS))


def _columns(text: str) -> list[str]:
    """The expressions of a select list, cut at the commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]
