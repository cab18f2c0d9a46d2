"""Queries of the layout operators, on pages of blocks derived from lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ratio
from ..operators import layout as y
from ..operators.summaries import rendered
from . import derived
from .derived import BLOCKS_SQL, LINES_SQL
from .registry import query, table

_PAGE_SQL = BLOCKS_SQL + ", pages_of AS (SELECT page, list({'block': block, 'text': text, 'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2, 'kind': kind} ORDER BY block) AS blocks FROM blocks GROUP BY page) "


def _pages(spark, folder):
    """page, blocks: the lines of a document as the blocks of a page."""
    each = F.expr("transform(split(coalesce(text, ''), '\n'), (raw, pos) -> named_struct('raw', raw, 'pos', pos))")
    rows = table(spark, folder, "documents").select("doc_id", each.alias("items"))
    cols = derived._columns(derived.BLOCKS)
    fields = []
    for c in cols:
        body, name = c.rsplit(" AS ", 1)
        if name.strip() not in ("page", "score"):
            fields.append(f"'{name.strip()}', {body.replace('pos', 'i.pos').replace('(raw', '(i.raw')}")
    return rows.selectExpr("doc_id AS page", f"transform(items, i -> named_struct({', '.join(fields)})) AS blocks")


@query(
    _PAGE_SQL
    + """, halves AS (SELECT page, blocks, list_filter(blocks, lambda b: (b.x1 + b.x2) / 2 < 270.0) AS l, list_filter(blocks, lambda b: (b.x1 + b.x2) / 2 > 330.0) AS r FROM pages_of),
words AS (SELECT page, len(list_filter(blocks, lambda b: (b.x1 + b.x2) / 2 < 252.0)) AS l, len(list_filter(blocks, lambda b: (b.x1 + b.x2) / 2 > 348.0)) AS r, len(blocks) AS n FROM pages_of),
images AS (SELECT page, sum((x2 - x1) * (y2 - y1)) FILTER (kind = 'image') AS a FROM blocks GROUP BY page)
SELECT h.page, len(blocks) >= 8 AND len(h.l) >= 3 AND len(h.r) >= 3 AND list_min(list_transform(h.r, lambda b: b.x1)) - list_max(list_transform(h.l, lambda b: b.x2)) > 24.0 AS two_columns,
 w.n >= 40 AND w.l >= 12 AND w.r >= 12 AND w.n - w.l - w.r <= greatest(10, floor((w.l + w.r) * 0.25)) AS word_columns, (h.page % 900 + 600) / 800.0 BETWEEN 1.28 AND 1.9 AS slide,
 round(least(coalesce(a, 0) / 480000.0, 1.0), 3) AS image_share, list_filter(list_transform(list_filter(blocks, lambda b: b.y1 <= 64.0 OR b.y2 >= 736.0), lambda b: left(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), 120)), lambda t: t <> '') AS edges
 FROM halves h JOIN words w USING (page) LEFT JOIN images i USING (page)"""
)
def page_layout(spark, folder):
    """Columns, slide shape, image share and edge texts of pages."""
    b, w, h = F.col("blocks"), F.lit(600.0), F.lit(800.0)
    return _pages(spark, folder).select(
        "page",
        y.two_columns(b, w).alias("two_columns"),
        y.word_columns(b, w).alias("word_columns"),
        y.slide_aspect((F.col("page") % 900 + 600).cast("double"), h).alias("slide"),
        y.image_share(F.filter(b, lambda x: x["kind"] == "image"), w, h).alias("image_share"),
        y.edge_texts(b, h).alias("edges"),
    )


@query(
    BLOCKS_SQL
    + """, edges AS (SELECT page % 40 AS book, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 5) AS text FROM blocks WHERE y1 <= 64.0 OR y2 >= 736.0),
counts AS (SELECT book, text, count(*) AS count FROM edges WHERE text <> '' GROUP BY ALL HAVING count(*) >= 2 AND length(text) >= 2)
SELECT book, text, count FROM counts QUALIFY row_number() OVER (PARTITION BY book ORDER BY count DESC, text COLLATE BINARY) <= 10""".replace(" COLLATE BINARY", "")
)
def repeated_edges(spark, folder):
    """The commonest texts at the edges of a book's pages."""
    edges = _pages(spark, folder).select((F.col("page") % 40).alias("book"), F.transform(y.edge_texts(F.col("blocks"), F.lit(800.0)), lambda t: F.substring(t, 1, 5)).alias("texts"))
    edges = edges.select("book", F.filter("texts", lambda t: t != "").alias("texts"))
    return y.repeated_edges(edges, "book", "texts")


_COUNT = "len(list_filter(blocks, lambda b: b.kind = '{}'))"


@query(
    _PAGE_SQL
    + rf""", stats AS (SELECT page, blocks, array_to_string(list_transform(blocks, lambda b: b.text), chr(10)) AS text, list_sum(list_transform(list_filter(blocks, lambda b: b.kind IN ('image', 'table')), lambda b: (b.x2 - b.x1) * (b.y2 - b.y1))) AS visual,
 {_COUNT.format("table")} AS t, {_COUNT.format("title")} AS ti, {_COUNT.format("header")} + {_COUNT.format("page_number")} AS fu, {_COUNT.format("footnote")} AS fo FROM pages_of),
more AS (SELECT *, coalesce(visual, 0) / 480000.0 AS share, length(regexp_replace(text, '\s+', '', 'g')) AS chars, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS ls FROM stats),
tests AS (SELECT *, page % 5 <= 2 AND share > 0.25 AS cover, len(ls) >= 5 AND len(list_filter(ls, lambda x: regexp_matches(x, '(\.{{2,}}|\s{{2,}}|第.+[章节篇部]).{{0,60}}\d{{1,4}}$'))) >= 3 AS toc, len(ls) >= 8 AND len(list_filter(ls, lambda x: length(x) <= 12)) / greatest(len(ls), 1)::DOUBLE > 0.55 AS short,
 chars >= 40 AND len(regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '[□�|]|[A-Za-z]{{1,2}}[^\w\s][A-Za-z]{{1,2}}')) / greatest(chars, 1)::DOUBLE > 0.03 AS odd FROM more)
SELECT page, chars AS text_chars, (CASE WHEN cover THEN 4 ELSE 0 END + CASE WHEN toc THEN 5 ELSE 0 END + CASE WHEN share > 0.45 THEN 4 ELSE 0 END + CASE WHEN t >= 1 THEN 4 ELSE 0 END + CASE WHEN ti >= 5 THEN 3 ELSE 0 END + CASE WHEN chars < 80 AND share > 0.15 THEN 3 ELSE 0 END
 + CASE WHEN fu >= 2 THEN 2 ELSE 0 END + least(3, fo) + CASE WHEN short THEN 2 ELSE 0 END + CASE WHEN odd THEN 2 ELSE 0 END)::INT AS score,
 list_filter([CASE WHEN cover THEN 'cover-like' END, CASE WHEN toc THEN 'toc/index' END, CASE WHEN share > 0.45 THEN 'visual-heavy' END, CASE WHEN t >= 1 THEN 'table' END, CASE WHEN ti >= 5 THEN 'many-titles' END, CASE WHEN chars < 80 AND share > 0.15 THEN 'low-text-with-visual' END,
  CASE WHEN fu >= 2 THEN 'page-furniture' END, CASE WHEN fo > 0 THEN 'footnotes' END, CASE WHEN short THEN 'many-short-lines' END, CASE WHEN odd THEN 'ocr-noise' END], lambda x: x IS NOT NULL) AS reasons FROM tests"""
)
def page_difficulty(spark, folder):
    """Score and reasons of pages that are hard to read."""
    rows = _pages(spark, folder).filter("page >= 0")
    found = y.difficulty(F.col("blocks"), F.col("page") % 5, F.lit(600.0), F.lit(800.0))
    return rows.select("page", found.alias("d")).select("page", "d.text_chars", "d.score", "d.reasons")


@query(
    BLOCKS_SQL
    + """SELECT page, array_to_string(list_sort(list(concat(kind, '=', n))), ', ') AS kinds, max(area)::DOUBLE AS largest FROM (SELECT page, kind, count(*) AS n, max((x2 - x1) * (y2 - y1)) AS area FROM blocks GROUP BY ALL) GROUP BY page"""
)
def block_kinds(spark, folder):
    """Blocks by kind and the largest block of each page."""
    rows = _pages(spark, folder)
    return rows.select("page", rendered(y.kind_counts(F.col("blocks"))).alias("kinds"), F.array_max(F.transform("blocks", y.area)).alias("largest"))


@query(
    BLOCKS_SQL
    + """SELECT page, coalesce(median(h) FILTER (h > 0), 10.0) AS median_height FROM (SELECT page, CASE WHEN block % 3 = 0 THEN 0.0 ELSE length(text) / 2.0 END AS h FROM blocks) GROUP BY page"""
)
def font_medians(spark, folder):
    """Median of the positive heights on a page."""
    heights = F.transform("blocks", lambda b: F.when(b["block"] % 3 == 0, 0.0).otherwise(F.length(b["text"]) / 2.0))
    return _pages(spark, folder).select("page", y.positive_median(heights).alias("median_height"))


@query(
    LINES_SQL
    + """, sized AS (SELECT doc_id % 60 AS book, doc_id AS page, length(text) AS text_chars, len(string_split(text, chr(10))) AS line_count, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|'))) AS table_count, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '!['))) AS image_count,
 doc_id % 7 = 0 AS two_column, CASE WHEN doc_id % 60 < 20 THEN 1 ELSE 0 END AS repeated FROM marked),
sums AS (SELECT book, count(*) AS page_count, sum(text_chars)::BIGINT AS text_chars, sum(line_count)::BIGINT AS line_count, sum(table_count)::BIGINT AS table_count, sum(image_count)::BIGINT AS image_count, coalesce(list(page ORDER BY page) FILTER (table_count > 0), []) AS table_pages, coalesce(list(page ORDER BY page) FILTER (two_column), []) AS two_column_pages,
 coalesce(list(page ORDER BY page) FILTER (image_count >= 1 AND text_chars < 200), []) AS image_heavy_pages, max(repeated) AS repeated_noise FROM sized GROUP BY book)
SELECT *, round(text_chars / page_count, 2) AS avg_chars, text_chars > 0 AS text_layer_present, round(text_chars / page_count, 2) < 80 AS low_text_density, len(two_column_pages) > 0 OR len(image_heavy_pages) > 0 OR repeated_noise > 0 AS layout_heavy_suspected, len(table_pages) > 0 AS table_heavy_suspected,
 len(table_pages) > 0 OR len(two_column_pages) > 0 OR len(image_heavy_pages) > 0 OR repeated_noise > 0 AS review_needed,
 list_filter([CASE WHEN len(table_pages) > 0 THEN 'table pages: ' || array_to_string(table_pages[:30], ', ') END, CASE WHEN len(two_column_pages) > 0 THEN 'two-column pages: ' || array_to_string(two_column_pages[:30], ', ') END,
  CASE WHEN len(image_heavy_pages) > 0 THEN 'image-heavy pages: ' || array_to_string(image_heavy_pages[:30], ', ') END, CASE WHEN repeated_noise > 0 THEN 'repeated header or footer' END], lambda x: x IS NOT NULL) AS review_reasons FROM sums"""
)
def layout_evidence(spark, folder):
    """Sums, flags and reasons for a review of books of pages."""
    each = F.split("text", "\n")
    begin = lambda mark: F.size(F.filter(each, lambda x: x.startswith(mark)))
    rows = derived.marked_documents(spark, folder).select(
        (F.col("doc_id") % 60).alias("book"),
        F.col("doc_id").alias("page"),
        F.length("text").alias("text_chars"),
        F.size(each).alias("line_count"),
        begin("|").alias("table_count"),
        begin("![").alias("image_count"),
        (F.col("doc_id") % 7 == 0).alias("two_column"),
        F.when(F.col("doc_id") % 60 < 20, 1).otherwise(0).alias("repeated"),
    )
    return y.layout_evidence(rows, "book")


@query(
    LINES_SQL
    + r""", listed AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '<!--')) AS ls FROM marked),
why AS (SELECT doc_id % 50 AS book, doc_id AS page, list_filter([CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) < 150 THEN 'low_ocr_text' END,
 CASE WHEN len(ls) >= 6 AND len(list_filter(ls, lambda x: length(trim(regexp_replace(x, '^\s*(?:#{1,6}|[-*+]\s+|\d+[.)]\s+)', ''))) <= 36)) / len(ls)::DOUBLE >= 0.7 THEN 'fragmented_short_blocks' END,
 CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 THEN 'table_or_grid_candidate' END], lambda x: x IS NOT NULL) AS reasons FROM listed)
SELECT book, page, reasons FROM why WHERE len(reasons) > 0 QUALIFY row_number() OVER (PARTITION BY book ORDER BY page) <= 5"""
)
def vlm_pages(spark, folder):
    """The first five pages of each book that a vision model should see."""
    rows = derived.marked_documents(spark, folder).select((F.col("doc_id") % 50).alias("book"), F.col("doc_id").alias("page"), "text")
    return y.vlm_candidates(rows, "book", "page", "text", 5, 150)


@query(
    """SELECT source, round(count(*) FILTER (doc_id % 2 = 0 AND n_chars >= 80) / greatest(count(*) FILTER (doc_id % 2 = 0), 1)::DOUBLE, 3) AS before_ratio, round(avg(n_chars) FILTER (doc_id % 2 = 0), 1) AS before_avg, coalesce(sum(n_chars) FILTER (doc_id % 2 = 0), 0)::BIGINT AS before_chars,
 round(count(*) FILTER (doc_id % 2 = 1 AND n_chars >= 80) / greatest(count(*) FILTER (doc_id % 2 = 1), 1)::DOUBLE, 3) AS after_ratio, round(avg(n_chars) FILTER (doc_id % 2 = 1), 1) AS after_avg, coalesce(sum(n_chars) FILTER (doc_id % 2 = 1), 0)::BIGINT AS after_chars,
 round(after_ratio - before_ratio, 3) AS ratio_delta, round(after_avg - before_avg, 1) AS avg_delta, greatest(after_chars - before_chars, 0) AS characters_added FROM documents GROUP BY source"""
)
def text_layer_change(spark, folder):
    """What a text layer added to the sampled pages of each source."""
    rows = table(spark, folder, "documents").select("source", "n_chars", F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after").alias("stage"))
    return y.text_layer_change(rows, "source", "stage", "n_chars")


@query(
    """WITH counts AS (SELECT event_id, (event_id % 90)::INT AS n FROM events),
walked AS (SELECT event_id, n, CASE WHEN n <= 8 THEN range(0, n) ELSE list_sort(list_distinct(list_concat([0, 1, n - 1], range(2, n - 1, greatest(1, n // 5))[:5]))) END AS sampled,
 list_distinct([1, 2, n, greatest(1, n // 4), greatest(1, n // 2), greatest(1, n * 3 // 4)]) AS marks FROM counts),
strides AS (SELECT *, greatest(1, n // greatest(8 - len(marks), 1))::INT AS st FROM walked)
SELECT event_id, sampled::INT[] AS sampled, CASE WHEN n <= 8 THEN range(1, n + 1)::INT[] ELSE list_sort(list_concat(marks, list_filter(range(st, n, st), lambda i: NOT list_contains(marks, i))[:(8 - len(marks))]))[:8]::INT[] END AS representative FROM strides"""
)
def page_samples(spark, folder):
    """Pages to sample of documents of up to ninety pages."""
    n = (F.col("event_id") % 90).cast("int")
    return table(spark, folder, "events").select("event_id", y.sampled_pages(n, 8).alias("sampled"), y.representative_pages(n).alias("representative"))


@query(
    _PAGE_SQL
    + r""", texts AS (SELECT p.page, m.text, blocks FROM pages_of p JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT doc_id, pos, """
    + derived.MARKED
    + r""" AS line FROM raws) GROUP BY doc_id) m ON m.doc_id = p.page),
flags AS (SELECT page % 70 AS book, length(trim(text)) AS chars, len(blocks) AS n_blocks, contains(lower(text), '目录') OR contains(lower(text), 'contents') OR len(regexp_extract_all(text, '\.{3,}\s*\d{1,4}')) >= 3 OR len(regexp_extract_all(lower(text), '(?m)^\s*(?:第.+章|chapter\s+\d+|[一二三四五六七八九十]+[、.])')) >= 5 AS toc,
 len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\s{2,}')) >= 3)) >= 4 OR len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\d+(?:[.,]\d+)?')) >= 4)) >= 4 AS tab,
 round(least(coalesce(list_sum(list_transform(list_filter(blocks, lambda b: b.kind = 'image'), lambda b: (b.x2 - b.x1) * (b.y2 - b.y1))), 0) / 480000.0, 1.0), 3) AS share FROM texts)
SELECT book, count(*) AS page_count, round(count(*) FILTER (chars >= 80) / count(*)::DOUBLE, 3) AS text_page_ratio, round(avg(chars), 1) AS avg_text_chars, count(*) FILTER (toc) AS toc_like_pages, count(*) FILTER (tab) AS table_like_pages, round(avg(share), 3) AS avg_image_area_ratio FROM flags GROUP BY book"""
)
def preflight_pages(spark, folder):
    """Preflight of books from their pages' texts and blocks."""
    texts = derived.marked_documents(spark, folder).withColumnRenamed("doc_id", "page")
    rows = _pages(spark, folder).join(texts, "page").withColumns({"images": F.filter("blocks", lambda b: b["kind"] == "image"), "width": F.lit(600.0), "height": F.lit(800.0)})
    rows = y.preflight_pages(rows).withColumn("book", F.col("page") % 70)
    n = F.count("*")
    return rows.groupBy("book").agg(
        n.alias("page_count"),
        ratio(F.count_if(F.col("chars") >= 80), n).alias("text_page_ratio"),
        F.round(F.avg("chars"), 1).alias("avg_text_chars"),
        F.count_if("toc_like").alias("toc_like_pages"),
        F.count_if("table_like").alias("table_like_pages"),
        F.round(F.avg("image_ratio"), 3).alias("avg_image_area_ratio"),
    )
