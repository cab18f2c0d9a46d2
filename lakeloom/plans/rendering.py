"""Queries of what is rendered from rows: texts, tables, summaries, reports, and checks of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rendering as r
from . import derived
from .derived import RUNS_SQL
from .registry import query, table

_c = F.col
_TURNS = "SELECT conv_id, turn, trim(text, E' \\n\\t') AS body FROM conversations"


@query(
    f"""WITH t AS ({_TURNS}), o AS (SELECT conv_id, turn, concat(repeat('#', least(greatest((turn % 7 + 1)::INT, 2), 6)), ' Title ', turn) AS h FROM t WHERE turn % 3 = 0 AND turn > 0)
SELECT t.conv_id, string_agg(concat(coalesce(o.h, concat('## Page ', t.turn)), chr(10), chr(10), t.body), chr(10) || chr(10) ORDER BY t.turn) AS text FROM t LEFT JOIN o ON o.conv_id = t.conv_id AND o.turn = t.turn WHERE t.body <> '' GROUP BY t.conv_id"""
)
def text_layers(spark, folder):
    """Pages of a text layer under their bookmarks."""
    pages = table(spark, folder, "conversations").select("conv_id", _c("turn").alias("page"), "text")
    outline = pages.filter(_c("page") % 3 == 0).select("conv_id", "page", _c("page").alias("ordinal"), (_c("page") % 7).cast("int").alias("level"), F.concat(F.lit(" Title "), "page").alias("title"))
    return r.text_layer(pages, outline, "conv_id")


@query(f"WITH t AS ({_TURNS}) SELECT conv_id, string_agg(concat('<!-- segment pages ', turn * 10 + 1, '-', turn * 10 + 10, ' -->', chr(10), chr(10), body), chr(10) || chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id")
def merged_segments(spark, folder):
    """Page-range segments as one text."""
    rows = table(spark, folder, "conversations").select("conv_id", (_c("turn") * 10).alias("first"), (_c("turn") * 10 + 10).alias("last"), "text")
    return r.merged_segments(rows, "conv_id")


@query(
    """WITH p AS (SELECT conv_id, turn, concat('<!-- source: s', turn, ' -->', CASE WHEN turn % 4 = 3 THEN concat(chr(10), '<!-- low-confidence-order: 0.30 -->') ELSE '' END, CASE WHEN turn % 5 = 2 THEN concat(chr(10), '<!-- likely-infographic: ', CASE WHEN turn % 2 = 0 THEN 'a, b' ELSE 'layout-heavy image' END, ' -->', chr(10), '![source image](s', turn, ')') ELSE '' END, chr(10), text) AS x FROM conversations)
SELECT conv_id, concat('# Book ', conv_id, chr(10), chr(10), regexp_replace(string_agg(x, chr(10) || chr(10) ORDER BY turn), '\\s+$', ''), chr(10)) AS text FROM p GROUP BY conv_id"""
)
def image_books(spark, folder):
    """Ordered pages as books."""
    t = _c("turn")
    signals = F.when(t % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, folder, "conversations").select("conv_id", t.alias("order_index"), F.concat(F.lit("s"), t).alias("source"), F.when(t % 4 == 3, 0.3).otherwise(0.9).alias("order_confidence"), (t % 5 == 2).alias("infographic"), signals.alias("signals"), "text")
    return r.book(rows, "conv_id", F.concat(F.lit("Book "), "conv_id"))


@query(
    """SELECT 'ocr_page' AS type, conv_id AS source, turn AS index, length(text) AS char_count, role AS ocr_status, left(text, 240) AS text_preview, NULL AS title, NULL::INT AS level FROM conversations UNION ALL SELECT 'structure_heading', conv_id, NULL, NULL, NULL, NULL, left(text, 10), 2 FROM conversations WHERE turn = 0"""
)
def visual_blocks(spark, folder):
    """Pages and headings as one list of blocks."""
    rows = table(spark, folder, "conversations").withColumnRenamed("conv_id", "source")
    pages = rows.select("source", _c("turn").alias("index"), "text", _c("role").alias("status"))
    return r.visual_blocks(pages, rows.filter("turn = 0").select("source", F.left("text", F.lit(10)).alias("title"), F.lit(2).alias("level")))


@query(
    RUNS_SQL
    + """SELECT job, concat('| Source | Status | Output |', chr(10), '| --- | --- | --- |', chr(10), string_agg(concat('| f', id, '.pdf | `', coalesce(status, 'unknown'), '` | ', CASE WHEN id % 2 = 0 THEN 'o' ELSE '' END, ' |'), chr(10) ORDER BY id)) AS text FROM runs GROUP BY job"""
)
def run_summaries(spark, folder):
    """Results of runs as Markdown tables."""
    rows = derived.runs(spark, folder).select("job", "id", F.concat(F.lit("in/f"), "id", F.lit(".pdf")).alias("source"), "status", F.when(_c("id") % 2 == 0, "o").alias("output"))
    return r.run_summary(rows, "job", "id")


_CELLS = """[concat('a', id), CASE WHEN id % 3 = 0 THEN 'x, "y"' ELSE 'z' END, concat('p|', id % 7)]"""


@query(
    RUNS_SQL
    + f""", c AS (SELECT job, id % 3 + 1 AS page, id % 2 + 1 AS tab, id, {_CELLS} AS cells, row_number() OVER (PARTITION BY job, id % 3, id % 2 ORDER BY id) - 1 AS n FROM runs),
l AS (SELECT *, concat('| ', array_to_string(list_transform(cells, lambda x: replace(x, '|', '\\|')), ' | '), ' |', CASE WHEN n = 0 THEN concat(chr(10), '| --- | --- | --- |') ELSE '' END) AS md, array_to_string(list_transform(cells, lambda x: CASE WHEN regexp_matches(x, '[",]') THEN concat('"', replace(x, '"', '""'), '"') ELSE x END), ',') AS line FROM c)
SELECT job, concat('pdfplumber-page-', lpad(page::VARCHAR, 4, '0'), '-table-', lpad(tab::VARCHAR, 2, '0')) AS name, string_agg(line, chr(10) ORDER BY n) AS csv, string_agg(md, chr(10) ORDER BY n) AS markdown FROM l GROUP BY job, page, tab"""
)
def table_files(spark, folder):
    """Tables as CSV and Markdown files."""
    from pyspark.sql import Window

    i = _c("id")
    rows = derived.runs(spark, folder).select("job", (i % 3 + 1).alias("page"), (i % 2 + 1).alias("table"), "id", F.array(F.concat(F.lit("a"), i), F.when(i % 3 == 0, 'x, "y"').otherwise("z"), F.concat(F.lit("p|"), i % 7)).alias("cells"))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("job", "page", "table").orderBy("id")) - 1)
    return r.table_files(rows, "job")


@query(RUNS_SQL + "SELECT id, job, CASE WHEN id % 3 = 0 THEN NULL ELSE score END AS score, CASE WHEN id % 3 = 0 THEN NULL ELSE level END AS level, seconds, id % 3 > 0 AS has_quality, concat('f_', id, '_v.report.json') AS name FROM runs")
def conversion_reports(spark, folder):
    """JSON reports, read again."""
    rows = derived.runs(spark, folder).withColumns({"score": F.when(_c("id") % 3 > 0, _c("score")), "level": F.when(_c("id") % 3 > 0, _c("level"))})
    rows = rows.select("id", r.report(rows, {"result": ["job", "seconds"], "quality": ["score", "level"]}).alias("j"), r.report_name(F.concat(F.lit("out/f "), "id", F.lit("(v.md"))).alias("name"))
    got = F.from_json("j", "result struct<job: string, seconds: double>, quality struct<score: long, level: string>")
    rows = rows.withColumn("g", got)
    return rows.select("id", "g.result.job", "g.quality.score", "g.quality.level", "g.result.seconds", _c("g.quality").isNotNull().alias("has_quality"), "name")


@query(
    """WITH ls AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln, turn FROM conversations), n AS (SELECT conv_id, turn * 1000 + ln - 1 AS pos, CASE WHEN ln % 3 = 1 THEN concat('![x](img', (turn + ln) % 5, '.png) and ![](b', ln % 4, '.png "t")') ELSE line END AS line FROM ls),
r AS (SELECT conv_id, pos, unnest(list_concat(regexp_extract_all(line, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1), [])) AS src FROM n), f AS (SELECT conv_id, src, min(pos) + 1 AS ln FROM r GROUP BY ALL), a AS (SELECT DISTINCT conv_id, i AS ordinal, concat('img', i, '.png') AS m, concat('b', i, '.png') AS b FROM conversations, range(0, 7) t(i))
SELECT a.conv_id, a.ordinal, coalesce(x.ln, y.ln, 0) AS markdown_line FROM a LEFT JOIN f x ON x.conv_id = a.conv_id AND x.src = a.m LEFT JOIN f y ON y.conv_id = a.conv_id AND y.src = a.b"""
)
def image_places(spark, folder):
    """Where a document's images stand in its Markdown."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    at = _c("p") + 1
    shown = F.concat(F.lit("![x](img"), (_c("turn") + at) % 5, F.lit(".png) and ![](b"), at % 4, F.lit('.png "t")'))
    lines = rows.select("conv_id", (_c("turn") * 1000 + _c("p")).alias("pos"), F.when(at % 3 == 1, shown).otherwise(_c("raw")).alias("line"))
    assets = rows.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("ordinal"))
    assets = assets.withColumns({"markdown_path": F.concat(F.lit("img"), "ordinal", F.lit(".png")), "asset_path": F.concat(F.lit("b"), "ordinal", F.lit(".png"))})
    return r.image_places(assets, lines, "conv_id").select("conv_id", "ordinal", "markdown_line")


@query(
    """SELECT page_id, 'missing' AS what, concat('f', page_id % 90) AS value FROM pages WHERE page_id % 90 % 4 > 0 UNION ALL SELECT page_id, 'large', concat(length(html)) FROM pages WHERE length(html) > 3000
 UNION ALL SELECT page_id, 'pattern', p FROM pages, (VALUES ('track('), ('<nav'), ('no such')) v(p) WHERE contains(html, p)"""
)
def file_checks(spark, folder):
    """Missing and large files, and patterns in them."""
    rows = table(spark, folder, "pages")
    refs = rows.select("page_id", F.concat(F.lit("f"), _c("page_id") % 90).alias("path"))
    files = rows.filter(_c("page_id") % 90 % 4 == 0).select(F.concat(F.lit("f"), _c("page_id") % 90).alias("path"))
    gone = r.missing_files(refs, files).select("page_id", F.lit("missing").alias("what"), _c("path").alias("value"))
    large = r.large_files(rows.select("page_id", F.length("html").alias("bytes")), 3000).select("page_id", F.lit("large").alias("what"), _c("bytes").cast("string").alias("value"))
    found = r.found_patterns(rows, ["track(", "<nav", "no such"], "page_id", "html").select("page_id", F.lit("pattern").alias("what"), _c("pattern").alias("value"))
    return gone.union(large).union(found)


@query(
    RUNS_SQL
    + """, o AS (SELECT CASE WHEN id % 3 = 0 THEN 'a.md' WHEN id % 3 = 1 THEN concat(job, '.txt') END AS output, CASE WHEN id % 2 = 0 THEN concat(job, '.json') ELSE '' END AS report, CASE WHEN id % 50 = 0 THEN concat('s', id) END AS sidecar FROM runs)
SELECT DISTINCT type, path FROM (SELECT CASE WHEN output = 'a.md' THEN 'markdown' ELSE 'text' END AS type, output AS path FROM o UNION ALL SELECT 'conversion_report', report FROM o UNION ALL SELECT 'docling_document_json', sidecar FROM o) WHERE coalesce(path, '') <> ''"""
)
def output_refs(spark, folder):
    """Files that results bring."""
    i = _c("id")
    rows = derived.runs(spark, folder).select(F.when(i % 3 == 0, "a.md").when(i % 3 == 1, F.concat("job", F.lit(".txt"))).alias("output"), F.when(i % 2 == 0, F.concat("job", F.lit(".json"))).otherwise("").alias("report"), F.when(i % 50 == 0, F.concat(F.lit("s"), i)).alias("sidecar"))
    return r.output_refs(rows)


_FONT = """SELECT doc_id % 40 AS book, doc_id AS page, pos AS ordinal, substr(raw, 1, 10 + pos * 7 % 30) AS text, CASE WHEN pos % 9 = 0 THEN 18.0 WHEN pos % 9 = 1 THEN 13.5 WHEN pos % 9 = 2 THEN 11.0 ELSE 10.0 END AS font_size, CASE WHEN pos % 4 = 2 THEN 'Arial-Bold' ELSE 'Arial' END AS font"""


@query(
    f"""WITH {derived.RAW_SQL}, l AS ({_FONT} FROM raws), s AS (SELECT book, coalesce(median(font_size) FILTER (length(text) >= 20), median(font_size)) AS body FROM l GROUP BY book),
q AS (SELECT l.*, font_size / greatest(body, 1.0) AS ratio, contains(lower(font), 'bold') AS bold FROM l JOIN s ON s.book = l.book),
f AS (SELECT *, round(least(0.92, 0.55 + (ratio - 1) * 0.7 + CASE WHEN bold THEN 0.08 ELSE 0 END), 6)::DOUBLE AS score FROM q WHERE trim(text) <> '' AND length(trim(text)) <= 80 AND NOT regexp_matches(trim(text), '^[-*>|]|^\\d{{1,4}}$|[。！？!?；;，,]$') AND (ratio >= 1.18 OR (bold AND ratio >= 1.08)))
SELECT book, page, ordinal, trim(text) AS title, CASE WHEN ratio >= 1.55 THEN 1 WHEN ratio >= 1.32 THEN 2 ELSE 3 END AS level, score FROM f QUALIFY row_number() OVER (PARTITION BY book ORDER BY score DESC, page, ordinal) <= 60"""
)
def font_headings(spark, folder):
    """Lines set larger than a book's body."""
    rows = derived.raw_lines(spark, folder).selectExpr(*derived._columns(_FONT.removeprefix("SELECT ")))
    rows = rows.withColumn("font_size", _c("font_size").cast("double"))
    return r.font_headings(rows, "book", 60)


@query(
    RUNS_SQL
    + """SELECT coalesce(nullif(provider, ''), 'unknown') AS provider, list_sort(list(DISTINCT kind)) AS stages, count(*) AS profiles, count(*) FILTER (id % 3 = 0) AS ready FROM runs WHERE id % 7 > 0 AND id % 5 <> 1 GROUP BY ALL"""
)
def provider_catalog(spark, folder):
    """Remote providers and their stages."""
    i = _c("id")
    rows = derived.runs(spark, folder).select("provider", _c("kind").alias("stage"), F.when(i % 7 == 0, False).when(i % 7 < 4, True).alias("enabled"), F.when(i % 5 == 1, "local").when(i % 5 == 2, " Remote").alias("location"), (i % 3 == 0).alias("ready"))
    return r.provider_catalog(rows)


@query(
    """SELECT event_id, event_id % 4 < 2 AS archive, strftime(make_timestamp((event_id * 7919 * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_id % 200 >= 150 THEN concat('finalize timeout after ', (event_id % 200) // 60, ':', lpad((event_id % 200 % 60)::VARCHAR, 2, '0')) WHEN event_id % 100 >= 60 THEN concat('idle timeout after 1:', lpad((event_id % 100 - 60)::VARCHAR, 2, '0'), ' without output') END AS reason FROM events"""
)
def run_details(spark, folder):
    """Archives, times and timeouts of runs."""
    i = _c("event_id")
    inputs = F.when(i % 4 == 0, F.create_map(F.lit("source_html"), F.lit("x"))).when(i % 4 == 1, F.create_map(F.lit("a"), F.lit("b"), F.lit("screenshot"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.lit("b")))
    return table(spark, folder, "events").select("event_id", r.web_archive(inputs).alias("archive"), r.time_text(i * 7919).alias("at"), r.timeout_reason(i % 200, i % 100, 150, 60).alias("reason"))
