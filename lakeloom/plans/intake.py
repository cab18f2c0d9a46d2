"""Queries of what is known of materials: names, registries, logs, online routes, image texts, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as n
from . import derived
from .decisions import _SQL as MATERIALS_SQL
from .decisions import _materials
from .derived import RUNS_SQL
from .registry import query, table

_c = F.col
_NONE = "lambda x: x IS NOT NULL"


def _list(*rules):
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {v} END" for v, t in rules) + f"], {_NONE})"


@query(
    MATERIALS_SQL
    + """SELECT id, CASE id % 6 WHEN 0 THEN concat('Some Book ', id) WHEN 1 THEN concat('Book ', id, ' copy') WHEN 2 THEN concat('Title ', id) WHEN 3 THEN 'Name' WHEN 4 THEN concat('a, b ', id) ELSE '' END AS stem,
 CASE id % 8 WHEN 0 THEN 'pdf_text_layer' WHEN 1 THEN 'scanned_pdf' WHEN 2 THEN 'doc_office' WHEN 3 THEN 'web_archive' WHEN 4 THEN 'infographic_image' WHEN 5 THEN 'pdf_two_column' WHEN 6 THEN 'doc_office' ELSE 'image_set' END AS class FROM m"""
)
def clean_names(spark, folder):
    """Stems without marks of sites, and benchmark classes."""
    i = _c("id")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit("Some Book "), i, F.lit(" (z-library.sk, 1lib.sk)"))).when(i % 6 == 1, F.concat(F.lit("Book "), i, F.lit("  copy [z-lib.sk]"))).when(i % 6 == 2, F.concat(F.lit("_Title "), i, F.lit(" , ")))
        .when(i % 6 == 3, "Name ( )").when(i % 6 == 4, F.concat(F.lit("a , b "), i, F.lit(" - 1lib.sk"))).otherwise(" . ")
    )
    kinds = ("pdf", "pdf_scan", "ebook_epub", "web_archive", "image", "complex_pdf", "nothing known", "image_set_duplicates")
    return _materials(spark, folder).select("id", n.clean_stem(raw).alias("stem"), n.benchmark_class(F.get(F.array(*(F.lit(k) for k in kinds)), (i % 8).cast("int"))).alias("class"))


@query(
    RUNS_SQL
    + """, p(class, backends) AS (VALUES ('pdf_text_layer', ['a']), ('scanned_pdf', ['b', 'c']), ('web_archive', ['d'])), s AS (SELECT concat('s', id) AS id, category, CASE category WHEN 'pdf' THEN 'pdf_text_layer' WHEN 'scanned_pdf' THEN 'scanned_pdf' WHEN 'image' THEN 'infographic_image' WHEN 'complex_pdf' THEN 'pdf_two_column' ELSE 'doc_office' END AS class FROM runs)
SELECT s.id, s.category, s.class, p.backends FROM s LEFT JOIN p ON p.class = s.class UNION ALL SELECT NULL, NULL, class, backends FROM p WHERE class NOT IN (SELECT class FROM s)"""
)
def benchmark_plan(spark, folder):
    """Samples with the profiles of their classes."""
    profiles = spark.createDataFrame([("pdf_text_layer", ["a"]), ("scanned_pdf", ["b", "c"]), ("web_archive", ["d"])], "class string, backends array<string>")
    return n.benchmark_plan(derived.runs(spark, folder).select(F.concat(F.lit("s"), "id").alias("id"), "category"), profiles)


@query(RUNS_SQL + "SELECT id AS ordinal, concat('Key-', id) AS key FROM runs WHERE id % 3 = 0 AND id % 4 = 0 ORDER BY id LIMIT 50")
def backend_registry(spark, folder):
    """Registered backends of a class with a capability, the first fifty."""
    i = _c("id")
    rows = derived.runs(spark, folder).select(
        i.alias("ordinal"), F.concat(F.lit("Key-"), i).alias("key"), F.array(F.concat(F.lit("Key-"), i)).alias("names"), F.when(i % 3 == 0, F.array(F.lit("Scanned-PDF"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("classes"),
        F.when(i % 4 == 0, F.array(F.lit("table.worker"))).otherwise(F.array().cast("array<string>")).alias("capabilities"), F.array().cast("array<string>").alias("artifacts"),
    )
    return n.registered(rows, 50, sample_class="scanned_pdf", capability="Table Worker").select("ordinal", "key")


@query(RUNS_SQL + "SELECT id, status FROM runs WHERE job IN ('job-3', 'job-7')")
def chosen_runs(spark, folder):
    """Runs of chosen jobs."""
    return n.chosen(derived.runs(spark, folder), "job", ["job-3", "job-7"]).select("id", "status")


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('g', page_id % 3) END AS split_group, CASE WHEN page_id % 3 = 0 THEN page_id % 5 END AS split_index, CASE WHEN page_id % 3 = 0 THEN 0.99 ELSE 0.5 END::DOUBLE AS order_confidence FROM pages"""
)
def split_pages(spark, folder):
    """Pages with the long image that they were cut from."""
    i = _c("page_id")
    rows = table(spark, folder, "pages")
    manifest = rows.filter(i % 3 == 0).select(F.concat(F.lit(" Dir\\P"), i, F.lit(".PNG")).alias("path"), F.concat(F.lit("g"), i % 3).alias("split_group"), (i % 5).alias("split_index"))
    pages = rows.select("page_id", F.concat(F.lit("dir/p"), i, F.lit(".png")).alias("source"), F.lit(0.5).alias("order_confidence"))
    return n.with_split(pages, manifest).select("page_id", "split_group", "split_index", "order_confidence")


@query(
    RUNS_SQL
    + """SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 4 = 0 AND id % 8 > 0 THEN 99 ELSE score END AS score FROM runs"""
)
def overlaid_results(spark, folder):
    """Results with what their reports say."""
    i = _c("id")
    rows = derived.runs(spark, folder).select("id", "status", "score")
    return n.overlaid(rows, rows.filter(i % 4 == 0).select("id", F.lit("done").alias("status"), F.when(i % 8 > 0, 99).cast("long").alias("score")), "id", ["status", "score"])


@query(RUNS_SQL + "SELECT job AS source, max(id) AS ordinal, arg_max(level, id) AS human_status FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE job END AS job, coalesce(level, 'x') AS level FROM runs) WHERE job <> '' GROUP BY job")
def manual_records(spark, folder):
    """The last hand-made review of each source."""
    rows = derived.runs(spark, folder).select(F.when(_c("id") % 5 == 0, "").otherwise(_c("job")).alias("source"), _c("id").alias("ordinal"), F.coalesce("level", F.lit("x")).alias("human_status"))
    return n.manual_reviews(rows)


@query(
    RUNS_SQL
    + """SELECT job, id % 3 AS page, count(*) AS tables, list_sort(list(DISTINCT CASE id % 2 WHEN 0 THEN 'pdfplumber' ELSE 'camelot' END)) AS backends, list(blocks ORDER BY id % 2, id) AS rows FROM runs WHERE id < 3000 GROUP BY job, id % 3"""
)
def tables_by_page(spark, folder):
    """Table artifacts of pages in the order of their tools."""
    i = _c("id")
    rows = derived.runs(spark, folder).filter("id < 3000").select("job", (i % 3).alias("page"), F.when(i % 2 == 0, "pdfplumber").otherwise("camelot").alias("backend"), (i % 2).alias("rank"), i.alias("ordinal"), _c("blocks").alias("rows"))
    return n.tables_by_page(rows, "job")


@query(RUNS_SQL + "SELECT job, id AS ordinal, headings AS position FROM runs WHERE level = 'review' QUALIFY row_number() OVER (PARTITION BY job ORDER BY id, headings) <= 4")
def first_review_items(spark, folder):
    """The first review items of batches."""
    return n.review_items(derived.runs(spark, folder).filter("level = 'review'").select("job", _c("id").alias("ordinal"), _c("headings").alias("position")), "job", 4)


@query(
    """SELECT doc_id, concat(left(t, 40), ' ![a](x.png)', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), '<!-- embedded-image-ocr: seen ', doc_id, ' -->') ELSE '' END, ' ![](y.png)', CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(chr(10), chr(10), '<!-- embedded-image-ocr: why -->') END) AS with_texts,
 CASE WHEN doc_id % 3 = 0 THEN concat('# ', trim(left(t, 20))) ELSE concat('# ', trim(left(t, 20)), chr(10), '```') END AS remote, left(trim(left(t, 50)), 1000) AS preview FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM documents) WHERE trim(left(t, 20)) <> ''"""
)
def image_texts(spark, folder):
    """Markdown with the texts of its images, without fences, and as a block."""
    d = _c("doc_id")
    rows = table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("t")).filter(F.trim(F.left("t", F.lit(20))) != "")
    texts = F.map_from_entries(F.array_compact(F.array(F.when(d % 2 == 0, F.struct(F.lit("x.png"), F.concat(F.lit("seen "), d))), F.when(d % 7 > 0, F.struct(F.lit("y.png"), F.lit("why"))))))
    body = F.concat(F.lit("# "), F.trim(F.left("t", F.lit(20))))
    raw = F.when(d % 3 == 0, F.concat(F.lit("```Markdown \r\n"), body, F.lit("\r\n```\n"))).otherwise(F.concat(body, F.lit("\n```")))
    return rows.select(
        "doc_id",
        n.with_image_texts(F.concat(F.left("t", F.lit(40)), F.lit(" ![a](x.png) ![](y.png)")), texts).alias("with_texts"),
        n.remote_markdown(raw).alias("remote"),
        n.markdown_block(F.left("t", F.lit(50)))["text_preview"].alias("preview"),
    )


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 50 + 1 WHEN 1 THEN event_id % 50 + 1 WHEN 2 THEN event_id % 50 + 1 WHEN 3 THEN NULL WHEN 4 THEN event_id % 50 + 1 ELSE NULL END AS page, CASE WHEN event_id % 6 = 5 THEN concat('ERROR loading model ', event_id) END AS failure,
 CASE event_id % 4 WHEN 0 THEN ['surya', 'qwen-vl'] WHEN 1 THEN ['pix2text', 'surya', 'paddleocr-vl', 'mineru-vlm', 'qwen-vl'] WHEN 2 THEN ['mineru-vlm', 'pix2text'] ELSE ['paddleocr-vl'] END AS enhancers, CASE WHEN event_id % 3 = 0 THEN 'same_image_hash' WHEN event_id % 3 = 1 THEN 'same_text_hash' ELSE 'near_duplicate_text' END AS duplicates,
 CASE event_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'a.pdf' ELSE '' END AS mime, CASE event_id % 4 WHEN 0 THEN 'grobid' WHEN 1 THEN 'formula' WHEN 2 THEN 'bundle' END AS evidence, concat('own', chr(10), 'c', event_id % 3, chr(10), 't') AS text FROM events"""
)
def tool_logs(spark, folder):
    """Progress and failures in tools' lines, orders of backends, reasons, types."""
    i = _c("event_id")
    p = i % 50 + 1
    line = F.when(i % 6 == 0, F.concat(F.lit("Page "), p, F.lit(" of 60"))).when(i % 6 == 1, F.concat(p, F.lit(" / 60 done"))).when(i % 6 == 2, F.concat(F.lit("第 "), p, F.lit(" 页"))).when(i % 6 == 3, F.concat(F.lit("100/200 "), p)).when(i % 6 == 4, F.concat(F.lit("Processing the page: "), p)).otherwise(F.concat(F.lit("ERROR loading model "), i))
    order = F.when(i % 4 == 0, "surya-ocr, qwen").when(i % 4 == 1, "nothing").when(i % 4 == 2, "MinerU;p2t mineru-vlm").otherwise("paddle")
    metadata = F.when(i % 3 == 0, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("resourceName"), F.lit("x"))).when(i % 3 == 1, F.create_map(F.lit("resourceName"), F.lit("a.pdf"))).otherwise(F.create_map(F.lit("dc:format"), F.lit("")))
    span = lambda a, b: F.struct(a.cast("string").alias("content"), b.cast("string").alias("text"))
    block = F.struct(F.lit("own").alias("text"), F.array(F.struct(F.array(span(F.concat(F.lit("c"), i % 3), F.lit(None))).alias("spans")), F.struct(F.array(span(F.lit(""), F.lit("t")), span(F.lit(None), F.lit(None))).alias("spans"))).alias("lines"))
    return table(spark, folder, "events").select(
        "event_id",
        n.tool_progress(line, F.lit(60)).alias("page"),
        n.tool_failure(line).alias("failure"),
        n.enhancer_order(order).alias("enhancers"),
        n.duplicate_reason(F.when(i % 3 == 0, 1).otherwise(2), F.when(i % 3 == 1, 1).otherwise(3)).alias("duplicates"),
        n.mime_type(metadata).alias("mime"),
        n.evidence_kind(F.when(i % 4 == 0, "grobid"), F.when(i % 4 == 1, "formula-candidates-v1").when(i % 4 == 2, "layout-table-review-bundle-v1").otherwise("x")).alias("evidence"),
        n.block_text(block).alias("text"),
    )


@query(
    RUNS_SQL
    + "SELECT id, "
    + _list(("concat('quality_', level)", "level IN ('review', 'poor')"), ("'missing_headings'", "headings = 0"), ("'ocr_or_linebreak_noise'", "score >= 35"), ("'table_shape_needs_review'", "table_lines > 0"), ("'inspect_only_not_markdown_route'", "id % 9 = 0"))
    + " AS risks, "
    + _list(("'q'", "true"), ("concat('Manual review: ', level, CASE WHEN id % 3 = 0 THEN '' ELSE concat(' score=', score) END)", "level IS NOT NULL"), ("'broken'", "status = 'failed' AND id % 2 = 0"), ("concat('PDF outline/bookmarks available: ', headings)", "headings > 0"))
    + " AS reasons FROM runs"
)
def row_reasons(spark, folder):
    """Risks of baselines and reasons of review decisions."""
    i = _c("id")
    return derived.runs(spark, folder).select(
        "id",
        n.baseline_risks(F.coalesce("level", F.lit("")), _c("headings"), _c("score") / 100.0, _c("table_lines"), i % 9 == 0).alias("risks"),
        n.review_reasons(F.array(F.lit("q")), _c("level"), F.when(i % 3 > 0, _c("score")), F.coalesce("status", F.lit("")), F.when(i % 2 == 0, "broken").otherwise(""), _c("headings")).alias("reasons"),
    )


@query(
    RUNS_SQL
    + """, g AS (SELECT job, arg_max(provider, [score, headings, -round(seconds * 100), id]) FILTER (status = 'ok') AS best_pipeline, max(score) FILTER (status = 'ok') AS best_score FROM runs GROUP BY job), k AS (SELECT job, coalesce(status, 'unknown') AS k, count(*) AS n FROM runs GROUP BY ALL)
SELECT g.job, best_score, s.states FROM g JOIN (SELECT job, array_to_string(list_sort(list(concat(k, '=', n))), ', ') AS states FROM k GROUP BY job) s ON s.job = g.job"""
)
def comparison_summaries(spark, folder):
    """States and best scores of compared pipelines."""
    from ..operators.summaries import rendered

    out = n.comparison_summary(derived.runs(spark, folder).withColumnRenamed("provider", "pipeline"), "job")
    return out.select("job", "best_score", rendered(_c("states")).alias("states"))


@query(
    RUNS_SQL
    + """, f AS (SELECT job, CASE id % 4 WHEN 0 THEN 'structure_repair' WHEN 1 THEN 'ocr_cleanup' WHEN 2 THEN 'markdown_cleanup' ELSE 'x' END AS focus, id % 8 = 0 AND score % 2 = 0 AS o, id % 8 = 1 AND score % 3 = 0 AS r FROM runs WHERE id % 29 < 4),
g AS (SELECT job, bool_or(focus = 'structure_repair' AND o) AS s, bool_or(focus = 'structure_repair') AS s0, bool_or(focus = 'ocr_cleanup' AND r) AS c, bool_or(focus = 'ocr_cleanup') AS c0, bool_or(focus = 'markdown_cleanup') AS m FROM f GROUP BY job) SELECT job, """
    + _list(("'run_safe_structure_enhancement'", "s"), ("'manual:structure_repair'", "s0 AND NOT s"), ("'inspect_ocr_noise'", "c"), ("'manual:ocr_cleanup'", "c0 AND NOT c"), ("'improve_markdown_cleanup_fixture'", "m"), ("'open_quality_queue'", "true"))
    + " AS actions FROM g"
)
def queue_actions(spark, folder):
    """What to do next with quality queues."""
    i = _c("id")
    focus = F.when(i % 4 == 0, "structure_repair").when(i % 4 == 1, "ocr_cleanup").when(i % 4 == 2, "markdown_cleanup").otherwise("x")
    rows = derived.runs(spark, folder).filter(i % 29 < 4).select("job", focus.alias("focus"), F.when((i % 8 == 0) & (_c("score") % 2 == 0), "o").alias("output"), F.when((i % 8 == 1) & (_c("score") % 3 == 0), "r").otherwise("").alias("report"))
    return n.queue_actions(rows, "job")


_ROUTES = "list_concat(CASE WHEN presentation THEN ['vlm_layout', 'text_structure_llm'] ELSE []::VARCHAR[] END, CASE WHEN scanned THEN ['ocr_layout', 'vlm_layout'] ELSE []::VARCHAR[] END, CASE WHEN complex_layout THEN ['vlm_layout', 'table_repair', 'text_structure_llm'] ELSE []::VARCHAR[] END, CASE WHEN bookmarks > 0 THEN ['text_structure_llm'] ELSE []::VARCHAR[] END)"


@query(
    MATERIALS_SQL
    + f""", r AS (SELECT *, {_ROUTES} AS rr FROM m), u AS (SELECT *, list_filter(list_transform(range(1, len(rr) + 1), lambda i: CASE WHEN list_position(rr, rr[i]) = i THEN rr[i] END), lambda x: x IS NOT NULL) AS routes FROM r)
SELECT id, routes, CASE WHEN pages * 7 >= 100 THEN 'high' WHEN pages * 7 >= 20 THEN 'medium' ELSE 'low' END AS cost_risk, CASE WHEN len(routes) > 0 THEN 'high' ELSE 'none' END AS privacy_risk,
 CASE WHEN pages * images * 10000 >= 1800000 OR (pages > 0 AND images > 0 AND greatest(pages, images) / least(pages, images)::DOUBLE >= 1.8) THEN 2 ELSE 0 END AS image_routes, CASE WHEN pages * images * 10000 < 4000000 THEN 'low' ELSE 'medium' END AS image_cost, CASE WHEN suffix IN ('.docx', '.html', '.csv', '.xlsx') THEN 1 ELSE 0 END AS document_routes FROM u"""
)
def online_routes(spark, folder):
    """Online routes and risks of PDFs, images and documents."""
    rows = _materials(spark, folder).withColumns({"o": n.online_pdf(_c("pages") * 7, _c("scanned"), _c("complex_layout"), _c("presentation"), _c("bookmarks")), "g": n.online_image(_c("pages") * 100, _c("images") * 100)})
    return rows.select("id", "o.routes", "o.cost_risk", "o.privacy_risk", F.size("g.routes").alias("image_routes"), _c("g.cost_risk").alias("image_cost"), F.size(n.online_document(_c("suffix"))).alias("document_routes"))


@query(
    MATERIALS_SQL
    + """, b AS (SELECT owner, id, unnest(CASE id % 3 WHEN 0 THEN ['Pandoc', 'MarkItDown'] WHEN 1 THEN ['Docling', 'MarkItDown'] ELSE ['Calibre'] END) AS x, unnest([1, 2]) AS p FROM m), k AS (SELECT owner, x, min(id * 10 + p) AS o FROM b WHERE x IS NOT NULL GROUP BY ALL),
z AS (SELECT owner, sum(pages)::BIGINT AS bytes, count(*) AS files FROM m GROUP BY owner) SELECT k.owner, list(x ORDER BY o) AS baselines, max(z.bytes) AS bytes, max(z.files) AS files FROM k JOIN z ON z.owner = k.owner GROUP BY k.owner"""
)
def folder_summaries(spark, folder):
    """Cheap routes and sizes of folders."""
    i = _c("id")
    a = lambda *v: F.array(*(F.lit(x) for x in v))
    rows = _materials(spark, folder)
    found = n.folder_baselines(rows.select("owner", i.alias("ordinal"), F.when(i % 3 == 0, a("Pandoc", "MarkItDown")).when(i % 3 == 1, a("Docling", "MarkItDown")).otherwise(a("Calibre")).alias("baselines")), "owner")
    return found.join(n.folder_sizes(rows, "owner", "pages"), "owner")
