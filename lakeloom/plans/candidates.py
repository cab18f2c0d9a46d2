"""Queries of candidate artifacts, review matrices, first-kept sets and orders, on rows derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.files import toc_title
from ..operators import candidates as k
from . import derived
from .registry import query, table

#: An artifact of a backend on a page from an event, spelled alike for both engines.
ARTIFACTS = """event_id AS id, concat('page:', user_id) AS locator, user_id AS page, CASE event_id % 5 WHEN 0 THEN 'mineru' WHEN 1 THEN 'docling' WHEN 2 THEN '' WHEN 3 THEN 'MonkeyOCR-worker' ELSE 'umi' END AS backend,
 CASE event_id % 12 WHEN 0 THEN 'table_html' WHEN 1 THEN 'table_markdown' WHEN 2 THEN 'table_cells_json' WHEN 3 THEN 'table_overlay' WHEN 4 THEN 'table_image' WHEN 5 THEN 'formula_source' WHEN 6 THEN 'formula_crop' WHEN 7 THEN 'formula_bbox' WHEN 8 THEN 'formula_confidence' WHEN 9 THEN 'formula_markdown' ELSE 'page' END AS role,
 event_type AS type, event_id % 4 AS blocks, CASE WHEN event_id % 7 = 0 THEN user_id % 3 ELSE 0 END AS tables, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS formulas, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS latex, concat('p/', event_id % 40) AS path, value AS score"""
_SQL = f"WITH a AS (SELECT {ARTIFACTS} FROM events) "
_NONE = "lambda x: x IS NOT NULL"


def _artifacts(spark, folder):
    return table(spark, folder, "events").selectExpr(*derived._columns(ARTIFACTS))


def _list(*rules):
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules) + f"], {_NONE})"


_c = F.col


@query(_SQL + "SELECT backend, type, min(id) AS id, arg_min(path, id) AS path FROM a GROUP BY backend, type")
def first_kept(spark, folder):
    """The first artifact of each backend and type."""
    return k.first_kept(_artifacts(spark, folder).select("backend", "type", "id", "path"), ["backend", "type"], "id")


@query(_SQL + "SELECT locator, role, backend, min(id) AS id FROM a GROUP BY ALL")
def unique_records(spark, folder):
    """Artifacts that no earlier one equals."""
    return k.unique_records(_artifacts(spark, folder).select("locator", "role", "backend", "id"), "id")


@query(
    """SELECT doc_id, list_filter(list_distinct(w), lambda x: x <> '') IS NOT NULL AS known, len(list_distinct(list_filter(w, lambda x: x <> ''))) AS strings, len(w) + (CASE WHEN list_contains(w, concat('x', doc_id % 3)) OR doc_id % 5 = 0 THEN 0 ELSE 1 END) AS appended
 FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\\s', ' ', 'g'), ' '), lambda x: trim(x)) AS w FROM documents)"""
)
def unique_strings(spark, folder):
    """Different words of documents, and one word more."""
    rows = table(spark, folder, "documents").withColumn("w", F.transform(F.split(F.regexp_replace("text", r"\s", " "), " "), lambda x: F.trim(x)))
    more = F.when(_c("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("x"), _c("doc_id") % 3))
    return rows.select("doc_id", F.lit(True).alias("known"), F.size(k.unique_strings(_c("w"))).alias("strings"), F.size(k.appended(_c("w"), more)).alias("appended"))


@query(
    _SQL
    + """, f AS (SELECT page, id AS ordinal, CASE WHEN id % 9 = 0 THEN ' ' ELSE concat('x', id % 13) END AS latex, [id % 2] AS bbox FROM a), g AS (SELECT page, trim(latex) AS latex, bbox, min(ordinal) AS ordinal FROM f WHERE trim(latex) <> '' GROUP BY ALL)
SELECT page, latex, bbox[1] AS box, ordinal, row_number() OVER (PARTITION BY page ORDER BY ordinal) AS number FROM g"""
)
def unique_formulas(spark, folder):
    """Formulas of pages, each once, numbered."""
    i = _c("id")
    rows = _artifacts(spark, folder).select("page", i.alias("ordinal"), F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit("x"), i % 13)).alias("latex"), F.array(i % 2).alias("bbox"))
    return k.unique_formulas(rows, "page").select("page", "latex", _c("bbox")[0].alias("box"), "ordinal", "number")


@query(
    r"""WITH t AS (SELECT doc_id % 30 AS book, doc_id AS ordinal, trim(regexp_replace(concat('• ', upper(left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), (5 + doc_id % 3)::INT))), '\s+', ' ', 'g'), '·•-—– ') AS title FROM documents)
SELECT book, lower(replace(title, ' ', '')) AS key, min(ordinal) AS ordinal, arg_min(title, ordinal) AS title FROM t WHERE title <> '' AND length(title) <= 120 GROUP BY book, lower(replace(title, ' ', ''))"""
)
def unique_titles(spark, folder):
    """Titles of contents lists, each once."""
    cut = F.expr("left(regexp_replace(text, '[^a-zA-Z ]', ''), cast(5 + doc_id % 3 as int))")
    rows = table(spark, folder, "documents").select((_c("doc_id") % 30).alias("book"), _c("doc_id").alias("ordinal"), F.concat(F.lit("• "), F.upper(cut)).alias("raw"))
    return k.unique_titles(rows, "book", toc_title("raw"))


_TITLES = r"WITH t AS (SELECT doc_id % 40 AS book, doc_id AS ordinal, left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 6) AS title, (doc_id * 7 % 100) / 100.0 AS score FROM documents), k AS (SELECT *, lower(replace(title, ' ', '')) AS key FROM t WHERE replace(title, ' ', '') <> '')"


def _titles(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select((_c("doc_id") % 40).alias("book"), _c("doc_id").alias("ordinal"), F.left(F.regexp_replace("text", "[^a-zA-Z ]", ""), F.lit(6)).alias("title"), (_c("doc_id") * 7 % 100 / 100.0).alias("score"))


@query(_TITLES + " SELECT book, key, arg_max(title, [score, -ordinal]) AS title, max(score)::DOUBLE AS score, count(*) AS candidates FROM k GROUP BY book, key")
def heading_candidates(spark, folder):
    """The best heading candidate of each heading key."""
    return k.best_candidates(_titles(spark, folder), "book")


@query(_TITLES + ", b AS (SELECT book, key, arg_max(title, [score, -ordinal]) AS candidate, max(score)::DOUBLE AS score FROM k WHERE ordinal % 2 = 0 GROUP BY book, key) SELECT l.book, l.ordinal, b.candidate, b.score FROM k l LEFT JOIN b ON b.book = l.book AND b.key = l.key")
def candidates_of_titles(spark, folder):
    """Titles with the best candidate of their heading key."""
    rows = _titles(spark, folder).filter(F.replace("title", F.lit(" "), F.lit("")) != "")
    best = k.best_candidates(rows.filter(_c("ordinal") % 2 == 0), "book")
    return k.with_candidates(rows.select("book", "ordinal", "title"), best, "book").select("book", "ordinal", "candidate", "score")


@query(
    _TITLES
    + ", w AS (SELECT DISTINCT book, key FROM k), h AS (SELECT DISTINCT book, key FROM k WHERE ordinal % 3 > 0) SELECT w.book, count(*) AS titles, count(h.key) AS matched, round(count(h.key) / count(*)::DOUBLE, 3) AS match_ratio FROM w LEFT JOIN h ON h.book = w.book AND h.key = w.key GROUP BY w.book"
)
def contents_match(spark, folder):
    """Share of titles that are headings."""
    rows = _titles(spark, folder)
    return k.contents_match(rows, rows.filter(_c("ordinal") % 3 > 0), "book")


@query(
    _SQL
    + """SELECT id, CASE WHEN id % 3 = 0 THEN 'mineru' ELSE 'auto' END AS pipeline, 'x' AS format, CASE WHEN id % 3 = 0 THEN 'yes' END AS ocr FROM a"""
)
def rerun_arguments(spark, folder):
    """Arguments of jobs with what a previous run recommended."""
    rows = _artifacts(spark, folder)
    jobs = rows.select("id", F.create_map(F.lit("pipeline"), F.lit("auto"), F.lit("format"), F.lit("x")).alias("arguments"))
    before = rows.filter(_c("id") % 3 == 0).select("id", F.create_map(F.lit("pipeline"), F.lit("mineru"), F.lit("ocr"), F.lit("yes")).alias("recommended"))
    out = k.rerun_arguments(jobs, before, "id")
    at = lambda n: F.try_element_at("arguments", F.lit(n)).alias(n)
    return out.select("id", at("pipeline"), at("format"), at("ocr"))


@query(
    """WITH s AS (SELECT page_id AS ordinal, concat('s', page_id) AS id, concat('dir/', page_id % 50, '/File', page_id % 90, '.pdf') AS path FROM pages), q AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('s', event_id % 300) ELSE '' END AS sample_id, CASE WHEN event_id % 3 = 0 THEN concat('DIR/', event_id % 50, '/file', event_id % 90, '.pdf') ELSE concat('other/FILE', event_id % 120, '.pdf') END AS source FROM events),
f AS (SELECT q.event_id, 0 AS rank, s.id, s.ordinal FROM q JOIN s ON s.id = q.sample_id UNION ALL SELECT q.event_id, 1, s.id, s.ordinal FROM q JOIN s ON lower(s.path) = lower(q.source) UNION ALL SELECT q.event_id, 2, s.id, s.ordinal FROM q JOIN s ON lower(regexp_extract(s.path, '([^/]*)$', 1)) = lower(regexp_extract(q.source, '([^/]*)$', 1)))
SELECT q.event_id, m.match FROM q LEFT JOIN (SELECT event_id, arg_min(id, rank * 100000 + ordinal) AS match FROM f GROUP BY event_id) m ON m.event_id = q.event_id"""
)
def sample_matches(spark, folder):
    """Samples that fit queries, by id, path or name."""
    p, i = _c("page_id"), _c("event_id")
    samples = table(spark, folder, "pages").select(p.alias("ordinal"), F.concat(F.lit("s"), p).alias("id"), F.concat(F.lit("dir/"), p % 50, F.lit("/File"), p % 90, F.lit(".pdf")).alias("path"))
    source = F.when(i % 3 == 0, F.concat(F.lit("DIR/"), i % 50, F.lit("/file"), i % 90, F.lit(".pdf"))).otherwise(F.concat(F.lit("other/FILE"), i % 120, F.lit(".pdf")))
    queries = table(spark, folder, "events").select("event_id", F.when(i % 4 == 0, F.concat(F.lit("s"), i % 300)).otherwise("").alias("sample_id"), source.alias("source"))
    return k.matched_samples(queries, samples, "event_id").select("event_id", "match")


@query(
    _SQL
    + """, p(name, b) AS (VALUES ('one', 'mineru'), ('two', 'monkeyocr'), ('two', 'docling'), ('three', 'nothing')), e AS (SELECT CASE backend WHEN 'MonkeyOCR-worker' THEN 'monkeyocr' ELSE backend END AS b, path FROM a)
SELECT n.name, coalesce(list_sort(list(DISTINCT e.path) FILTER (e.path IS NOT NULL)), []) AS paths FROM p n LEFT JOIN e ON e.b = n.b GROUP BY n.name"""
)
def evidence_by_alias(spark, folder):
    """Evidence of profiles by their backends' aliases."""
    profiles = spark.createDataFrame([("one", ["mineru"]), ("two", ["monkeyocr", "Docling"]), ("three", ["nothing"])], "name string, aliases array<string>")
    return k.by_alias(profiles, _artifacts(spark, folder).select("backend", "path"), "name", "path").select("name", "paths")


@query(_SQL + "SELECT id, least(100, 85 + CASE WHEN blocks > 0 THEN 5 ELSE 0 END + CASE WHEN tables > 0 THEN 5 ELSE 0 END + CASE WHEN formulas > 0 THEN 5 ELSE 0 END + CASE WHEN latex > 0 THEN 5 ELSE 0 END)::INT AS score FROM a")
def profile_scores(spark, folder):
    """Scores of profiles with points for their evidence."""
    return k.scored_profiles(_artifacts(spark, folder).withColumn("base", F.lit(85)), ["blocks", "tables", "formulas", "latex"]).select("id", "score")


@query(_SQL + "SELECT a.id, blocks AS table_lines, coalesce(e.x, 0) AS expected_lines, CASE WHEN coalesce(e.x, 0) > 0 THEN round(least(blocks / e.x::DOUBLE, 1.0), 3) ELSE 0 END AS retention FROM a LEFT JOIN (SELECT id, id % 6 AS x FROM a WHERE id % 2 = 0) e ON e.id = a.id")
def enriched_metrics(spark, folder):
    """Metrics with their expectations."""
    rows = _artifacts(spark, folder).select("id", _c("blocks").alias("table_lines"))
    return k.enriched(rows, rows.filter(_c("id") % 2 == 0).select("id", (_c("id") % 6).alias("expected_lines")), "id")


@query(_SQL + "SELECT DISTINCT type, path FROM (SELECT type, path FROM a WHERE id % 2 = 0 UNION ALL SELECT role, path FROM a WHERE id % 2 = 1)")
def artifact_union(spark, folder):
    """Artifacts of two lists, each once."""
    rows = _artifacts(spark, folder)
    return k.artifact_union(rows.filter(_c("id") % 2 == 0), rows.filter(_c("id") % 2 == 1).select(_c("role").alias("type"), "path"))


_ITEMS = "list({'i': block, 't': text, 'c': score} ORDER BY block)"


@query(
    derived.BLOCKS_SQL
    + """, s AS (SELECT page, count(*) FILTER (block % 3 > 0) AS labels, count(*) FILTER (block % 4 > 0) AS boxes, count(*) FILTER (block % 5 = 0) AS overlays, count(*) FILTER (block % 2 = 0) AS html, count(*) FILTER (block % 3 = 0) AS markdown, count(*) FILTER (block % 5 = 1) AS cells, count(*) FILTER (block % 6 = 0) AS overlay,
 count(*) FILTER (block % 7 = 2) AS latex, CASE WHEN page % 9 = 0 THEN count(*) ELSE count(*) FILTER (block % 5 = 1) END AS source, count(*) FILTER (score > 0.6) AS confidence, sum(length(text) * 2 + CASE WHEN block % 7 = 2 THEN 2 ELSE 0 END)::BIGINT AS chars, CASE WHEN page % 5 = 0 THEN 7 ELSE count(*) END AS counted FROM blocks GROUP BY page)
SELECT page, labels, boxes, overlays, html, markdown, cells, overlay, latex, source, confidence, ((latex > 0)::INT + (markdown > 0)::INT + (boxes > 0)::INT + (source > 0)::INT + (confidence > 0)::INT) AS completeness, chars, counted FROM s"""
)
def candidate_signals(spark, folder):
    """What the blocks, tables and formulas of candidate pages bring."""
    from .layout import _pages

    when = lambda test, v="x": F.when(test, F.lit(v))
    i = lambda b: b["block"]
    score = lambda b: (i(b) * 13 + F.col("page")) % 120 / 100.0
    item = lambda b: F.struct(
        when(i(b) % 3 > 0).alias("label"), F.when(i(b) % 4 > 0, F.array(F.lit(1.0))).alias("bbox"), when(i(b) % 5 == 0).alias("overlay"), b["text"].alias("text"), b["text"].alias("markdown"), when(i(b) % 7 == 2, "xx").alias("latex"),
    )
    tab = lambda b: F.struct(when(i(b) % 2 == 0).alias("html"), when(i(b) % 3 == 0).alias("markdown"), when(i(b) % 5 == 1).alias("cells"), when(i(b) % 6 == 0).alias("overlay"), F.when(i(b) % 4 > 0, F.array(F.lit(1.0))).alias("bbox"))
    form = lambda b: F.struct(when(i(b) % 7 == 2).alias("latex"), when(i(b) % 3 == 0).alias("markdown"), F.when(i(b) % 4 > 0, F.array(F.lit(1.0))).alias("bbox"), when(i(b) % 5 == 1).alias("source"), F.when(score(b) > 0.6, score(b)).alias("confidence"))
    rows = _pages(spark, folder)
    rows = rows.select(
        "page",
        k.layout_signals(F.transform("blocks", item)).alias("l"),
        k.table_signals(F.transform("blocks", tab)).alias("t"),
        k.formula_signals(F.transform("blocks", form), F.col("page") % 9 == 0).alias("f"),
        k.text_characters(F.transform("blocks", item)).alias("chars"),
        k.listed_or_counted(F.when(F.col("page") % 5 == 0, F.slice("blocks", 1, 0)).otherwise(F.col("blocks")), F.lit(7)).alias("counted"),
    )
    return rows.select("page", "l.labels", "l.boxes", "l.overlays", "t.html", "t.markdown", "t.cells", "t.overlay", "f.latex", "f.source", "f.confidence", "f.completeness", "chars", "counted")


@query(
    _SQL
    + """, b AS (SELECT locator, backend, max(page) AS page, sum(blocks) AS blocks, sum(tables) AS tables, sum(formulas) AS formulas FROM a GROUP BY locator, backend)
SELECT b.locator, max(b.page) AS page, list_sort(list(b.backend) FILTER (b.backend <> '')) AS backends, max(t.types) AS types, sum(blocks)::BIGINT AS block_count, sum(tables)::BIGINT AS table_count, sum(formulas)::BIGINT AS formula_count,
 array_to_string(list_sort(list(concat(b.backend, '=', tables)) FILTER (b.backend <> '' AND tables > 0)), ',') AS by_backend, list_filter([CASE WHEN sum(blocks) > 0 THEN 'layout_blocks' END, CASE WHEN sum(tables) > 0 THEN 'table_candidates' END, CASE WHEN sum(formulas) > 0 THEN 'formula_candidates' END], lambda x: x IS NOT NULL) AS targets
FROM b JOIN (SELECT locator, list_sort(list(DISTINCT type)) AS types FROM a GROUP BY locator) t ON t.locator = b.locator GROUP BY b.locator"""
)
def review_pages(spark, folder):
    """Review entries of pages as one row each."""
    out = k.review_pages(_artifacts(spark, folder))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("tables_by_backend")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("locator", "page", "backends", "types", "block_count", "table_count", "formula_count", F.nullif(text, F.lit("")).alias("by_backend"), "targets")


_MATRIX = """, r AS (SELECT locator, coalesce(nullif(backend, ''), 'unknown') AS backend, max(tables) AS table_count, count(*) FILTER (starts_with(role, 'table_')) AS artifact_refs, bool_or(role = 'table_html') AS has_html, bool_or(role = 'table_markdown') AS has_markdown, bool_or(role = 'table_cells_json') AS has_cells_json, bool_or(role = 'table_overlay') AS has_overlay,
 bool_or(role = 'table_image') AS has_table_image FROM a WHERE id % 3 = 0 GROUP BY ALL), x AS (SELECT *, list_filter([CASE WHEN table_count > 0 AND NOT has_overlay THEN 'table_overlay' END, CASE WHEN table_count > 0 AND NOT has_cells_json THEN 'table_cells_json' END, CASE WHEN table_count > 0 AND NOT (has_html OR has_markdown) THEN 'table_html_or_markdown' END], lambda x: x IS NOT NULL) AS missing_evidence,
 CASE WHEN table_count > 0 THEN round(((has_html OR has_markdown)::INT + has_cells_json::INT + has_overlay::INT) / 3.0, 3) ELSE 0 END::DOUBLE AS completeness FROM r) """


def _matrix(spark, folder):
    return k.table_matrix(_artifacts(spark, folder).filter(_c("id") % 3 == 0))


@query(_SQL + _MATRIX + "SELECT *, has_html::INT + has_markdown::INT + has_cells_json::INT + has_overlay::INT AS evidence_kinds, len(missing_evidence) AS missing_count FROM x")
def table_review_matrix(spark, folder):
    """Table artifacts by page and backend."""
    return k.matrix_signals(_matrix(spark, folder))


@query(
    _SQL
    + _MATRIX
    + """, g AS (SELECT locator, count(*) AS backends, count(DISTINCT CASE WHEN table_count > 0 THEN table_count END) AS dif, bool_or(table_count > 0 AND NOT has_overlay) AS o, bool_or(table_count > 0 AND NOT has_cells_json) AS c, bool_or(table_count > 0 AND NOT (has_html OR has_markdown)) AS rd, bool_or(table_count > 0) AS card, round(max(completeness), 3) AS best_completeness, count(*) FILTER (table_count > 0 AND completeness < 1) AS incomplete FROM x GROUP BY locator),
t AS (SELECT *, list_filter([CASE WHEN backends < 2 THEN 'single_backend_only' END, CASE WHEN dif > 1 THEN 'table_count_disagreement' END, CASE WHEN o THEN 'missing_overlay_evidence' END, CASE WHEN c THEN 'missing_cells_json' END, CASE WHEN rd THEN 'missing_readable_table_output' END, CASE WHEN card THEN 'card_layout_review_required' END], lambda x: x IS NOT NULL) AS conflict_tags FROM g)
SELECT locator, backends, best_completeness, incomplete, dif <= 1 AS agrees, conflict_tags, CASE WHEN len(conflict_tags) > 0 THEN 'review_conflicts_before_promotion' ELSE 'table_evidence_ready_for_scorecard_comparison' END AS recommendation FROM t"""
)
def table_conflicts(spark, folder):
    """Whether backends agree on a page's tables."""
    return k.table_conflicts(_matrix(spark, folder))


@query(
    _SQL
    + """, r AS (SELECT locator, coalesce(nullif(backend, ''), 'unknown') AS backend, max(formulas) AS formula_count, sum(latex)::BIGINT AS latex_count, bool_or(role = 'formula_source') AS has_source_ref, bool_or(role = 'formula_crop') AS has_crop, bool_or(role = 'formula_markdown') AS has_markdown, bool_or(role = 'formula_bbox') AS has_bbox, bool_or(role = 'formula_confidence') AS has_confidence FROM a WHERE id % 2 = 0 GROUP BY ALL)
SELECT *, list_filter([CASE WHEN formula_count > 0 AND latex_count = 0 THEN 'missing_latex_or_markdown' END, CASE WHEN formula_count > 0 AND NOT has_bbox THEN 'missing_formula_bbox' END, CASE WHEN formula_count > 0 AND NOT (has_source_ref OR has_crop) THEN 'missing_formula_source_ref' END, CASE WHEN formula_count > 0 AND NOT has_confidence THEN 'missing_formula_confidence' END,
 CASE WHEN formula_count > 0 THEN 'check_formula_retention' END], lambda x: x IS NOT NULL) AS warnings FROM r"""
)
def formula_review_matrix(spark, folder):
    """Formula artifacts by page and backend."""
    return k.formula_matrix(_artifacts(spark, folder).filter(_c("id") % 2 == 0))


@query(
    _SQL
    + """, i AS (SELECT page, CASE WHEN id % 3 = 0 THEN 'grobid' WHEN id % 3 = 1 THEN 'formula' ELSE 'bundle' END AS kind, CASE WHEN id % 4 = 0 THEN 't' ELSE '' END AS title, CASE WHEN id % 8 = 0 THEN 'd' END AS doi, blocks AS rf, blocks + 1 AS f, tables AS l, formulas AS b, CASE WHEN id % 50 = 0 THEN 'failed' ELSE 'ok' END AS status FROM a)
SELECT page, count(*) FILTER (kind = 'grobid') AS grobid_sources, count(*) FILTER (kind = 'grobid' AND title <> '') AS titles, count(*) FILTER (kind = 'grobid' AND doi <> '') AS dois, coalesce(sum(rf) FILTER (kind = 'grobid'), 0)::BIGINT AS "references", count(*) FILTER (kind = 'formula') AS formula_sources, coalesce(sum(f) FILTER (kind = 'formula'), 0)::BIGINT AS formulas,
 coalesce(sum(greatest(f - b, 0)) FILTER (kind = 'formula'), 0)::BIGINT AS missing_bbox, coalesce(sum(greatest(f - l, 0)) FILTER (kind = 'formula'), 0)::BIGINT AS missing_latex, bool_or(kind = 'grobid' AND status <> 'ok') AS needs_followup FROM i GROUP BY page"""
)
def academic_evidence(spark, folder):
    """Academic evidence of pages."""
    i = _c("id")
    rows = _artifacts(spark, folder).select(
        "page", F.when(i % 3 == 0, "grobid").when(i % 3 == 1, "formula").otherwise("bundle").alias("kind"), F.when(i % 4 == 0, "t").otherwise("").alias("title"), F.when(i % 8 == 0, "d").alias("doi"),
        _c("blocks").alias("references"), (_c("blocks") + 1).alias("formulas"), _c("tables").alias("latex"), _c("formulas").alias("boxes"), F.when(i % 50 == 0, "failed").otherwise("ok").alias("status"),
    )
    return k.academic_evidence(rows, "page")


@query(_SQL + "SELECT page, count(*) AS artifacts, list_sort(list(DISTINCT backend) FILTER (backend <> '')) AS backends, list_sort(list(DISTINCT type)) AS types, sum(blocks)::BIGINT AS blocks, sum(tables)::BIGINT AS tables, sum(formulas)::BIGINT AS formulas FROM a GROUP BY page")
def review_counts(spark, folder):
    """Artifacts of bundles."""
    return k.review_counts(_artifacts(spark, folder), "page")


@query(
    _SQL
    + """, o AS (SELECT *, CASE id % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'ok' WHEN 2 THEN 'review' WHEN 3 THEN 'poor' WHEN 4 THEN 'failed' ELSE 'x' END AS lv, CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'all_terms' WHEN 2 THEN 'partial_terms' ELSE 'none' END AS q, CASE id % 5 WHEN 0 THEN 'plan_or_fix_environment_first' WHEN 1 THEN 'review_only' WHEN 2 THEN 'compare_on_shared_manifest' WHEN 3 THEN 'do_not_promote' ELSE 'unknown' END AS g FROM a)
SELECT id, row_number() OVER (PARTITION BY page ORDER BY CASE lv WHEN 'good' THEN 0 WHEN 'ok' THEN 1 WHEN 'review' THEN 2 WHEN 'poor' THEN 3 WHEN 'failed' THEN 4 ELSE 5 END, tables DESC, blocks, concat('n', 100000 + id)) AS by_row, row_number() OVER (PARTITION BY page ORDER BY CASE q WHEN 'exact' THEN 0 WHEN 'all_terms' THEN 1 WHEN 'partial_terms' THEN 2 ELSE 9 END, blocks DESC, concat('n', 100000 + id), page) AS by_match,
 row_number() OVER (PARTITION BY page ORDER BY CASE WHEN lv = 'failed' THEN 0 ELSE 1 END, coalesce(nullif(tables, 0), 999), id) AS by_summary, row_number() OVER (PARTITION BY page ORDER BY CASE g WHEN 'plan_or_fix_environment_first' THEN 0 WHEN 'review_only' THEN 1 WHEN 'compare_on_shared_manifest' THEN 2 WHEN 'do_not_promote' THEN 3 ELSE 9 END, concat('n', 100000 + id)) AS by_gate,
 row_number() OVER (PARTITION BY page ORDER BY coalesce(CASE WHEN id % 3 > 0 THEN id % 7 END, 1000000), concat('n', 100000 + id)) AS by_page, least(greatest(id % 300 - 20, 1), 200) AS lim FROM o"""
)
def review_orders(spark, folder):
    """Five orders of rows, and a limit."""
    i = _c("id")
    pick = lambda n, *names: F.get(F.array(*(F.lit(x) for x in names)), (i % n).cast("int"))
    name = F.concat(F.lit("n"), i + 100000)
    rows = _artifacts(spark, folder).withColumns(
        {"lv": pick(6, "good", "ok", "review", "poor", "failed", "x"), "q": pick(4, "exact", "all_terms", "partial_terms", "none"), "g": pick(5, "plan_or_fix_environment_first", "review_only", "compare_on_shared_manifest", "do_not_promote", "unknown")}
    )
    for order, by in (
        (k.row_order(_c("lv"), _c("tables"), _c("blocks"), name), "by_row"), (k.match_order(_c("q"), _c("blocks"), name, _c("page")), "by_match"), ([*k.summary_order(_c("lv"), _c("tables")), i.asc()], "by_summary"),
        (k.gate_order(_c("g"), name), "by_gate"), (k.page_order(F.when(i % 3 > 0, i % 7), name), "by_page"),
    ):
        rows = k.ranked(rows, ["page"], order, by)
    return rows.select("id", "by_row", "by_match", "by_summary", "by_gate", "by_page", k.limit_of(i % 300 - 20).alias("lim"))


@query(_SQL + "SELECT backend, id, path FROM a QUALIFY row_number() OVER (PARTITION BY backend ORDER BY id DESC) <= 3")
def newest_results(spark, folder):
    """The three newest results of each backend."""
    return k.newest(_artifacts(spark, folder).select("backend", "id", "path"), ["backend"], "id", 3)


@query(
    _SQL
    + """SELECT page, arg_min(path, id) FILTER (type = 'error' AND id % 2 = 0) AS path FROM a GROUP BY page HAVING count(*) FILTER (type = 'error' AND id % 2 = 0) > 0"""
)
def first_paths(spark, folder):
    """The first item of a focus that has a path."""
    rows = _artifacts(spark, folder).select("page", _c("id").alias("ordinal"), _c("type").alias("focus"), F.when(_c("id") % 2 == 0, _c("path")).alias("path"))
    return k.first_with_path(rows, "page", "error", "path")


@query(
    _SQL + """SELECT page, arg_min(path, id) FILTER (type = 'click' AND path <> 'p/0') AS first_click FROM a GROUP BY page"""
)
def first_artifacts(spark, folder):
    """The first artifact of a kind of each job."""
    rows = _artifacts(spark, folder).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "type", "path"))), lambda x: F.struct(x["type"].alias("type"), F.when(x["path"] != "p/0", x["path"]).alias("path"))).alias("l"))
    return rows.select("page", k.first_artifact(_c("l"), "click").alias("first_click"))


@query(
    derived.BLOCKS_SQL
    + """, u AS (SELECT concat('d', page % 100) AS source, page, block, text, CASE WHEN block % 3 = 0 THEN 'layout' WHEN block % 3 = 1 THEN 'table' ELSE 'formula' END AS kind, block % 4 = 0 AS nobox, score > 0.9 AS noconf FROM blocks),
n AS (SELECT source, kind, count(*) AS n, count(*) FILTER (nobox) AS b, count(*) FILTER (noconf) AS c FROM u GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS blocks, array_to_string(list_sort(list(concat(kind, '=', n))), ',') AS kinds, sum(b)::BIGINT AS missing_bbox, sum(c)::BIGINT AS missing_confidence, bool_or(kind <> 'layout') AS needs_review FROM n GROUP BY source"""
)
def intelligence_blocks(spark, folder):
    """Layout, table and formula candidates of documents as one list of blocks, summed up."""
    from .layout import _pages

    rows = _pages(spark, folder).withColumn("source", F.concat(F.lit("d"), _c("page") % 100))
    score = lambda b: (b["block"] * 13 + F.col("page")) % 120 / 100.0
    items = lambda r: F.transform(F.filter("blocks", lambda b: b["block"] % 3 == r), lambda b: F.struct(b["text"].alias("text"), F.when(b["block"] % 4 > 0, F.array(F.lit(0.0))).alias("bbox"), F.when(score(b) <= 0.9, score(b)).alias("confidence")))
    parts = [k.block_rows(rows.withColumn("items", items(r)), "items", kind) for r, kind in enumerate(("layout", "table", "formula"))]
    out = k.block_totals(parts[0].unionByName(parts[1]).unionByName(parts[2]), "source")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("kinds", text)


_NAMES = ("out/chat.md", "x/agent-handoff-bundle.md", "notes.markdown", "chat.jsonl", "a/ocr_blocks.jsonl", "location-index.jsonl", "pages.jsonl", "b/layout-evidence.json", "run-Summary.json", "my.report.json", "plain.json", "candidate-plan.json", "environment-lock-compare.json", "environment-lock.json", "t.hocr", "t.tsv", "t.log", "t.htm", "scan.PNG", "none")
_TYPES = ("chat_markdown", "agent_handoff_bundle_markdown", "markdown", "chat_jsonl", "ocr_blocks_jsonl", "location_index_jsonl", "pages_jsonl", "pdf_layout_evidence_json", "summary_json", "conversion_report", "json", "candidate_benchmark_plan_json", "environment_lock_compare_json", "environment_lock", "hocr", "tsv", "text", "html", "png", "artifact")


@query(_SQL + "SELECT id, [" + ", ".join(f"'{t}'" for t in _TYPES) + "][id % 20 + 1] AS type FROM a")
def artifact_types(spark, folder):
    """Types of artifacts by their names."""
    from ..operators.governance import artifact_type

    name = F.get(F.array(*(F.lit(x) for x in _NAMES)), (_c("id") % 20).cast("int"))
    return _artifacts(spark, folder).select("id", artifact_type(name).alias("type"))
