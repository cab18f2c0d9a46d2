"""Queries of the decision tables, on materials derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as d
from . import derived
from .registry import query, table

#: A material from an event, spelled alike for both engines.
MATERIALS = """event_id AS id, event_id % 30 AS pages, event_id % 5 = 0 AS scanned, event_id % 3 = 0 AS complex_layout, event_id % 7 = 0 AS presentation, event_id % 4 AS bookmarks, event_id % 6 AS tables, event_id % 8 AS columns, event_id % 9 AS noise,
 CASE event_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'best_quality' END AS profile, CASE event_id % 10 WHEN 0 THEN '.epub' WHEN 1 THEN '.docx' WHEN 2 THEN '.mobi' WHEN 3 THEN '.html' WHEN 4 THEN '.txt' WHEN 5 THEN '.csv' WHEN 6 THEN '.pdf' WHEN 7 THEN '.rtf' WHEN 8 THEN '.xlsx' ELSE '.bin' END AS suffix,
 CASE event_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'directory' WHEN 3 THEN 'web_archive' WHEN 4 THEN 'pandoc' WHEN 5 THEN 'docling' WHEN 6 THEN 'other' ELSE 'pdf' END AS kind, event_id % 11 % 4 AS documents, event_id % 13 AS images, user_id AS owner,
 CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'missing' ELSE 'ok' END AS status, CASE event_id % 5 WHEN 1 THEN 'low_alignment' WHEN 2 THEN 'partial_alignment' ELSE 'aligned' END AS outline, CASE event_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'review' ELSE 'good' END AS level,
 CASE event_id % 4 WHEN 0 THEN 'MinerU' ELSE 'marker' END AS pipeline, CASE event_id % 7 WHEN 0 THEN 'headings' WHEN 1 THEN 'page_numbers' WHEN 2 THEN 'ocr' WHEN 3 THEN 'short_lines' WHEN 4 THEN 'html' ELSE NULL END AS reason"""
_SQL = f"WITH m AS (SELECT {MATERIALS} FROM events) "
_KEEP = "lambda x: x IS NOT NULL"


def _list(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {name} END" for name, test in rules) + f"], {_KEEP})"


def _materials(spark, folder):
    rows = table(spark, folder, "events").selectExpr(*derived._columns(MATERIALS))
    return rows.withColumn("reasons", F.array_compact(F.array("reason")))


_c = F.col


@query(
    _SQL
    + """SELECT id, CASE WHEN presentation THEN 'presentation_pdf_slide_recovery' WHEN bookmarks > 0 THEN 'bookmark_guided_structure_recovery' WHEN scanned THEN 'ocr_first_with_review' WHEN complex_layout THEN 'layout_aware_structure_recovery' ELSE 'text_layer_conversion' END AS mode,
 CASE WHEN presentation THEN 'medium' WHEN bookmarks > 0 THEN CASE WHEN scanned THEN 'medium' ELSE 'high' END WHEN scanned OR complex_layout THEN 'medium' ELSE 'high' END AS confidence,
 CASE WHEN presentation THEN ['mineru', 'docling', 'umi', 'pymupdf4llm'] WHEN bookmarks > 0 AND scanned THEN ['ocrmypdf', 'mineru', 'umi'] WHEN bookmarks > 0 THEN ['mineru', 'docling', 'pymupdf4llm'] WHEN scanned THEN ['ocrmypdf', 'umi', 'mineru'] WHEN complex_layout THEN ['mineru', 'docling', 'marker'] ELSE ['pymupdf4llm'] END AS tools,
 CASE WHEN images > 0 AND documents = 0 THEN 'image_book_recognition' WHEN documents > 0 AND images > 0 THEN 'mixed_material_routing' WHEN documents > 0 THEN 'document_conversion' ELSE 'none' END AS folder_mode,
 CASE WHEN images > 0 AND documents = 0 THEN CASE WHEN images >= 8 THEN 'medium' ELSE 'low' END WHEN documents > 0 AND images > 0 THEN 'medium' WHEN documents > 0 THEN 'high' ELSE 'low' END AS folder_confidence,
 CASE WHEN suffix IN ('.epub', '.mobi') THEN 'toc_aligned_conversion' WHEN suffix IN ('.docx', '.html', '.csv', '.xlsx') THEN 'docling_or_pandoc_structure' ELSE 'pandoc_text_structure' END AS document_mode,
 CASE WHEN presentation THEN 'presentation_pdf_slide_recovery' WHEN scanned THEN 'build_location_index_or_mineru_ocr' WHEN complex_layout THEN 'mineru' ELSE 'convert_document_marker' END AS tool FROM m"""
)
def structure_strategies(spark, folder):
    """How the structure of PDFs, folders and documents is to be found."""
    rows = _materials(spark, folder)
    rows = rows.withColumns({"s": d.pdf_strategy(_c("scanned"), _c("complex_layout"), _c("presentation"), _c("bookmarks")), "f": d.folder_strategy(_c("documents"), _c("images"))})
    return rows.select(
        "id", "s.mode", "s.confidence", "s.tools", _c("f.mode").alias("folder_mode"), _c("f.confidence").alias("folder_confidence"), d.document_strategy(_c("suffix")).alias("document_mode"),
        d.pdf_tool(_c("scanned"), _c("complex_layout"), _c("presentation"), F.lit("marker")).alias("tool"),
    )


_HEAVY = "(scanned OR complex_layout OR presentation)"
_LONG = "(pages > 0 AND images > 0 AND greatest(pages, images) / greatest(least(pages, images), 1)::DOUBLE >= 1.8)"


@query(
    _SQL
    + "SELECT id, "
    + _list(("'MonkeyOCR:document_vlm_parse'", _HEAVY), ("'dots.mocr:vlm_layout_provider'", _HEAVY), ("'DocLayout-YOLO:layout_detector_baseline'", "complex_layout OR columns > 5 OR presentation"), ("'pdf_table:table_worker'", "tables > 0"))
    + " AS pdf, "
    + _list(("'dots.mocr:image_vlm_layout_provider'", f"pages * 100 * images * 100 >= 1800000 OR {_LONG}"), ("'MonkeyOCR:image_document_vlm_parse'", f"pages * 100 * images * 100 >= 1800000 OR {_LONG}"))
    + " AS image, "
    + _list(
        ("'Pandoc:primary_fast_baseline'", "suffix IN ('.epub', '.txt')"), ("'Calibre+Pandoc:primary_normalization_baseline'", "suffix IN ('.mobi', '.rtf')"), ("'Docling:structured_document_baseline'", "suffix IN ('.docx', '.html', '.csv', '.xlsx')"),
        ("CASE WHEN suffix IN ('.docx', '.html', '.xlsx') AND id % 2 = 1 THEN 'MarkItDown:fallback_when_docling_missing' ELSE 'MarkItDown:comparison_baseline' END", "suffix IN ('.epub', '.docx', '.html', '.xlsx')"),
    )
    + " AS document_baselines, "
    + _list(("'OCRmyPDF:searchable_pdf_preprocess_baseline'", "scanned"), ("'PyMuPDF4LLM:fast_text_layer_baseline'", "true"), ("'Docling:structured_pdf_comparison'", "presentation OR bookmarks > 0 OR (NOT scanned AND complex_layout)"), ("'MarkItDown:explicit_pdf_comparison'", "true"))
    + " AS pdf_baselines FROM m"
)
def enhancement_options(spark, folder):
    """Optional backends and cheap baselines of PDFs, images and documents."""
    rows = _materials(spark, folder)
    mode = d.pdf_strategy(_c("scanned"), _c("complex_layout"), _c("presentation"), _c("bookmarks"))["mode"]
    return rows.select(
        "id",
        d.pdf_enhancements(_c("scanned"), _c("complex_layout"), _c("presentation"), F.when(_c("columns") > 5, 1).otherwise(0), _c("tables")).alias("pdf"),
        d.image_enhancements(_c("pages") * 100, _c("images") * 100).alias("image"),
        d.document_baselines(_c("suffix"), _c("id") % 2 == 0).alias("document_baselines"),
        d.pdf_baselines(_c("scanned"), mode).alias("pdf_baselines"),
    )


@query(
    _SQL
    + ", e AS (SELECT owner, documents, images, "
    + _list(("'MonkeyOCR:document_vlm_parse'", "id % 40 = 0"), ("'pdf_table:table_worker'", "id % 50 = 1"))
    + """ AS l FROM m), g AS (SELECT owner, list_sort(list_distinct(flatten(list(l)))) AS l, max(documents) * (owner % 2) AS documents, max(images) AS images FROM e GROUP BY owner)
SELECT owner, documents, images, CASE WHEN images >= 8 AND documents = 0 THEN list_concat(l, ['MonkeyOCR:image_folder_document_vlm_parse']) ELSE l END AS enhancements FROM g"""
)
def folder_enhancements(spark, folder):
    """Optional backends of folders from their sampled files."""
    rows = _materials(spark, folder)
    own = d.named(("MonkeyOCR:document_vlm_parse", _c("id") % 40 == 0), ("pdf_table:table_worker", _c("id") % 50 == 1))
    return d.folder_enhancements(rows.select("owner", own.alias("enhancements"), (_c("documents") * (_c("owner") % 2)).alias("documents"), "images"), "owner")


_FIRST = "CASE WHEN scanned THEN CASE WHEN profile = 'fast' THEN 'umi' ELSE 'mineru' END WHEN profile = 'fast' THEN 'pymupdf4llm' WHEN complex_layout OR presentation THEN 'mineru' WHEN pages BETWEEN 1 AND 12 THEN 'marker' ELSE 'mineru' END"
_PDF = _list(
    ("concat(p, ':primary')", "true"), ("'pymupdf4llm:text_baseline'", "p <> 'pymupdf4llm'"), ("'mineru:structure_candidate'", "p <> 'mineru'"), ("'umi:ocr_baseline'", "scanned AND p <> 'umi'"),
    ("'marker:short_layout_candidate'", "pages BETWEEN 1 AND 12 AND p <> 'marker'"), ("'docling:layout_table_candidate'", "presentation OR tables > 0"), ("'online_only_vlm:remote_escalation'", f"profile = 'best_quality' AND {_HEAVY}"),
)
_DOC = _list(
    ("'document_docling:primary'", "office AND profile = 'best_quality'"), ("'document_auto:primary'", "NOT (office AND profile = 'best_quality')"),
    ("'document_markitdown:structure_candidate'", "office AND profile = 'best_quality' AND suffix <> '.csv'"), ("'document_docling:structure_candidate'", "office AND profile <> 'best_quality' AND suffix <> '.csv'"),
)
_CANDIDATES = f""", firsts AS (SELECT *, {_FIRST} AS p, suffix IN ('.docx', '.html', '.csv', '.xlsx') AS office FROM m),
listed AS (SELECT *, CASE WHEN kind = 'pdf' THEN {_PDF} WHEN kind = 'image' OR (kind = 'directory' AND images > 0 AND documents = 0) THEN {_list(("CASE WHEN profile = 'fast' THEN 'image_book_rapidocr:primary' ELSE 'image_book_auto:primary' END", "true"), ("'image_book_umi:ocr_candidate'", "true"), ("'image_online_vlm:remote_escalation'", "profile = 'best_quality'"))}
 WHEN kind = 'directory' THEN ['mixed_material_router:primary'] WHEN kind = 'web_archive' THEN ['web_archive_visual_check:primary'] WHEN kind IN ('pandoc', 'docling') THEN {_DOC} ELSE []::VARCHAR[] END AS candidates FROM firsts) """


def _candidates(spark, folder):
    rows = _materials(spark, folder)
    pdf = d.pdf_candidates(_c("profile"), _c("pages"), _c("scanned"), _c("complex_layout"), _c("presentation"), _c("tables"))
    return rows.withColumn("candidates", d.candidates(_c("kind"), _c("profile"), _c("suffix"), pdf, _c("documents"), _c("images")))


@query(
    _SQL
    + _CANDIDATES
    + ", twice AS (SELECT *, list_concat(candidates, candidates) AS cc FROM listed) SELECT id, candidates, candidates AS deduplicated, "
    + "CASE profile WHEN 'fast' THEN 0.55 WHEN 'best_quality' THEN 0.88 ELSE 0.72 END::DOUBLE AS quality, CASE profile WHEN 'fast' THEN 0.35 WHEN 'best_quality' THEN 0.07 ELSE 0.20 END::DOUBLE AS duration, CASE profile WHEN 'fast' THEN 0.10 WHEN 'best_quality' THEN 0.05 ELSE 0.08 END::DOUBLE AS resource_cost, "
    + "CASE profile WHEN 'fast' THEN 60 WHEN 'balanced' THEN 70 ELSE 82 END AS minimum_score, CASE WHEN bookmarks > 0 THEN 0.75 END::DOUBLE AS minimum_toc_match_ratio, "
    + "list_sort("
    + _list(("'low_structure_strategy_confidence'", "id % 17 = 0"), ("'scanned_or_weak_text_layer'", "scanned"), ("'complex_layout'", "complex_layout"), ("'table_retention_risk'", "tables > 0"), ("'candidate_comparison_required'", "profile = 'best_quality' AND len(candidates) > 1"))
    + ") AS uncertainty, "
    + _list(("'quality_good'", "true"), ("'no_critical_errors'", "true"), ("'source_not_overwritten'", "true"), ("'toc_match_ratio_0.75'", "bookmarks > 0"), ("'tables_reviewed'", "tables > 0"), ("'winner_selected'", "profile = 'best_quality'"))
    + " AS stops, "
    + _list(
        ("'compare_next_local_candidate'", "true"), ("'run_local_structure_enhancement'", "true"), ("'review_and_repair_heading_alignment'", "true"), ("'switch_ocr_candidate'", "len(list_filter(candidates, lambda x: starts_with(x, 'umi:') OR starts_with(x, 'mineru:'))) > 0"),
        ("'request_explicit_remote_escalation'", "len(list_filter(candidates, lambda x: ends_with(x, ':remote_escalation'))) > 0"),
    )
    + " AS escalations FROM twice"
)
def adaptive_plans(spark, folder):
    """Candidates, weights, gates, doubts, stops and escalations of materials."""
    rows = _candidates(spark, folder)
    confidence = F.when(_c("id") % 17 == 0, "low").otherwise("high")
    return rows.select(
        "id",
        "candidates",
        d.unique_by_name(F.concat("candidates", "candidates")).alias("deduplicated"),
        *(d.objective(_c("profile"))[k].alias(k) for k in ("quality", "duration", "resource_cost")),
        d.gate(_c("profile"), _c("bookmarks"))["minimum_score"].alias("minimum_score"),
        d.gate(_c("profile"), _c("bookmarks"))["minimum_toc_match_ratio"].alias("minimum_toc_match_ratio"),
        d.uncertainty(confidence, _c("scanned"), _c("complex_layout"), _c("tables"), _c("profile"), F.size("candidates")).alias("uncertainty"),
        d.stop_conditions(_c("bookmarks"), _c("tables"), _c("profile")).alias("stops"),
        d.escalations(_c("candidates")).alias("escalations"),
    )


@query(
    _SQL
    + """SELECT id, CASE WHEN status = 'missing' THEN 'unsupported' WHEN id % 4 = 0 OR id % 15 = 1 THEN 'start_location_index' WHEN id % 4 = 1 AND id % 8 = 1 THEN 'start_image_book_rebuild' WHEN id % 4 = 2 AND id % 3 = 0 THEN 'start_conversion'
 WHEN kind = 'directory' THEN CASE WHEN images > 0 AND documents = 0 THEN 'start_image_book_rebuild' WHEN documents > 0 THEN 'start_conversion' ELSE 'unsupported' END WHEN kind = 'web_archive' THEN 'process_web_archive' WHEN kind = 'image' THEN 'start_image_book_rebuild' WHEN kind IN ('pdf', 'pandoc', 'docling') THEN 'start_conversion' ELSE 'unsupported' END AS route,
 CASE WHEN id % 9 = 0 THEN 'docling' WHEN kind <> 'pdf' THEN CASE WHEN id % 9 = 1 THEN 'auto' ELSE 'auto' END WHEN id % 10 = 2 THEN 'marker' WHEN scanned THEN CASE WHEN profile = 'fast' THEN 'umi' ELSE 'mineru' END ELSE CASE WHEN id % 2 = 0 THEN 'mineru' ELSE 'auto' END END AS mode,
 CASE WHEN id % 20 = 0 THEN 'skip_or_resume' WHEN id % 3 = 0 AND pipeline = 'MinerU' THEN 'convert_long_task' ELSE 'convert' END AS plan FROM m"""
)
def material_routes(spark, folder):
    """Tool, pipeline and dry-run proposal of materials."""
    i = _c("id")
    intent = F.when(i % 4 == 0, "locate").when((i % 4 == 1) & (i % 8 == 1), "rebuild").when((i % 4 == 2) & (i % 3 == 0), "convert").otherwise("")
    return _materials(spark, folder).select(
        "id",
        d.material_route(_c("status"), _c("kind"), intent, F.when(i % 15 == 1, "q").otherwise(""), _c("documents"), _c("images")).alias("route"),
        d.pdf_mode(_c("kind"), F.when(i % 9 == 0, "docling").when(i % 9 == 1, "auto"), F.when(i % 10 == 2, "marker").otherwise(""), _c("scanned"), F.when(i % 2 == 0, "mineru").otherwise("unknown"), _c("profile")).alias("mode"),
        d.plan_action(i % 20 == 0, F.when(i % 3 == 0, "PDF").otherwise("EPUB"), _c("pipeline")).alias("plan"),
    )


_HAND = "CASE WHEN id % 10 = 9 THEN 'contract_failed' WHEN id % 6 = 0 THEN 'needs_recovery' WHEN id % 7 = 0 THEN 'needs_artifact_review' WHEN id % 11 = 0 THEN 'needs_quality_compare' WHEN id % 4 = 1 THEN 'needs_review' WHEN id % 5 = 0 THEN 'needs_attention' ELSE 'ready' END"


@query(
    _SQL
    + f""", h AS (SELECT *, {_HAND} AS state FROM m)
SELECT id, state, CASE state WHEN 'ready' THEN 'ready_for_archive' WHEN 'contract_failed' THEN 'failed' WHEN 'needs_recovery' THEN 'failed' WHEN 'needs_artifact_review' THEN state WHEN 'needs_quality_compare' THEN state ELSE 'needs_manual_review' END AS lifecycle,
 CASE WHEN tables > 3 THEN 'needs_artifact_review' WHEN columns > 2 THEN 'needs_manual_review' ELSE 'ready_for_archive' END AS bundle, {_list(("'missing_expected_artifacts'", "tables > 3"), ("'layout_table_review'", "columns > 2"))} AS bundle_reasons,
 CASE WHEN noise > 0 THEN 'needs_manual_review' ELSE 'ready_for_archive' END AS queue, CASE WHEN id % 3 > 0 THEN 'needs_manual_review' ELSE 'ready_for_archive' END AS scorecard, CASE WHEN id % 3 = 1 THEN 1 WHEN id % 3 = 2 THEN 2 ELSE 0 END AS scorecard_targets,
 CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS reason_count, tables AS failed_artifact_count FROM h"""
)
def lifecycle_states(spark, folder):
    """Lifecycle states of handoffs, bundles, queues and scorecards."""
    i = _c("id")
    reasons = d.named(("hard_failed_jobs", i % 6 == 0), ("artifact_read_failures", i % 7 == 0), ("quality_regression", i % 11 == 0), ("review_jobs", i % 4 == 1))
    state = d.handoff_state(i % 10 != 9, reasons, i % 5 == 0)
    gates = F.when(i % 3 == 1, F.array(F.lit("pass"), F.lit("review"))).when(i % 3 == 2, F.array(F.lit("review"), F.lit(""))).otherwise(F.array(F.lit("ready")))
    rows = _materials(spark, folder).withColumns({"state": state, "b": d.bundle_lifecycle(F.greatest(_c("tables") - 3, F.lit(0)), F.greatest(_c("columns") - 2, F.lit(0))), "k": d.scorecard_lifecycle(gates), "n": d.lifecycle_counts(_c("reasons"), F.array(), F.array(), F.array(), _c("tables"))})
    return rows.select(
        "id", "state", d.handoff_lifecycle(_c("state")).alias("lifecycle"), _c("b.state").alias("bundle"), _c("b.reasons").alias("bundle_reasons"), d.queue_lifecycle(_c("noise")).alias("queue"),
        _c("k.state").alias("scorecard"), _c("k.targets").alias("scorecard_targets"), "n.reason_count", "n.failed_artifact_count",
    )


@query(_SQL + "SELECT id, 'failed' AS state FROM m WHERE status = 'failed' UNION ALL SELECT id, 'needs_manual_review' FROM m WHERE level IN ('review', 'poor')")
def batch_review_targets(spark, folder):
    """Failures and reviews of a batch."""
    return d.batch_targets(_materials(spark, folder))


_WEAK = "coalesce(reason = 'headings', false)"
_OFF = "outline = 'low_alignment'"


@query(
    _SQL
    + """SELECT id, CASE WHEN status = 'failed' THEN 'read_report_and_try_fallbacks' WHEN outline = 'low_alignment' THEN 'check_outline' WHEN tables = 5 THEN 'check_tables' WHEN columns = 7 THEN 'check_columns' WHEN noise = 8 THEN 'check_noise' WHEN scanned AND pipeline <> 'MinerU' THEN 'rerun_ocr' WHEN complex_layout AND pipeline <> 'MinerU' THEN 'rerun_layout'
 WHEN level = 'poor' THEN CASE WHEN reason = 'headings' THEN 'fix_headings' WHEN reason = 'page_numbers' THEN 'fix_page_numbers' WHEN reason IN ('ocr', 'short_lines') THEN 'fix_ocr' ELSE 'review_and_rerun' END WHEN reason IS NOT NULL THEN 'check_reasons' ELSE 'spot_check' END AS action, """
    + _list(
        ("'read_report'", "id % 2 = 0"), ("'open_output'", "id % 3 > 0"), ("'enhance_markdown_structure'", f"id % 3 > 0 AND {_WEAK}"), ("CASE WHEN kind = 'pdf' THEN 'rerun:pymupdf4llm' ELSE 'rerun:auto' END", "status = 'failed'"),
        ("'inspect_pdf_outline'", "status <> 'failed' AND kind = 'pdf' AND bookmarks > 0 AND (level IN ('review', 'poor') OR outline <> 'aligned')"), ("'compare_pdf_pipelines:outline'", f"status <> 'failed' AND kind = 'pdf' AND {_OFF}"), ("'rerun:mineru:outline'", f"status <> 'failed' AND kind = 'pdf' AND {_OFF}"),
        ("'inspect_table_diagnostics'", "status <> 'failed' AND kind = 'pdf' AND tables = 5"), ("'compare_pdf_pipelines:columns'", "status <> 'failed' AND kind = 'pdf' AND columns = 7"), ("'inspect_noise'", "status <> 'failed' AND kind = 'pdf' AND noise = 8"),
        ("'rerun:umi'", "status <> 'failed' AND kind = 'pdf' AND scanned"), ("'export_location_review_pack'", "status <> 'failed' AND kind = 'pdf' AND scanned"), ("'compare_pdf_pipelines'", f"status <> 'failed' AND kind = 'pdf' AND NOT scanned AND (complex_layout OR {_WEAK})"),
        ("CASE WHEN pipeline = 'MinerU' THEN 'rerun:docling' ELSE 'rerun:mineru' END", f"status <> 'failed' AND kind = 'pdf' AND NOT scanned AND (complex_layout OR {_WEAK})"), ("'rerun:docling:page_numbers'", "status <> 'failed' AND kind = 'pdf' AND NOT scanned AND NOT complex_layout AND coalesce(reason = 'page_numbers', false)"),
    )
    + " AS actions FROM m"
)
def review_actions(spark, folder):
    """What to do first, and next, with results."""
    i = _c("id")
    at = lambda c, v: F.when(_c(c) == v, 1).otherwise(0)
    args = (at("tables", 5), at("columns", 7), at("noise", 8), _c("scanned"), _c("complex_layout"), _c("pipeline"))
    return _materials(spark, folder).select(
        "id",
        d.review_action(_c("status"), _c("outline"), *args, _c("level"), _c("reasons")).alias("action"),
        d.review_actions(_c("status"), _c("kind") == "pdf", F.when(i % 3 > 0, "o").otherwise(""), F.when(i % 2 == 0, "r").otherwise(""), _c("outline"), _c("bookmarks"), _c("level"), *args, _c("reasons")).alias("actions"),
    )


@query(
    _SQL
    + """SELECT id, CASE WHEN id % 5 = 0 AND kind = 'pdf' THEN 'compare_pipelines_or_enhance' WHEN id % 5 = 0 THEN 'enhance_structure' WHEN id % 5 = 1 THEN 'inspect_ocr' WHEN id % 5 = 2 THEN 'improve_cleanup' WHEN id % 5 = 3 THEN 'inspect_tables' ELSE 'record_manual_review' END AS step FROM m"""
)
def queue_next_steps(spark, folder):
    """Next steps of queue items by their categories."""
    i = _c("id")
    categories = d.named(("weak_heading_structure", i % 5 == 0), ("ocr_noise_or_linebreaks", i % 5 <= 1), ("html_or_toc_residue", i % 5 <= 2), ("table_or_layout_review", i % 5 <= 3))
    return _materials(spark, folder).select("id", d.next_step(categories, _c("kind")).alias("step"))


@query(
    _SQL
    + """, caps AS (SELECT owner, suffix AS name, CASE WHEN (id + owner) % 3 = 0 THEN 'ok' WHEN (id + owner) % 41 = 0 THEN 'missing' WHEN (id + owner) % 37 = 0 THEN 'degraded' ELSE 'ok' END AS status FROM m WHERE id % 97 < owner),
g AS (SELECT owner, coalesce(list_sort(list(DISTINCT name) FILTER (status = 'ok')), []) AS ready, coalesce(list_sort(list(DISTINCT name) FILTER (status = 'degraded')), []) AS degraded, coalesce(list_sort(list(DISTINCT name) FILTER (status = 'missing')), []) AS missing, coalesce(list(DISTINCT name) FILTER (status <> 'missing'), []) AS have FROM caps GROUP BY owner),
l AS (SELECT *, list_filter(['.epub', '.pdf'], lambda r: NOT list_contains(have, r)) AS missing_minimal FROM g)
SELECT owner, ready, degraded, missing, missing_minimal, CASE WHEN len(missing_minimal) > 0 THEN 'core_missing' WHEN len(degraded) + len(missing) > 0 THEN 'degraded_optional' ELSE 'core_ok' END AS status FROM l"""
)
def health_states(spark, folder):
    """State of installations from their capabilities."""
    k = _c("id") + _c("owner")
    status = F.when(k % 3 == 0, "ok").when(k % 41 == 0, "missing").when(k % 37 == 0, "degraded").otherwise("ok")
    rows = _materials(spark, folder).filter(_c("id") % 97 < _c("owner")).select("owner", _c("suffix").alias("name"), status.alias("status"))
    return d.health(rows, (".pdf", ".epub"), "owner")


@query(
    _SQL
    + """SELECT id, CASE id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'planned_only' WHEN 2 THEN 'missing' ELSE 'degraded' END AS module FROM m"""
)
def module_states(spark, folder):
    """State of modules from their checks."""
    i = _c("id")
    a = lambda *v: F.array(*(F.lit(x) for x in v))
    values = F.when(i % 5 == 0, a("missing", "ok")).when(i % 5 == 1, a("planned_only", "missing")).when(i % 5 == 2, a("missing", "missing")).when(i % 5 == 3, a("missing", "unknown")).otherwise(a("degraded"))
    return _materials(spark, folder).select("id", d.check_status(values).alias("module"))


@query(
    _SQL
    + """, s AS (SELECT owner, id % 60 = owner % 60 AS rec, CASE WHEN id % 2 = 0 THEN ['ocr', 'vlm'] ELSE ['vlm'] END AS routes, CASE WHEN id % 60 = owner % 60 THEN pages ELSE 0 END AS p, documents, images * 4 AS images FROM m),
g AS (SELECT owner, coalesce(list_sort(list_distinct(flatten(list(routes) FILTER (rec)))), []) AS routes, sum(p)::BIGINT AS estimated_pages, max(documents) AS documents, max(images) AS images FROM s GROUP BY owner)
SELECT *, len(routes) > 0 AS recommended, CASE WHEN estimated_pages > 0 THEN CASE WHEN estimated_pages >= 100 THEN 'high' WHEN estimated_pages >= 20 THEN 'medium' ELSE 'low' END WHEN documents + images >= 50 THEN 'medium' ELSE 'low' END AS cost_risk,
 CASE WHEN len(routes) > 0 AND documents > 0 THEN 'high' WHEN len(routes) > 0 THEN 'medium' ELSE 'none' END AS privacy_risk FROM g"""
)
def folder_online(spark, folder):
    """Online routes and risks of folders."""
    i = _c("id")
    rec = i % 60 == _c("owner") % 60
    rows = _materials(spark, folder).select("owner", rec.alias("recommended"), F.when(i % 2 == 0, F.array(F.lit("ocr"), F.lit("vlm"))).otherwise(F.array(F.lit("vlm"))).alias("routes"), F.when(rec, _c("pages")).otherwise(0).alias("pages"), "documents", (_c("images") * 4).alias("images"))
    return d.folder_online(rows, "owner")


_BASE = "CASE id % 7 WHEN 0 THEN 0.82 WHEN 1 THEN 0.82 WHEN 2 THEN 0.76 WHEN 3 THEN 0.72 WHEN 4 THEN 0.70 WHEN 5 THEN 0.74 ELSE 0.65 END"


@query(
    _SQL
    + f""", s AS (SELECT id, {_BASE} + CASE WHEN id % 2 = 0 THEN 0.06 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.10 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0.03 ELSE 0 END AS score, CASE WHEN id % 4 = 0 THEN id % 11 / 10.0 END AS cand FROM m)
SELECT s.id, round(least(greatest(CASE WHEN cand > 0 THEN greatest(score, least(0.98, 0.62 + cand * 0.35)) ELSE score END, 0.05), 0.98), 3)::DOUBLE AS confidence,
 round(least(CASE s.id % 5 WHEN 0 THEN 0.80 WHEN 1 THEN 0.86 WHEN 2 THEN 0.84 WHEN 3 THEN 0.78 ELSE 0.70 END + CASE WHEN s.id % 2 = 0 THEN 0.04 ELSE 0 END, 0.96), 3)::DOUBLE AS cleanup,
 list_filter([CASE WHEN s.id % 3 = 0 THEN 'candidate_source:pdf_outline' END, CASE WHEN s.id % 6 > 0 THEN concat('candidate_level:', s.id % 6) END, CASE WHEN pages > 0 THEN concat('candidate_page:', pages) END], {_KEEP}) AS signals FROM s JOIN m ON m.id = s.id"""
)
def decision_confidences(spark, folder):
    """Confidence of heading and cleanup decisions, and candidates' signals."""
    i = _c("id")
    kinds = ("chapter", "article", "parenthesized_clause", "numeric_item", "parenthesized_digit_item", "external_candidate", "other")
    kind = F.get(F.array(*(F.lit(k) for k in kinds)), (i % 7).cast("int"))
    signals = d.named(("normalized_existing_heading", i % 2 == 0), ("candidate_source:pdf_outline", i % 3 == 0), ("nearest_parent:x", i % 5 == 0), (F.concat(F.lit("candidate_score:"), (i % 11 / 10).cast("string")), i % 4 == 0))
    cleanup = F.get(F.array(*(F.lit(k) for k in ("toc_remnant", "standalone_page_number", "repeated_header_footer", "consecutive_duplicate", "other"))), (i % 5).cast("int"))
    known = d.candidate_signals(F.when(i % 3 == 0, "pdf_outline").otherwise(""), i % 6, F.lit(0.0), _c("pages"), F.lit(""))
    return _materials(spark, folder).select("id", d.decision_confidence(kind, signals).alias("confidence"), d.cleanup_confidence(cleanup, i % 2 == 0).alias("cleanup"), known.alias("signals"))
