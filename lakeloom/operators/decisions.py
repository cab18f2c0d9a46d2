"""Routes, strategies, candidates, gates, review actions and lifecycle states of materials, as decision tables over their rows.

Every decision is a column expression over one row, so it needs no shuffle; the rules of a list keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import CALIBRE, DOCLING, MARKITDOWN, PANDOC, PDF

# Names of strategies, routes and states.
LOCAL_PIPELINES = ("marker", "mineru", "umi", "pymupdf4llm", "docling", "markitdown", "ocrmypdf", "pdfcraft", "olmocr")
OBJECTIVES = {"fast": (0.55, 0.35, 0.10), "best_quality": (0.88, 0.07, 0.05), "balanced": (0.72, 0.20, 0.08)}
GATE_SCORES = {"fast": 60, "balanced": 70, "best_quality": 82}
GATE_WEIGHTS = {"text_coverage": 0.22, "heading_structure": 0.22, "reading_order": 0.14, "noise": 0.14, "toc_or_bookmark_alignment": 0.12, "table_formula_retention": 0.11, "duration": 0.05}
HANDOFF_STATES = {
    "ready": "ready_for_archive", "contract_failed": "failed", "needs_recovery": "failed", "needs_artifact_review": "needs_artifact_review",
    "needs_quality_compare": "needs_quality_compare", "needs_review": "needs_manual_review", "needs_attention": "needs_manual_review",
}
NEXT_STEPS = ("compare_pipelines_or_enhance", "enhance_structure", "inspect_ocr", "improve_cleanup", "inspect_tables", "record_manual_review")


def named(*rules: tuple[str | Column, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name) if isinstance(name, str) else name) for name, test in rules)))


def _by_map(c: Column, values: dict, default: Column) -> Column:
    out = default
    for k, v in reversed(values.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def pdf_strategy(scanned: Column, complex_layout: Column, presentation: Column, bookmarks: Column) -> Column:
    """How a PDF's structure is to be found: mode, confidence and tools in order."""
    tools = lambda *names: F.array(*(F.lit(n) for n in names))
    s = lambda mode, confidence, t: F.struct(F.lit(mode).alias("mode"), F.lit(confidence).alias("confidence"), t.alias("tools"))
    return (
        F.when(presentation, s("presentation_pdf_slide_recovery", "medium", tools("mineru", "docling", "umi", "pymupdf4llm")))
        .when((bookmarks > 0) & scanned, s("bookmark_guided_structure_recovery", "medium", tools("ocrmypdf", "mineru", "umi")))
        .when(bookmarks > 0, s("bookmark_guided_structure_recovery", "high", tools("mineru", "docling", "pymupdf4llm")))
        .when(scanned, s("ocr_first_with_review", "medium", tools("ocrmypdf", "umi", "mineru")))
        .when(complex_layout, s("layout_aware_structure_recovery", "medium", tools("mineru", "docling", "marker")))
        .otherwise(s("text_layer_conversion", "high", tools("pymupdf4llm")))
    )


def folder_strategy(documents: Column, images: Column) -> Column:
    """Mode and confidence of a folder by what it holds."""
    s = lambda mode, confidence: F.struct(F.lit(mode).alias("mode"), confidence.alias("confidence"))
    return (
        F.when((images > 0) & (documents == 0), s("image_book_recognition", F.when(images >= 8, "medium").otherwise("low")))
        .when((documents > 0) & (images > 0), s("mixed_material_routing", F.lit("medium")))
        .when(documents > 0, s("document_conversion", F.lit("high")))
        .otherwise(s("none", F.lit("low")))
    )


def document_strategy(suffix: Column) -> Column:
    return F.when(suffix.isin(".epub", ".azw", ".azw3", ".mobi"), "toc_aligned_conversion").when(suffix.isin(*DOCLING), "docling_or_pandoc_structure").otherwise("pandoc_text_structure")


def pdf_tool(scanned: Column, complex_layout: Column, presentation: Column, recommended: Column) -> Column:
    return F.when(presentation, "presentation_pdf_slide_recovery").when(scanned, "build_location_index_or_mineru_ocr").when(complex_layout, "mineru").otherwise(F.concat(F.lit("convert_document_"), recommended))


def pdf_enhancements(scanned: Column, complex_layout: Column, presentation: Column, two_columns: Column, tables: Column) -> Column:
    """Optional backends that could help with a PDF, each once."""
    heavy = scanned | complex_layout | presentation
    layout = complex_layout | (two_columns > 0) | presentation
    return named(("MonkeyOCR:document_vlm_parse", heavy), ("dots.mocr:vlm_layout_provider", heavy), ("DocLayout-YOLO:layout_detector_baseline", layout), ("pdf_table:table_worker", tables > 0))


def image_enhancements(width: Column, height: Column) -> Column:
    """Optional backends for a large or long image."""
    long = (width > 0) & (height > 0) & (F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1)) >= 1.8)
    heavy = (F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0)) >= 1_800_000) | long
    return named(("dots.mocr:image_vlm_layout_provider", heavy), ("MonkeyOCR:image_document_vlm_parse", heavy))


def folder_enhancements(samples: DataFrame, key: str) -> DataFrame:
    """Optional backends of a folder: those of its sampled files, each once, and one for folders of eight images or more without documents."""
    rows = samples.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("enhancements")))).alias("enhancements"), F.max("documents").alias("documents"), F.max("images").alias("images"))
    extra = F.when((F.col("images") >= 8) & (F.col("documents") == 0), F.array(F.lit("MonkeyOCR:image_folder_document_vlm_parse"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("enhancements", F.concat("enhancements", extra))


def document_baselines(suffix: Column, docling_installed: Column) -> Column:
    """Cheap routes for a document, with their roles."""
    fallback = F.when(suffix.isin(*DOCLING) & ~docling_installed, "MarkItDown:fallback_when_docling_missing").otherwise("MarkItDown:comparison_baseline")
    return named(("Pandoc:primary_fast_baseline", suffix.isin(*PANDOC)), ("Calibre+Pandoc:primary_normalization_baseline", suffix.isin(*CALIBRE)), ("Docling:structured_document_baseline", suffix.isin(*DOCLING)), (fallback, suffix.isin(*(x for x in MARKITDOWN if x not in PDF))))


def pdf_baselines(scanned: Column, mode: Column) -> Column:
    layout = mode.isin("layout_aware_structure_recovery", "presentation_pdf_slide_recovery", "bookmark_guided_structure_recovery")
    return named(("OCRmyPDF:searchable_pdf_preprocess_baseline", scanned), ("PyMuPDF4LLM:fast_text_layer_baseline", F.lit(True)), ("Docling:structured_pdf_comparison", layout), ("MarkItDown:explicit_pdf_comparison", F.lit(True)))


def pdf_primary(profile: Column, pages: Column, scanned: Column, complex_layout: Column, presentation: Column) -> Column:
    fast = profile == "fast"
    return F.when(scanned, F.when(fast, "umi").otherwise("mineru")).when(fast, "pymupdf4llm").when(complex_layout | presentation, "mineru").when((pages > 0) & (pages <= 12), "marker").otherwise("mineru")


def pdf_candidates(profile: Column, pages: Column, scanned: Column, complex_layout: Column, presentation: Column, tables: Column) -> Column:
    """Candidates of a PDF in order, `pipeline:role`, each pipeline once."""
    first = pdf_primary(profile, pages, scanned, complex_layout, presentation)
    return named(
        (F.concat(first, F.lit(":primary")), F.lit(True)),
        ("pymupdf4llm:text_baseline", first != "pymupdf4llm"),
        ("mineru:structure_candidate", first != "mineru"),
        ("umi:ocr_baseline", scanned & (first != "umi")),
        ("marker:short_layout_candidate", (pages > 0) & (pages <= 12) & (first != "marker")),
        ("docling:layout_table_candidate", presentation | (tables > 0)),
        ("online_only_vlm:remote_escalation", (profile == "best_quality") & (scanned | complex_layout | presentation)),
    )


def image_candidates(profile: Column) -> Column:
    first = F.when(profile == "fast", "image_book_rapidocr:primary").otherwise("image_book_auto:primary")
    return named((first, F.lit(True)), ("image_book_umi:ocr_candidate", F.lit(True)), ("image_online_vlm:remote_escalation", profile == "best_quality"))


def document_candidates(profile: Column, suffix: Column) -> Column:
    structured = (document_strategy(suffix) == "docling_or_pandoc_structure") & (profile == "best_quality")
    office = suffix.isin(".docx", ".pptx", ".xlsx", ".html", ".htm", ".md")
    return named(("document_docling:primary", structured), ("document_auto:primary", ~structured), ("document_markitdown:structure_candidate", office & structured), ("document_docling:structure_candidate", office & ~structured))


def candidates(kind: Column, profile: Column, suffix: Column, pdf: Column, documents: Column, images: Column) -> Column:
    """Candidates of any material by its kind; pdf: those of pdf_candidates()."""
    return (
        F.when(kind == "pdf", pdf)
        .when((kind == "image") | ((kind == "directory") & (images > 0) & (documents == 0)), image_candidates(profile))
        .when(kind == "directory", F.array(F.lit("mixed_material_router:primary")))
        .when(kind == "web_archive", F.array(F.lit("web_archive_visual_check:primary")))
        .when(kind.isin("pandoc", "calibre", "docling", "markitdown"), document_candidates(profile, suffix))
        .otherwise(F.array().cast("array<string>"))
    )


def unique_by_name(items: Column) -> Column:
    """`name:...` items whose name did not come before, empty names left out."""
    name = lambda x: F.split(x, ":")[0]
    names = F.transform(items, name)
    return F.filter(F.transform(items, lambda x, i: F.when((name(x) != "") & (F.array_position(names, name(x)) == i + 1), x)), lambda x: x.isNotNull())


def objective(profile: Column) -> Column:
    """Weights of quality, duration and cost."""
    part = lambda k: _by_map(profile, {p: v[k] for p, v in OBJECTIVES.items()}, F.lit(OBJECTIVES["balanced"][k]))
    return F.struct(part(0).alias("quality"), part(1).alias("duration"), part(2).alias("resource_cost"))


def gate(profile: Column, bookmarks: Column) -> Column:
    return F.struct(_by_map(profile, GATE_SCORES, F.lit(GATE_SCORES["fast"])).alias("minimum_score"), F.when(bookmarks > 0, 0.75).alias("minimum_toc_match_ratio"))


def uncertainty(confidence: Column, scanned: Column, complex_layout: Column, tables: Column, profile: Column, n_candidates: Column) -> Column:
    rules = (
        ("low_structure_strategy_confidence", confidence == "low"),
        ("scanned_or_weak_text_layer", scanned),
        ("complex_layout", complex_layout),
        ("table_retention_risk", tables > 0),
        ("candidate_comparison_required", (profile == "best_quality") & (n_candidates > 1)),
    )
    return F.array_sort(named(*rules))


def stop_conditions(bookmarks: Column, tables: Column, profile: Column) -> Column:
    best = profile == "best_quality"
    always = F.lit(True)
    return named(("quality_good", always), ("no_critical_errors", always), ("source_not_overwritten", always), ("toc_match_ratio_0.75", bookmarks > 0), ("tables_reviewed", tables > 0), ("winner_selected", best))


def escalations(items: Column) -> Column:
    """Rules of escalation that a list of candidates brings."""
    has = lambda n: F.exists(items, lambda x: x.startswith(n))
    always = F.lit(True)
    return named(
        ("compare_next_local_candidate", always), ("run_local_structure_enhancement", always), ("review_and_repair_heading_alignment", always),
        ("switch_ocr_candidate", has("umi:") | has("mineru:")), ("request_explicit_remote_escalation", F.exists(items, lambda x: x.endswith(":remote_escalation"))),
    )


def material_route(status: Column, kind: Column, intent: Column, query: Column, documents: Column, images: Column) -> Column:
    """Which tool takes a material."""
    return (
        F.when(status.isin("missing", "unsupported"), "unsupported")
        .when((intent == "locate") | (query != ""), "start_location_index")
        .when(intent == "rebuild", "start_image_book_rebuild")
        .when(intent == "convert", "start_conversion")
        .when(kind == "directory", F.when((images > 0) & (documents == 0), "start_image_book_rebuild").when(documents > 0, "start_conversion").otherwise("unsupported"))
        .when(kind == "web_archive", "process_web_archive")
        .when(kind == "image", "start_image_book_rebuild")
        .when(kind.isin("pdf", "pandoc", "calibre", "docling", "markitdown"), "start_conversion")
        .otherwise("unsupported")
    )


def pdf_mode(kind: Column, requested: Column, planned: Column, scanned: Column, recommended: Column, profile: Column) -> Column:
    """The pipeline of a PDF: the one asked for, the plan's, else by what the preflight says."""
    asked = F.coalesce(requested, F.lit(""))
    known = F.when(recommended.isin(*LOCAL_PIPELINES), recommended).otherwise("auto")
    by_pages = F.when(scanned, F.when(profile == "fast", "umi").otherwise("mineru")).otherwise(known)
    return F.when((asked != "") & (asked != "auto"), asked).when(kind != "pdf", F.when(asked != "", asked).otherwise("auto")).when(planned.isin(*LOCAL_PIPELINES), planned).otherwise(by_pages)


def handoff_state(valid: Column, reasons: Column, attention: Column) -> Column:
    """State of a batch that is handed over."""
    has = lambda r: F.array_contains(reasons, r)
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "contract_failed").when(has("hard_failed_jobs"), "needs_recovery").when(has("artifact_read_failures"), "needs_artifact_review")
        .when(has("quality_regression"), "needs_quality_compare").when(has("review_jobs"), "needs_review").when(attention, "needs_attention").otherwise("ready")
    )


def handoff_lifecycle(state: Column) -> Column:
    return _by_map(state, HANDOFF_STATES, F.lit("needs_manual_review"))


def bundle_lifecycle(missing: Column, reviews: Column) -> Column:
    """State and reasons of a bundle of layout and table reviews."""
    state = F.when(missing > 0, "needs_artifact_review").when(reviews > 0, "needs_manual_review").otherwise("ready_for_archive")
    return F.struct(state.alias("state"), named(("missing_expected_artifacts", missing > 0), ("layout_table_review", reviews > 0)).alias("reasons"))


def scorecard_lifecycle(gates: Column) -> Column:
    """State of a scorecard by its backends' gates, and how many call for a review."""
    open_ = F.size(F.filter(gates, lambda g: ~g.isin("candidate_pass", "pass", "ready")))
    return F.struct(F.when(open_ > 0, "needs_manual_review").otherwise("ready_for_archive").alias("state"), open_.alias("targets"))


def queue_lifecycle(items: Column) -> Column:
    return F.when(items > 0, "needs_manual_review").otherwise("ready_for_archive")


def lifecycle_counts(reasons: Column, artifacts: Column, targets: Column, actions: Column, failed: Column) -> Column:
    """Sizes of a lifecycle record's lists."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.struct(n(reasons).alias("reason_count"), n(artifacts).alias("artifact_count"), F.coalesce(failed, F.lit(0)).alias("failed_artifact_count"), n(targets).alias("review_item_count"), n(actions).alias("next_action_count"))


def batch_targets(runs: DataFrame) -> DataFrame:
    """Runs (id, status, level) with a failure or a review, a row for each: id, state."""
    each = named(("failed", F.col("status") == "failed"), ("needs_manual_review", F.col("level").isin("review", "poor")))
    return runs.select("id", F.explode(each).alias("state"))


def review_action(status: Column, outline: Column, tables: Column, columns: Column, noise: Column, scanned: Column, complex_layout: Column, pipeline: Column, level: Column, reasons: Column) -> Column:
    """The one thing to do first with a result."""
    other = ~F.lower(pipeline).contains("mineru")
    has = lambda r: F.array_contains(reasons, r)
    poor = F.when(has("headings"), "fix_headings").when(has("page_numbers"), "fix_page_numbers").when(has("ocr") | has("short_lines"), "fix_ocr").otherwise("review_and_rerun")
    return (
        F.when(status == "failed", "read_report_and_try_fallbacks").when(outline.isin("low_alignment", "no_markdown_headings"), "check_outline").when(tables > 0, "check_tables").when(columns > 0, "check_columns")
        .when(noise > 0, "check_noise").when(scanned & other, "rerun_ocr").when(complex_layout & other, "rerun_layout").when(level == "poor", poor).when(F.size(reasons) > 0, "check_reasons").otherwise("spot_check")
    )


def review_actions(status: Column, pdf: Column, output: Column, report: Column, outline: Column, bookmarks: Column, level: Column, tables: Column, columns: Column, noise: Column, scanned: Column, complex_layout: Column, pipeline: Column, reasons: Column) -> Column:
    """The next actions of a result, in order; a failed one ends with its rerun."""
    ok = status != "failed"
    has = lambda r: F.array_contains(reasons, r)
    weak = has("headings")
    page = ok & pdf
    off = outline.isin("low_alignment", "no_markdown_headings")
    again = F.when(F.lower(pipeline).contains("mineru"), "rerun:docling").otherwise("rerun:mineru")
    structure = page & ~scanned & (complex_layout | weak)
    return named(
        ("read_report", report != ""),
        ("open_output", output != ""),
        ("enhance_markdown_structure", (output != "") & weak),
        (F.when(pdf, "rerun:pymupdf4llm").otherwise("rerun:auto"), ~ok),
        ("inspect_pdf_outline", page & (bookmarks > 0) & (level.isin("review", "poor") | outline.isin("low_alignment", "partial_alignment", "no_markdown_headings"))),
        ("compare_pdf_pipelines:outline", page & off),
        ("rerun:mineru:outline", page & off),
        ("inspect_table_diagnostics", page & (tables > 0)),
        ("compare_pdf_pipelines:columns", page & (columns > 0)),
        ("inspect_noise", page & (noise > 0)),
        ("rerun:umi", page & scanned),
        ("export_location_review_pack", page & scanned),
        ("compare_pdf_pipelines", structure),
        (again, structure),
        ("rerun:docling:page_numbers", page & ~scanned & ~complex_layout & ~weak & has("page_numbers")),
    )


def next_step(categories: Column, category: Column) -> Column:
    has = lambda c: F.array_contains(categories, c)
    weak = has("weak_heading_structure")
    pairs = (weak & category.isin("scanned_pdf", "complex_pdf", "pdf"), weak, has("ocr_noise_or_linebreaks"), has("html_or_toc_residue"), has("table_or_layout_review"))
    out = F.lit(NEXT_STEPS[-1])
    for test, name in reversed(list(zip(pairs, NEXT_STEPS, strict=False))):
        out = F.when(test, name).otherwise(out)
    return out


def health(capabilities: DataFrame, required: tuple[str, ...], *keys: str) -> DataFrame:
    """State of an installation from its capabilities (name, status): the required ones decide, optional ones only degrade."""
    names = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("name"))))
    rows = capabilities.groupBy(*keys).agg(names("ok").alias("ready"), names("degraded").alias("degraded"), names("missing").alias("missing"), F.collect_set(F.when(F.col("status") != "missing", F.col("name"))).alias("_have"))
    lacking = F.filter(F.array(*(F.lit(r) for r in sorted(required))), lambda r: ~F.array_contains("_have", r))
    rows = rows.withColumn("missing_minimal", lacking)
    state = F.when(F.size("missing_minimal") > 0, "core_missing").when((F.size("degraded") > 0) | (F.size("missing") > 0), "degraded_optional").otherwise("core_ok")
    return rows.withColumn("status", state).drop("_have")


def check_status(values: Column) -> Column:
    """State of a module from its checks."""
    has = lambda v: F.array_contains(values, v)
    return F.when(has("ok"), "ok").when(has("planned_only"), "planned_only").when((F.size(values) > 0) & F.forall(values, lambda v: v == "missing"), "missing").otherwise("degraded")


def plan_action(exists: Column, label: Column, pipeline: Column) -> Column:
    """What a dry run proposes for a source."""
    return F.when(exists, "skip_or_resume").when((label == "PDF") & F.lower(pipeline).contains("mineru"), "convert_long_task").otherwise("convert")


def folder_online(samples: DataFrame, key: str) -> DataFrame:
    """Online routes of a folder from its sampled files (recommended, routes, pages), and its risks of cost and privacy."""
    rows = samples.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("recommended"), F.col("routes")))))).alias("routes"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("estimated_pages"),
        F.max("documents").alias("documents"),
        F.max("images").alias("images"),
    )
    pages, items = F.col("estimated_pages"), F.col("documents") + F.col("images")
    cost = F.when(pages > 0, F.when(pages >= 100, "high").when(pages >= 20, "medium").otherwise("low")).when(items >= 50, "medium").otherwise("low")
    rows = rows.withColumn("recommended", F.size("routes") > 0)
    privacy = F.when(F.col("recommended") & (F.col("documents") > 0), "high").when(F.col("recommended"), "medium").otherwise("none")
    return rows.withColumns({"cost_risk": cost, "privacy_risk": privacy})


def decision_confidence(kind: Column, signals: Column) -> Column:
    """Confidence of a heading decision from its kind and signals."""
    base = {"chapter": 0.82, "section": 0.82, "article": 0.82, "parenthesized_clause": 0.76, "numeric_item": 0.72, "parenthesized_digit_item": 0.70, "external_candidate": 0.74, "existing_heading_with_signal": 0.86}
    joined = F.array_join(signals, "\n")
    marks = (
        ("normalized_existing_heading", 0.06), ("candidate_source:pdf_outline", 0.10), ("candidate_source:pymupdf_font_jump", 0.08), ("candidate_source:mineru_paragraph_title", 0.08),
        ("candidate_source:docling_heading", 0.08), ("candidate_source:domain_grammar", 0.04), ("nearest_parent:", 0.03),
    )
    score = _by_map(kind, base, F.lit(0.65)).cast("decimal(6,4)")
    for mark, points in marks:
        score = score + F.when(joined.contains(mark), F.lit(points).cast("decimal(6,4)")).otherwise(F.lit(0).cast("decimal(6,4)"))
    best = F.array_max(candidate_scores(signals))
    score = score.cast("double")
    score = F.when(F.coalesce(best, F.lit(0.0)) > 0, F.greatest(score, F.least(F.lit(0.98), 0.62 + best * 0.35))).otherwise(score)
    return F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(0.98)), 3)


def candidate_scores(signals: Column) -> Column:
    """Scores that signals carry."""
    found = F.transform(signals, lambda s: F.nullif(F.regexp_extract(s, r"^candidate_score:(\d+(?:\.\d+)?)$", 1), F.lit("")).cast("double"))
    return F.filter(found, lambda x: x.isNotNull())


def candidate_signals(source: Column, level: Column, score: Column, page: Column, font: Column) -> Column:
    """What is known about a heading candidate, as text."""
    part = lambda name, c, test: (F.concat(F.lit(f"{name}:"), c.cast("string")), F.coalesce(test, F.lit(False)))
    return named(part("candidate_source", source, source != ""), part("candidate_level", level, level > 0), part("candidate_score", score, score > 0), part("candidate_page", page, page > 0), part("font", font, font != ""))


def cleanup_confidence(kind: Column, keyed: Column) -> Column:
    base = _by_map(kind, {"toc_remnant": 0.80, "standalone_page_number": 0.86, "repeated_header_footer": 0.84, "consecutive_duplicate": 0.78}, F.lit(0.70))
    return F.round(F.least(base + F.when(keyed, 0.04).otherwise(0.0), F.lit(0.96)), 3)
