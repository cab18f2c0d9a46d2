"""States, gates and routes of artifacts and backends, as decision tables over rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lifecycle reasons with their states, gravest first, and what follows from a state.
REASON_STATES = (
    ("partial_run", "processing"),
    ("hard_failed_jobs", "failed"),
    ("artifact_read_failures", "needs_artifact_review"),
    ("quality_regression", "needs_quality_compare"),
    ("review_jobs", "needs_manual_review"),
)
FOLLOWUPS = {
    "processing": "poll_or_wait_for_current_job",
    "failed": "inspect_failure_and_rerun_safely",
    "needs_artifact_review": "inspect_missing_or_failed_artifacts",
    "needs_quality_compare": "read_quality_comparison_before_acceptance",
    "needs_manual_review": "inspect_review_targets",
    "ready_for_archive": "manual_accept_then_optionally_archive_outputs",
}
# Artifact types of JSON files by the first marker in their names.
JSON_MARKERS = (
    (("agent-handoff-bundle",), "agent_handoff_bundle_json"),
    (("agent-smoke-summary",), "agent_smoke_summary_json"),
    (("agent-batch-results",), "agent_batch_results"),
    (("layout-table-review-bundle",), "layout_table_review_bundle_json"),
    (("backend-scorecard",), "optional_backend_scorecard_json"),
    (("candidate-benchmark-plan", "candidate-plan"), "candidate_benchmark_plan_json"),
    (("review-decisions",), "review_decisions_json"),
    (("review-checklist",), "review_json"),
    (("environment-report",), "environment_json"),
    (("environment-lock-compare",), "environment_lock_compare_json"),
    (("environment-lock",), "environment_lock"),
    (("benchmark-quality-comparison",), "quality_comparison_json"),
    (("pipeline-comparison",), "pdf_pipeline_comparison_json"),
    (("quality-improvement-queue",), "quality_improvement_queue_json"),
    (("visual_check_result",), "visual_check_json"),
    (("visual_blocks",), "visual_blocks_json"),
    (("ocr-provider-comparison", "ocr_provider_comparison"), "ocr_provider_comparison_json"),
    (("external-wrapper-result",), "external_wrapper_result_json"),
    (("layout_candidates", "layout-candidates"), "layout_candidates_json"),
    (("table_candidates", "table-candidates"), "table_candidates_json"),
    (("formula_candidates", "formula-candidates"), "formula_candidates_json"),
    (("document-vlm-result", "document_vlm_result"), "document_vlm_result_json"),
    (("docling-document", "docling_document"), "docling_document_json"),
    (("document-quality-evaluation", "document_quality_evaluation"), "document_quality_evaluation_json"),
    (("document-provenance", "document_provenance"), "document_provenance_json"),
    (("image_positions",), "image_positions_json"),
    (("pypdf-metadata", "pdf-metadata"), "pdf_metadata_json"),
    (("pypdf-outline", "pdf-outline"), "pdf_outline_json"),
    (("layout-evidence", "layout_evidence"), "pdf_layout_evidence_json"),
    (("summary",), "summary_json"),
    (("report",), "conversion_report"),
    (("cluster",), "clusters_json"),
    (("structure",), "structure_json"),
)
# Points of a backend's state.
STATUS_SCORES = {"ok": 55, "degraded": 35, "needs_server": 28, "needs_model": 25, "needs_env": 22, "planned_only": 18, "missing": 10}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def lifecycle_state(reasons: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for reason, state in REASON_STATES:
        out = out.when(F.array_contains(reasons, reason), state)
    return out.otherwise("ready_for_archive")


def followup(state: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(FOLLOWUPS), state), F.lit("inspect_review_lifecycle"))


def artifact_type(path: Column) -> Column:
    """Type of an artifact by its name and suffix."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    kind = F.regexp_extract(name, r"\.([^.]+)$", 1)
    json = F.when(F.lit(False), F.lit(""))
    for markers, value in JSON_MARKERS:
        for marker in markers:
            json = json.when(name.contains(marker), value)
    lines = F.when(name == "chat.jsonl", "chat_jsonl").when(name.rlike("ocr-blocks|ocr_blocks"), "ocr_blocks_jsonl").when(name.contains("location"), "location_index_jsonl").otherwise("pages_jsonl")
    text = F.when(name == "chat.md", "chat_markdown").when(name.contains("agent-handoff-bundle"), "agent_handoff_bundle_markdown").when(name.contains("agent-smoke-summary"), "agent_smoke_summary_markdown").otherwise("markdown")
    return (
        F.when(kind.isin("md", "markdown"), text)
        .when(kind == "jsonl", lines)
        .when(kind == "json", json.otherwise("json"))
        .when(kind.isin("log", "txt"), "text")
        .when(kind.isin("html", "htm"), "html")
        .otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("artifact")))
    )


def combined_status(checks: DataFrame, backend: str = "backend") -> DataFrame:
    """Status of a backend from its health checks; ok wins, then a degraded one, then what is missing for it."""
    rank = (
        F.when(F.col("status") == "ok", 0)
        .when(F.col("status").isin("degraded", "warning", "caution"), 1)
        .when(F.col("status") == "needs_server", 2)
        .when(F.col("status") == "needs_model", 3)
        .when(F.col("status") == "needs_env", 4)
        .when(F.col("status") == "planned_only", 5)
        .otherwise(6)
    )
    names = F.array(*(F.lit(x) for x in ("ok", "degraded", "needs_server", "needs_model", "needs_env", "planned_only", "missing")))
    return checks.groupBy(backend).agg(F.min(rank).alias("_r")).select(backend, F.get(names, F.col("_r")).alias("status"))


def recommendation_score(status: Column, cost: Column, policy: Column) -> Column:
    score = F.coalesce(F.try_element_at(_map(STATUS_SCORES), status), F.lit(10))
    score = score + F.when(cost.contains("low"), 20).when(cost.contains("medium"), 12).when(cost.contains("heavy"), 4).otherwise(0)
    score = score + F.when(policy.contains("default") | policy.contains("recommended"), 10).otherwise(0)
    score = score - F.when(policy.contains("explicit only"), 8).otherwise(0) - F.when(policy.contains("not default"), 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def promotion(rows: DataFrame) -> DataFrame:
    """rows (status, cost, evidence_count, signals) with the promotion gate and its decision."""
    c = F.col
    gate = (
        F.when(c("evidence_count") == 0, "no_evidence")
        .when(c("status").isin("planned_only", "needs_env", "needs_model", "needs_server"), "environment_not_ready")
        .when(F.lower("cost").contains("heavy") & (c("evidence_count") < 2), "insufficient_evidence")
        .when(c("signals") == 0, "insufficient_quality_signals")
        .otherwise("review_candidate")
    )
    decisions = {"no_evidence": "do_not_promote", "environment_not_ready": "plan_or_fix_environment_first", "insufficient_evidence": "review_only", "insufficient_quality_signals": "review_only", "review_candidate": "compare_on_shared_manifest"}
    return rows.withColumn("gate", gate).withColumn("decision", F.try_element_at(_map(decisions), F.col("gate")))


def representative_pages(count: Column, limit: int = 8) -> Column:
    """Ascending page numbers to look at first: ends, quarters and a stride; all pages of short documents."""
    part = lambda a, b: F.greatest(F.lit(1), F.floor(count * a / b)).cast("int")
    fixed = F.array_distinct(F.array(F.lit(1), F.lit(2), count.cast("int"), part(1, 4), part(1, 2), part(3, 4)))
    step = F.greatest(F.lit(1), F.floor(count / F.greatest(F.lit(limit) - F.size(fixed), F.lit(1)))).cast("int")
    more = F.filter(F.sequence(step, F.greatest(count.cast("int") - 1, step), step), lambda p: (p < count) & ~F.array_contains(fixed, p))
    chosen = F.slice(F.array_sort(F.concat(fixed, F.slice(more, F.lit(1), F.greatest(F.lit(limit) - F.size(fixed), F.lit(0))))), 1, limit)
    return F.when(count <= 0, F.array().cast("array<int>")).when(count <= limit, F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1)))).otherwise(chosen)


def quality_stages(rows: DataFrame) -> DataFrame:
    """Reports (kind, status, exists, characters, lines, level, risks, complex, table_ok, ocr_ok, image_ok, layout_known, assets, missing_assets) with the seven stages as columns and the route they lead to."""
    c = F.col
    risk = lambda x: F.array_contains("risks", x)
    empty = risk("empty_document") | (c("characters") == 0) | (c("lines") == 0)
    picture = c("kind").isin("mixed_image", "image_set")
    scan = picture | (c("kind") == "scanned_pdf")
    layout = picture | c("kind").isin("text_pdf", "scanned_pdf")
    rows = rows.withColumns(
        {
            "parse": F.when((c("status").isin("failed", "error", "blocked")) | ~c("exists") | empty, "blocked").otherwise("passed"),
            "layout": F.when(~layout, "not_applicable").when(risk("heading_hierarchy_missing") | c("complex") | (picture & ~c("layout_known")), "degraded").otherwise("passed"),
            "image": F.when(~scan, "not_applicable").when(c("image_ok"), "passed").otherwise("degraded"),
            "table_stage": F.when(~risk("table_structure_risk"), "not_applicable").when(c("table_ok"), "passed").otherwise("degraded"),
            "ocr": F.when(~scan, "not_applicable").when(risk("ocr_low_confidence"), "degraded").when(c("ocr_ok"), "passed").when((c("kind") == "scanned_pdf") & (~c("exists") | empty), "blocked").otherwise("degraded"),
            "asset": F.when(~picture, "not_applicable").when((c("assets") > 0) & (c("missing_assets") == 0), "passed").otherwise("degraded"),
            "markdown": F.when(~c("exists") | empty, "blocked").when((c("level") == "good") & ~risk("heading_hierarchy_missing") & ~risk("page_number_noise"), "passed").otherwise("degraded"),
        }
    )
    stages = F.array("parse", "layout", "image", "table_stage", "ocr", "asset", "markdown")
    route = F.when(F.array_contains(stages, "blocked"), "blocked").when(F.array_contains(stages, "degraded"), "degraded").otherwise("minimal-deliverable")
    return rows.withColumn("route", route)


def with_fallback(rows: DataFrame, capabilities: Column) -> DataFrame:
    """Rows of quality_stages(): the first fallback whose capability is ready, and a blocked route that has one is proposed."""
    c = F.col
    ready = lambda k: F.coalesce(F.try_element_at(capabilities, F.lit(k)), F.lit("missing")).isin("ok", "ready", "available")
    wanted = (
        ("local_ocr", (c("kind") == "scanned_pdf") & ((c("parse") == "blocked") | (c("ocr") == "blocked"))),
        ("pdf_structure_recovery", c("layout") == "degraded"),
        ("pdf_table_extraction", c("table_stage") == "degraded"),
        ("markitdown_baseline", (c("kind") == "office") & (c("parse") == "blocked")),
    )
    found = F.when(F.lit(False), F.lit(""))
    for name, test in wanted:
        found = found.when(test & ready(name), name)
    rows = rows.withColumn("fallback", found)
    return rows.withColumn("route", F.when((c("route") == "blocked") & c("fallback").isNotNull(), "fallback-proposed").otherwise(c("route")))


def validated(rows: DataFrame, payload: str = "payload", item: str = "blocks", version: str = "layout-candidates-v1") -> DataFrame:
    """rows with the errors of their JSON payloads: unreadable, wrong version, pages that are no list, items that are no list."""
    v = F.try_parse_json(F.col(payload))
    field = lambda path, kind: F.try_variant_get(v, path, kind)
    pages = field("$.pages", "array<variant>")
    bad = F.exists(F.coalesce(pages, F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, f"$.{item}", "string").isNotNull() & F.try_variant_get(p, f"$.{item}", "array<variant>").isNull())
    errors = F.when(v.isNull(), F.array(F.lit("not_json"))).otherwise(
        F.array_compact(F.array(F.when(F.coalesce(field("$.schema_version", "string"), F.lit("")) != version, "schema_version"), F.when(pages.isNull(), "pages_not_a_list"), F.when(bad, "items_not_a_list")))
    )
    return rows.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)


def visual_regions(cells: DataFrame, image: str = "image", limit: int = 40) -> DataFrame:
    """Connected regions of active grid cells (image, row, col), neighbours sharing a side: image, n, top, left, bottom, right, cells.

    Labels spread to the smallest of the four neighbours until none changes, within one image's grid.
    """

    def of_image(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        grid = np.full((r.max() - r.min() + 3, c.max() - c.min() + 3), np.iinfo(np.int64).max)
        y, x = r - r.min() + 1, c - c.min() + 1
        grid[y, x] = y * grid.shape[1] + x
        active = grid < np.iinfo(np.int64).max
        while True:
            low = np.minimum.reduce([grid, np.roll(grid, 1, 0), np.roll(grid, -1, 0), np.roll(grid, 1, 1), np.roll(grid, -1, 1)])
            low[~active] = np.iinfo(np.int64).max
            if (low == grid).all():
                break
            grid = low
        out = pd.DataFrame({"label": grid[y, x], "row": r, "col": c}).drop_duplicates().groupby("label").agg(top=("row", "min"), left=("col", "min"), bottom=("row", "max"), right=("col", "max"), cells=("row", "size"))
        out = out.sort_values(["top", "left"]).head(limit).reset_index(drop=True)
        out.insert(0, image, pdf[image].iloc[0])
        out.insert(1, "n", range(1, len(out) + 1))
        return out

    kind = dict(cells.dtypes)[image]
    return cells.groupBy(image).applyInPandas(of_image, f"{image} {kind}, n int, top int, left int, bottom int, right int, cells int")
