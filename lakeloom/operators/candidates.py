"""Candidate artifacts of backends and what is reviewed with them: lookups by key and alias, first-kept sets, signals, review matrices, orders.

Sets that keep the first of equal rows take the smallest ordinal by key (min_by with partial sums), so a common key is one small row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import backend_name
from ..functions.headings import heading_key
from ..functions.text import or_unknown, ratio
from .decisions import named
from .summaries import retention

# Ranks of the orders, roles of table and formula artifacts.
LEVEL_RANK = {"good": 0, "ok": 1, "review": 2, "poor": 3, "failed": 4}
MATCH_RANK = {"exact": 0, "all_terms": 1, "partial_terms": 2, "unknown": 3}
GATE_RANK = {"plan_or_fix_environment_first": 0, "review_only": 1, "compare_on_shared_manifest": 2, "do_not_promote": 3}
TABLE_ROLES = {"table_html": "has_html", "table_markdown": "has_markdown", "table_cells_json": "has_cells_json", "table_overlay": "has_overlay", "table_image": "has_table_image"}
FORMULA_ROLES = {"formula_source": "has_source_ref", "formula_crop": "has_crop", "formula_markdown": "has_markdown", "formula_bbox": "has_bbox", "formula_confidence": "has_confidence"}


def _rank(c: Column, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def first_kept(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key, by the ordinal."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(ordinal)).alias("_r")).select(*keys, "_r.*")


def unique_strings(values: Column) -> Column:
    """Different values in their order, trimmed, without blank ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def appended(values: Column, value: Column) -> Column:
    """A list with one more value, unless it is blank or there already."""
    skip = F.coalesce(value, F.lit("")) == ""
    return F.when(skip | F.array_contains(values, value), values).otherwise(F.concat(values, F.array(value)))


def unique_records(rows: DataFrame, ordinal: str) -> DataFrame:
    """Rows that no earlier row equals in all other columns."""
    return first_kept(rows, [c for c in rows.columns if c != ordinal], ordinal)


def unique_formulas(rows: DataFrame, key: str) -> DataFrame:
    """Formulas (ordinal, latex, bbox) with text, once for each text and box, numbered in their order."""
    kept = first_kept(rows.withColumn("latex", F.trim("latex")).filter("latex <> ''"), [key, "latex", "bbox"], "ordinal")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("ordinal")))


def unique_titles(rows: DataFrame, key: str, title: Column) -> DataFrame:
    """Titles of a contents list (ordinal) once for each heading key, none over 120 characters."""
    rows = rows.withColumn("title", title).filter((F.col("title") != "") & (F.length("title") <= 120)).withColumn("key", heading_key("title"))
    return first_kept(rows.select(key, "key", "ordinal", "title"), [key, "key"], "ordinal")


def best_candidates(rows: DataFrame, key: str) -> DataFrame:
    """The best heading candidate (title, score, ordinal) of each heading key: highest score, then first."""
    keyed = rows.withColumn("key", heading_key("title")).filter("key <> ''")
    return keyed.groupBy(key, "key").agg(F.max_by("title", F.struct("score", -F.col("ordinal"))).alias("title"), F.max("score").alias("score"), F.count("*").alias("candidates"))


def with_candidates(lines: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """Lines (title) with the candidate of their heading key."""
    return lines.withColumn("key", heading_key("title")).join(best.select(key, "key", F.col("title").alias("candidate"), "score"), [key, "key"], "left")


def rerun_arguments(jobs: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Jobs (arguments: map) whose arguments what a previous run recommended (recommended: map) overrides."""
    rows = jobs.join(previous.select(key, "recommended"), key, "left")
    old = F.map_filter("arguments", lambda k, _: ~F.map_contains_key(F.coalesce("recommended", F.create_map().cast("map<string,string>")), k))
    return rows.withColumn("arguments", F.map_concat(old, F.coalesce("recommended", F.create_map().cast("map<string,string>")))).drop("recommended")


def matched_samples(queries: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Queries (sample_id, source) with the sample (id, path, ordinal) that fits best: its id, then its whole path, then its name; the first of equals."""
    name = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1))
    found = None
    for rank, (left, right) in enumerate(((F.col("sample_id"), F.col("id")), (F.lower("source"), F.lower("path")), (name(F.col("source")), name(F.col("path"))))):
        firsts = samples.withColumn("_k", right).filter("_k <> ''").groupBy("_k").agg(F.min_by("id", "ordinal").alias("match"))
        hit = queries.withColumn("_k", left).join(firsts, "_k").select(key, F.lit(rank).alias("rank"), "match")
        found = hit if found is None else found.union(hit)
    best = found.groupBy(key).agg(F.min_by("match", "rank").alias("match"))
    return queries.join(best, key, "left")


def by_alias(profiles: DataFrame, evidence: DataFrame, key: str, path: str) -> DataFrame:
    """Evidence (backend, path) of profiles (aliases: array), each path once for a profile: key, paths."""
    names = profiles.select(key, F.explode(F.array_distinct(F.transform("aliases", backend_name))).alias("_b"))
    found = names.join(evidence.select(backend_name("backend").alias("_b"), path), "_b").select(key, path).distinct()
    paths = found.groupBy(key).agg(F.array_sort(F.collect_list(path)).alias("paths"))
    return profiles.join(paths, key, "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def scored_profiles(profiles: DataFrame, kinds: list[str]) -> DataFrame:
    """Profiles (base score, counts of evidence of each kind) with five points for each kind of evidence, 100 at most."""
    extra = sum((F.when(F.col(k) > 0, 5).otherwise(0) for k in kinds), F.lit(0))
    return profiles.withColumn("score", F.least(F.lit(100), F.col("base") + extra))


def enriched(metrics: DataFrame, expectations: DataFrame, key: str) -> DataFrame:
    """Metrics (table_lines) with the expected table lines and how many of them are there."""
    rows = metrics.join(expectations.select(key, "expected_lines"), key, "left").fillna(0, ["expected_lines"])
    return rows.withColumn("retention", retention(F.col("table_lines"), F.col("expected_lines")))


def artifact_union(fixed: DataFrame, referenced: DataFrame) -> DataFrame:
    """Artifacts (type, path) of both, each once."""
    return fixed.select("type", "path").unionByName(referenced.select("type", "path")).dropDuplicates(["type", "path"])


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def layout_signals(blocks: Column) -> Column:
    """Labels, boxes and overlays among a page's blocks (label, bbox, overlay)."""
    n = lambda test: F.size(F.filter(blocks, test))
    return F.struct(n(lambda b: _given(b["label"])).alias("labels"), n(lambda b: b["bbox"].isNotNull()).alias("boxes"), n(lambda b: _given(b["overlay"])).alias("overlays"))


def table_signals(tables: Column) -> Column:
    """What a page's tables (html, markdown, cells, overlay, bbox) bring."""
    n = lambda test: F.size(F.filter(tables, test))
    has = lambda field: lambda t: _given(t[field])
    return F.struct(*(n(has(f)).alias(f) for f in ("html", "markdown", "cells", "overlay")), n(lambda t: t["bbox"].isNotNull()).alias("bbox"))


def formula_signals(formulas: Column, page_source: Column) -> Column:
    """What a page's formulas (latex, markdown, bbox, source, confidence) bring; how many of the five there are at all."""
    n = lambda test: F.size(F.filter(formulas, test))
    counts = [n(lambda f: _given(f["latex"])), n(lambda f: _given(f["markdown"])), n(lambda f: f["bbox"].isNotNull()), n(lambda f: page_source | _given(f["source"])), n(lambda f: f["confidence"].isNotNull())]
    complete = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    return F.struct(*(c.alias(k) for c, k in zip(counts, ("latex", "markdown", "bbox", "source", "confidence"), strict=True)), complete.alias("completeness"))


def text_characters(items: Column) -> Column:
    """Characters of items' texts, Markdown and LaTeX."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.aggregate(items, F.lit(0), lambda s, i: s + size(i["text"]) + size(i["markdown"]) + size(i["latex"]))


def listed_or_counted(items: Column, count: Column) -> Column:
    """Number of listed items, or the count that a page states where none is listed."""
    return F.coalesce(F.nullif(F.size(items), F.lit(0)), count, F.lit(0))


def review_pages(entries: DataFrame) -> DataFrame:
    """Review entries (locator, page, backend, type, blocks, tables, formulas) per locator: sums, backends and types, counts by backend, what to review."""
    t = lambda c: F.coalesce(F.col(c), F.lit(0))
    by = entries.groupBy("locator", "backend").agg(F.max("page").alias("page"), *(F.sum(t(c)).alias(c) for c in ("blocks", "tables", "formulas")), F.collect_set("type").alias("types"))
    some = lambda c: F.array_sort(F.collect_list(F.when((F.col(c) > 0) & _given(F.col("backend")), F.struct("backend", c))))
    rows = by.groupBy("locator").agg(
        F.max("page").alias("page"),
        F.array_sort(F.collect_set(F.nullif(F.col("backend"), F.lit("")))).alias("backends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
        *(F.sum(c).alias(f"{c[:-1]}_count") for c in ("blocks", "tables", "formulas")),
        F.map_from_entries(some("tables")).alias("tables_by_backend"),
        F.map_from_entries(some("formulas")).alias("formulas_by_backend"),
    )
    return rows.withColumn("targets", named(("layout_blocks", F.col("block_count") > 0), ("table_candidates", F.col("table_count") > 0), ("formula_candidates", F.col("formula_count") > 0)))


def page_order(page: Column, locator: Column) -> list[Column]:
    return [F.coalesce(page, F.lit(1_000_000)).asc(), locator.asc()]


def table_matrix(refs: DataFrame) -> DataFrame:
    """Artifacts (locator, backend, role, tables) of tables by page and backend: what each has, what is missing, how complete it is."""
    rows = refs.withColumn("backend", or_unknown("backend")).groupBy("locator", "backend").agg(
        F.max(F.coalesce("tables", F.lit(0))).alias("table_count"), F.count_if(F.col("role").startswith("table_")).alias("artifact_refs"), *(F.coalesce(F.max(F.col("role") == r), F.lit(False)).alias(c) for r, c in TABLE_ROLES.items())
    )
    some, readable = F.col("table_count") > 0, F.col("has_html") | F.col("has_markdown")
    missing = named(("table_overlay", some & ~F.col("has_overlay")), ("table_cells_json", some & ~F.col("has_cells_json")), ("table_html_or_markdown", some & ~readable))
    present = readable.cast("int") + F.col("has_cells_json").cast("int") + F.col("has_overlay").cast("int")
    return rows.withColumns({"missing_evidence": missing, "completeness": F.when(some, F.round(present / 3, 3)).otherwise(0.0)})


def table_conflicts(matrix: DataFrame) -> DataFrame:
    """A page's rows of the table matrix as one: whether backends agree, and what speaks against a promotion."""
    some = F.col("table_count") > 0
    rows = matrix.groupBy("locator").agg(
        F.count("*").alias("backends"),
        F.countDistinct(F.when(some, F.col("table_count"))).alias("_different"),
        F.max(some & ~F.col("has_overlay")).alias("_overlay"),
        F.max(some & ~F.col("has_cells_json")).alias("_cells"),
        F.max(some & ~(F.col("has_html") | F.col("has_markdown"))).alias("_readable"),
        F.max(some).alias("_cards"),
        F.round(F.max("completeness"), 3).alias("best_completeness"),
        F.count_if(some & (F.col("completeness") < 1)).alias("incomplete"),
    )
    tags = named(
        ("single_backend_only", F.col("backends") < 2), ("table_count_disagreement", F.col("_different") > 1), ("missing_overlay_evidence", F.col("_overlay")), ("missing_cells_json", F.col("_cells")),
        ("missing_readable_table_output", F.col("_readable")), ("card_layout_review_required", F.col("_cards")),
    )
    rows = rows.withColumns({"agrees": F.col("_different") <= 1, "conflict_tags": tags})
    choice = F.when(F.size("conflict_tags") > 0, "review_conflicts_before_promotion").otherwise("table_evidence_ready_for_scorecard_comparison")
    return rows.withColumn("recommendation", choice).drop("_different", "_overlay", "_cells", "_readable", "_cards")


def formula_matrix(refs: DataFrame) -> DataFrame:
    """Artifacts (locator, backend, role, formulas, latex) of formulas by page and backend, and warnings about what is missing."""
    rows = refs.withColumn("backend", or_unknown("backend")).groupBy("locator", "backend").agg(
        F.max(F.coalesce("formulas", F.lit(0))).alias("formula_count"), F.sum(F.coalesce("latex", F.lit(0))).alias("latex_count"), *(F.coalesce(F.max(F.col("role") == r), F.lit(False)).alias(c) for r, c in FORMULA_ROLES.items())
    )
    some = F.col("formula_count") > 0
    warnings = named(
        ("missing_latex_or_markdown", some & (F.col("latex_count") == 0)), ("missing_formula_bbox", some & ~F.col("has_bbox")), ("missing_formula_source_ref", some & ~(F.col("has_source_ref") | F.col("has_crop"))),
        ("missing_formula_confidence", some & ~F.col("has_confidence")), ("check_formula_retention", some),
    )
    return rows.withColumn("warnings", warnings)


def matrix_signals(matrix: DataFrame) -> DataFrame:
    """Signals of a row of the table matrix: how many of four kinds of evidence there are."""
    kinds = ("has_html", "has_markdown", "has_cells_json", "has_overlay")
    return matrix.withColumn("evidence_kinds", sum((F.col(c).cast("int") for c in kinds), F.lit(0))).withColumn("missing_count", F.size("missing_evidence"))


def academic_evidence(items: DataFrame, *keys: str) -> DataFrame:
    """Items (kind: grobid or formula, title, doi, references, formulas, latex, boxes, status) per group: sums and what is missing."""
    g, f = F.col("kind") == "grobid", F.col("kind") == "formula"
    lack = lambda c: F.coalesce(F.sum(F.when(f, F.greatest(F.col("formulas") - F.col(c), F.lit(0)))), F.lit(0))
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    return items.groupBy(*keys).agg(
        F.count_if(g).alias("grobid_sources"), F.count_if(g & _given(F.col("title"))).alias("titles"), F.count_if(g & _given(F.col("doi"))).alias("dois"), total(g, "references").alias("references"),
        F.count_if(f).alias("formula_sources"), total(f, "formulas").alias("formulas"), lack("boxes").alias("missing_bbox"), lack("latex").alias("missing_latex"),
        F.coalesce(F.max(g & (F.col("status") != "ok")), F.lit(False)).alias("needs_followup"),
    )


def review_counts(items: DataFrame, key: str) -> DataFrame:
    """Items (type, backend, blocks, tables, formulas) per bundle: sums, backends, types."""
    return items.groupBy(key).agg(
        F.count("*").alias("artifacts"), F.array_sort(F.collect_set(F.nullif(F.col("backend"), F.lit("")))).alias("backends"), F.array_sort(F.collect_set(or_unknown("type"))).alias("types"),
        *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("blocks", "tables", "formulas")),
    )


def row_order(level: Column, score: Column, risks: Column, name: Column) -> list[Column]:
    return [_rank(level, LEVEL_RANK, 5).asc(), F.coalesce(score, F.lit(0)).desc(), risks.asc(), name.asc()]


def match_order(quality: Column, hits: Column, source: Column, page: Column) -> list[Column]:
    return [_rank(quality, MATCH_RANK, 9).asc(), hits.desc(), source.asc(), F.coalesce(page, F.lit(0)).asc()]


def summary_order(status: Column, score: Column) -> list[Column]:
    """Failures first, then the worst score; none and 0 come last."""
    return [(F.coalesce(status, F.lit("")) != "failed").asc(), F.coalesce(F.nullif(score, F.lit(0)), F.lit(999)).asc()]


def gate_order(decision: Column, backend: Column) -> list[Column]:
    return [_rank(decision, GATE_RANK, 9).asc(), backend.asc()]


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def limit_of(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(1)), F.lit(200))


def newest(rows: DataFrame, keys: list[str], modified: str, most: int = 1) -> DataFrame:
    """The rows of each key that were modified last."""
    return ranked(rows, keys, [F.col(modified).desc()]).filter(F.col("rank") <= most).drop("rank")


def first_artifact(artifacts: Column, kind: str) -> Column:
    """The path of the first artifact (type, path) of a kind that has one."""
    return F.get(F.filter(artifacts, lambda a: (a["type"] == kind) & _given(a["path"])), F.lit(0))["path"]


def first_with_path(items: DataFrame, key: str, focus: str, path: str) -> DataFrame:
    """The first item (ordinal, focus) of a focus that has a path."""
    rows = items.filter((F.col("focus") == focus) & _given(F.col(path)))
    return rows.groupBy(key).agg(F.min_by(path, "ordinal").alias(path))


def block_rows(pages: DataFrame, items: str, kind: str, parent: bool = False) -> DataFrame:
    """Items of candidate pages (source, page, items: [{text, bbox, confidence}]) as blocks with an id, the page's ordinal and the kind."""
    each = pages.select("source", "page", F.posexplode(items).alias("_i", "_b"))
    name = F.concat_ws(":", "source", F.lit(kind), F.col("page").cast("string"), (F.col("_i") + 1).cast("string"))
    rows = each.select(name.alias("block_id"), "source", "page", F.lit(kind).alias("kind"), (F.col("_i") + 1).alias("ordinal"), F.coalesce("_b.text", F.lit("")).alias("text"), F.col("_b.bbox").alias("bbox"), F.col("_b.confidence").alias("confidence"))
    return rows if not parent else rows.withColumn("parent_id", F.concat_ws(":", "source", F.lit("table"), F.col("page").cast("string"), F.lit("1")))


def block_totals(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks per source: by kind, without a box, without a confidence."""
    kinds = blocks.groupBy(key, "kind").agg(F.count("*").alias("n"), F.count_if(F.col("bbox").isNull() | (F.size("bbox") == 0)).alias("b"), F.count_if(F.col("confidence").isNull()).alias("c"))
    return kinds.groupBy(key).agg(
        F.sum("n").alias("blocks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"), F.sum("b").alias("missing_bbox"), F.sum("c").alias("missing_confidence"),
        F.max(F.col("kind").isin("table", "formula")).alias("needs_review"),
    )


def contents_match(titles: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Share of a contents list's titles that a document's headings have, by heading key."""
    have = headings.select(key, heading_key("title").alias("k")).filter("k <> ''").distinct()
    want = titles.select(key, heading_key("title").alias("k")).filter("k <> ''").distinct()
    hit = want.join(have.withColumn("hit", F.lit(1)), [key, "k"], "left")
    return hit.groupBy(key).agg(F.count("*").alias("titles"), F.count("hit").alias("matched"), ratio(F.count("hit"), F.count("*")).alias("match_ratio"))
