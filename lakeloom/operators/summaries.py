"""Summaries of runs, OCR items, comparisons, artifacts and elements: counts, guarded rates and priority states, by partial sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_unknown, ratio

OK, HARD = ("ok", "review"), ("failed", "timeout", "unsupported", "no_job")


def count_map(rows: DataFrame, keys: list[str], c: Column, name: str = "counts") -> DataFrame:
    """Number of rows of each value of c, as a map in the values' order, for each group of keys. Partial counts come first, so a group holds one entry for each value."""
    each = rows.groupBy(*keys, c.alias("key")).agg(F.count("*").alias("value")).filter("key is not null")
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))


def rendered(counts: Column) -> Column:
    """`a=1, b=2` of a map of counts, n/a of an empty one."""
    parts = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("n/a")


def average(total: Column, n: Column, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.try_divide(total.cast("double"), n.cast("double")), digits), F.lit(0.0))


def ocr_items(items: DataFrame, *keys: str) -> DataFrame:
    """OCR items (status, chars, blocks, boxes, seconds) per group: counts, rates, averages and box coverage."""
    n, s = F.count("*"), F.sum
    empty = F.count_if(F.coalesce("chars", F.lit(0)) == 0)
    return items.groupBy(*keys).agg(
        n.alias("samples"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        empty.alias("empty"),
        average(empty, n, 4).alias("empty_rate"),
        F.round(s("seconds"), 4).alias("total_seconds"),
        average(s("seconds"), n, 4).alias("avg_seconds"),
        s("chars").alias("total_chars"),
        average(s("chars"), n, 2).alias("avg_chars"),
        s("blocks").alias("total_blocks"),
        average(s("blocks"), n, 2).alias("avg_blocks"),
        s("boxes").alias("total_boxes"),
        average(s("boxes"), s("blocks"), 4).alias("box_coverage"),
    )


def batch_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs (status, review_items, artifact_reads) per group: ok, review, hard failures and the rest."""
    state = or_unknown("status")
    ok, review, hard = F.count_if(state == "ok"), F.count_if(state == "review"), F.count_if(state.isin(*HARD))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("total"), ok.alias("ok"), review.alias("review"), hard.alias("hard_failed"), (F.count("*") - ok - review - hard).alias("other"),
        F.sum("review_items").alias("review_items"), F.sum("artifact_reads").alias("artifact_reads"),
    )


def load_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs (status, seconds, artifact_read) of a load test: rates and times."""
    n = F.count("*")
    return runs.groupBy(*keys).agg(
        n.alias("total"),
        ratio(F.count_if(F.col("status") == "ok"), n).alias("success_rate"),
        ratio(F.count_if("artifact_read"), n).alias("artifact_read_rate"),
        average(F.sum("seconds"), n).alias("avg_seconds"),
        F.round(F.max("seconds"), 3).alias("max_seconds"),
    )


def artifact_summary(artifacts: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Artifacts (type, status, path) per job batch: totals, and the first failures in their order."""
    ok = F.col("status") == "ok"
    failures = artifacts.filter(~F.coalesce(ok, F.lit(False))).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))).filter(F.col("rank") <= most)
    failures = failures.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("failed_paths"))
    totals = artifacts.groupBy(key).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    kinds = count_map(artifacts, [key], or_unknown("type"), "types")
    return totals.withColumn("failed", F.col("total") - F.col("ok")).join(kinds, key, "left").join(failures, key, "left").withColumn("failed_paths", F.coalesce("failed_paths", F.array().cast("array<string>")))


def attention(summary: DataFrame) -> DataFrame:
    """Reasons why a batch (hard_failed, review, review_items, failed, comparison, partial) needs a look."""
    tests = (
        ("partial_run", F.col("partial")),
        ("hard_failed_jobs", F.col("hard_failed") > 0),
        ("review_jobs", F.col("review") > 0),
        ("review_items", F.col("review_items") > 0),
        ("artifact_read_failures", F.col("failed") > 0),
        ("quality_regression", F.col("comparison") == "failed"),
    )
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
    return summary.withColumn("reasons", reasons).withColumn("needs_attention", F.size("reasons") > 0)


def batch_quality(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs (status, level, pipeline, seconds) as a quality report: a run without a level counts as good if ok, as review if so."""
    state = F.when(F.col("status").isin(*OK), "ok").otherwise(or_unknown("status"))
    level = F.coalesce("level", F.when(F.col("status") == "review", "review").when(F.col("status") == "ok", "good"))
    rows = runs.withColumns({"_state": state, "_level": level})
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("total"),
        F.count("_level").alias("scored"),
        F.count_if(F.col("_level").isin("review", "poor")).alias("review_or_poor"),
        *(F.count_if(F.col("_state") == s).alias(f"n_{s}") for s in ("ok", "timeout", "failed")),
        F.count_if(F.lower(F.coalesce("pipeline", F.lit(""))).contains("fallback")).alias("fallbacks"),
        average(F.sum("headings"), n).alias("avg_headings"),
        average(F.sum("seconds"), n).alias("avg_seconds"),
    )


def comparison_metrics(reports: DataFrame) -> DataFrame:
    """Rates of a quality report (total, scored, review_or_poor, n_ok, n_timeout, n_failed)."""
    c = F.col
    good = F.greatest(c("scored") - c("review_or_poor"), F.lit(0))
    rates = {
        "success_rate": ratio(c("n_ok"), c("total")),
        "good_rate": ratio(good, c("scored")),
        "review_poor_rate": ratio(c("review_or_poor"), c("scored")),
        "timeout_rate": ratio(c("n_timeout"), c("total")),
        "failed_rate": ratio(c("n_failed"), c("total")),
    }
    return reports.withColumns(rates)


#: Checks of a comparison: metric, whether the change must be at least (or at most) the threshold, threshold.
CHECKS = (("success_rate", True, 0.0), ("good_rate", True, 0.0), ("review_poor_rate", False, 0.0), ("timeout_rate", False, 0.0), ("failed_rate", False, 0.0))


def regression_checks(baseline: DataFrame, candidate: DataFrame, key: str, checks=CHECKS) -> DataFrame:
    """One row for each key and check: the change of the metric from the baseline (0 where there is none) and whether it passes."""
    both = baseline.select(key, *(F.col(m).alias(f"_b_{m}") for m, _, _ in checks)).join(candidate.select(key, *(F.col(m).alias(f"_c_{m}") for m, _, _ in checks)), key, "full_outer")
    rows = []
    for m, least, limit in checks:
        delta = F.round(F.coalesce(f"_c_{m}", F.lit(0.0)) - F.coalesce(f"_b_{m}", F.lit(0.0)), 4)
        rows.append(F.struct(F.lit(m).alias("metric"), delta.alias("delta"), (delta >= limit if least else delta <= limit).alias("passed")))
    return both.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")


def policy(results: DataFrame, *keys: str) -> DataFrame:
    """Whether an optional backend is to be the default, by its runs' rates of success and of good quality."""
    n = F.count("*")
    rows = results.groupBy(*keys).agg(n.alias("samples"), ratio(F.count_if(F.col("status") == "ok"), n).alias("success_rate"), ratio(F.count_if((F.col("status") == "ok") & (F.col("level") == "good")), n).alias("good_rate"))
    choice = F.when((F.col("success_rate") >= 0.8) & (F.col("good_rate") >= 0.6), "enable_docling_for_docling_formats").when(F.col("success_rate") >= 0.5, "keep_optional_collect_more").otherwise("keep_optional")
    return rows.withColumn("decision", choice)


def repair_metrics(decisions: DataFrame, *keys: str) -> DataFrame:
    """Structure decisions (action, confidence) per group: all, promoted and of low confidence."""
    return decisions.groupBy(*keys).agg(F.count("*").alias("decisions"), F.count_if(F.col("action") == "promoted_to_heading").alias("promoted"), F.count_if(F.col("confidence") < 0.65).alias("low_confidence"))


def retention(actual: Column, expected: Column) -> Column:
    """Share of the expected table lines that are there, 1 at most, 0 without an expectation."""
    return F.when(expected > 0, F.round(F.least(actual / expected, F.lit(1.0)), 3)).otherwise(0.0)


def status_of(rows: DataFrame, order: tuple[str, ...], *keys: str, otherwise: str = "skipped") -> DataFrame:
    """The first status in the order that any row of a group has."""
    has = {s: F.max(F.col("status") == s) for s in order}
    pick = reduce(lambda acc, s: acc.when(has[s], s), order[1:], F.when(has[order[0]], order[0]))
    return rows.groupBy(*keys).agg(pick.otherwise(otherwise).alias("status"))


def selection(jobs: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Jobs of a manifest and those chosen, per key: counts and their ratio."""
    rows = jobs.groupBy(key).agg(F.count("*").alias("manifest_jobs")).join(chosen.groupBy(key).agg(F.count("*").alias("selected")), key, "left").fillna(0, ["selected"])
    return rows.withColumn("selection_ratio", ratio(F.col("selected"), F.col("manifest_jobs"), 4))


def latest(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("r")).select(key, "r.*")


def invalid_jobs(jobs: DataFrame, key: str, path: str) -> DataFrame:
    """Jobs of a manifest with what is wrong: no id, a repeated id, no input. Repetitions come from counts by id, so a common id is one small row."""
    counts = jobs.groupBy(key).agg(F.count("*").alias("_n"))
    rows = jobs.join(counts, key, "left")
    tests = (("missing_id", F.coalesce(F.col(key), F.lit("")) == ""), ("duplicate_id", F.col("_n") > 1), ("missing_input", F.coalesce(F.col(path), F.lit("")) == ""))
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).filter(F.size("problems") > 0).drop("_n")


def signals(items: DataFrame, key: str, sums: list[str], flags: list[str]) -> DataFrame:
    """Evidence rows per backend: sums of signals, whether any has a flag, the different artifact types and statuses."""
    sets = [F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}s") for c in ("artifact_type", "status")]
    return items.groupBy(key).agg(F.count("*").alias("evidence"), *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in flags), *sets)


def backend_summary(backends: DataFrame, *keys: str) -> DataFrame:
    """Scored backends (name, status, gate, score): the ready, the missing and those to recommend."""
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("name"))))
    status = F.coalesce("status", F.lit("missing"))
    return backends.groupBy(*keys).agg(
        F.count("*").alias("backends"), names(status == "ok").alias("ready"), names(status == "missing").alias("missing"), names((status == "ok") & (F.col("score") >= 75)).alias("recommended")
    )


def block_records(records: DataFrame, key: str) -> DataFrame:
    """OCR records (provider, status, blocks: [{text, bbox}]) per key: providers, blocks, boxes and characters."""
    size = lambda test: F.sum(F.size(F.filter("blocks", test)))
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.length(F.coalesce(b["text"], F.lit(""))))
    return records.groupBy(key).agg(
        F.count("*").alias("records"),
        F.array_sort(F.collect_set(F.nullif("provider", F.lit("")))).alias("providers"),
        F.sum(F.size("blocks")).alias("blocks"),
        size(lambda b: b["bbox"].isNotNull()).alias("boxes"),
        F.sum(chars).alias("chars"),
        F.count_if(F.coalesce("status", F.lit("ok")) == "ok").alias("ok"),
    )


def item_counters(items: DataFrame, text: str, blocks: str) -> DataFrame:
    """OCR items with their counters: characters, lines, blocks, boxes, a preview."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    return items.withColumns(
        {
            "char_count": F.length(t),
            "line_count": F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")),
            "block_count": F.size(blocks),
            "bbox_count": F.size(F.filter(blocks, lambda b: b["bbox"].isNotNull())),
            "empty": t == "",
            "text_preview": F.substring(t, 1, 120),
        }
    )


def response_hints(markdown: Column) -> Column:
    """What a model's Markdown holds: characters, headings, a table."""
    headings = F.size(F.filter(F.split(markdown, "\n"), lambda x: F.ltrim(x).startswith("#")))
    return F.struct(F.length(markdown).alias("chars"), headings.alias("headings"), (markdown.contains("|") & markdown.contains("---")).alias("has_table"))


def review_summary(runs: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Conversions (level, status, outline) per key: counts of levels, reviews and the first ids to review."""
    level = F.coalesce("level", F.coalesce("status", F.lit("unknown")))
    bad = level.isin("review", "poor", "failed") | (F.coalesce("status", F.lit("")) == "failed") | F.coalesce("outline", F.lit("")).isin("low_alignment", "no_markdown_headings")
    rows = runs.withColumns({"_level": level, "_bad": bad})
    first = rows.filter("_bad").withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("_rank") <= most)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("review_ids"))
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if("_bad").alias("review_count")).join(count_map(rows, [key], F.col("_level"), "levels"), key, "left").join(first, key, "left")
