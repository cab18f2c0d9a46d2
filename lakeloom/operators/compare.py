"""Comparisons of runs and records: diffs, winners, gates, regressions, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio

MARGIN, HIGH_MARGIN = 3.0, 8.0


def field_severity(field: Column, before: Column, after: Column) -> Column:
    """info, warning or error for a changed field."""
    was, now = F.coalesce(before, F.lit("")).contains("ok"), F.coalesce(after, F.lit("")).contains("ok")
    states = F.when(was & ~now, "error").when(~was & now, "info").otherwise("warning")
    return F.when(field.isin("status", "import_status"), states).when(field.isin("version", "path"), "warning").otherwise("info")


def record_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, before, after, severity of the differences of two record sets: one full outer join, fields as rows."""
    a = before.select(key, F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields)).alias("a"))
    b = after.select(key, F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields)).alias("b"))
    both = a.join(b, key, "full_outer")
    gone, new = F.col("b").isNull(), F.col("a").isNull()
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").alias("before"), F.col(f"b.{c}").alias("after")) for c in fields]
    whole = F.array(F.struct(F.lit("record").alias("field"), F.col("a")[fields[0]].alias("before"), F.col("b")[fields[0]].alias("after")))
    rows = both.select(key, gone.alias("gone"), new.alias("new"), F.explode(F.when(gone | new, whole).otherwise(F.array(*cells))).alias("d"))
    rows = rows.filter(F.col("gone") | F.col("new") | (F.col("d.before") != F.col("d.after")))
    severity = F.when(F.col("gone"), "error").when(F.col("new"), "warning").otherwise(field_severity(F.col("d.field"), F.col("d.before"), F.col("d.after")))
    return rows.select(key, "d.*", severity.alias("severity"))


def winner(rows: DataFrame, group: str, *, minimum: float, order: Sequence[Column]) -> DataFrame:
    """Best row of each group with the margin to the next: group, pipeline, score, runner_up, margin, auto_accept, confidence."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), *order)
    # the limit of two works before the shuffle, so a group's rows never meet in one task
    two = rows.select(group, "pipeline", "score", F.row_number().over(w).alias("rank")).filter("rank <= 2")
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    ranked = two.groupBy(group).agg(at(1, "pipeline").alias("pipeline"), at(1, "score").alias("score"), at(2, "score").alias("runner_up"))
    margin = F.round(F.col("score") - F.col("runner_up"), 3)
    accept = (F.col("score") >= minimum) & F.coalesce(margin >= MARGIN, F.lit(True))
    sure = F.when(~accept, "low").when(F.coalesce(margin >= HIGH_MARGIN, F.lit(True)), "high").otherwise("medium")
    return ranked.select(group, "pipeline", "score", "runner_up", margin.alias("margin"), accept.alias("auto_accept"), sure.alias("confidence"))


def gates(rows: DataFrame, minimums: dict[str, float], maximums: dict[str, float]) -> DataFrame:
    """name, actual, threshold, passed of the rate gates over rows (status, level)."""
    n, scored = F.count("*"), F.count("level")
    rates = {
        "success_rate": ratio(F.count_if(F.col("status") == "ok"), n),
        "timeout_rate": ratio(F.count_if(F.col("status") == "timeout"), n),
        "failed_rate": ratio(F.count_if(F.col("status") == "failed"), n),
        "good_rate": ratio(F.count_if(F.col("level") == "good"), scored),
        "review_poor_rate": ratio(F.count_if(F.col("level").isin("review", "poor")), scored),
    }
    one = rows.agg(*(c.alias(k) for k, c in rates.items()))
    checks = [F.struct(F.lit(k).alias("name"), F.col(k).alias("actual"), F.lit(float(t)).alias("threshold"), (F.col(k) >= t).alias("passed")) for k, t in minimums.items()]
    checks += [F.struct(F.lit(k).alias("name"), F.col(k).alias("actual"), F.lit(float(t)).alias("threshold"), (F.col(k) <= t).alias("passed")) for k, t in maximums.items()]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, baseline, candidate, delta of two tables of metrics (name, value); a missing metric counts as 0."""
    joined = before.select("name", F.col("value").alias("baseline")).join(after.select("name", F.col("value").alias("candidate")), "name", "full_outer").fillna(0.0)
    return joined.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 3))


def regression_tags(metrics: DataFrame) -> DataFrame:
    """The tags that one row of deltas (a map d) earns."""
    d = lambda k: F.coalesce(F.try_element_at("d", F.lit(k)), F.lit(0.0))
    tags = F.array_compact(
        F.array(
            F.when((d("avg_headings") <= -0.5) | (d("avg_toc_match_ratio") <= -0.1) | (d("page_heading_ratio") >= 0.1) | (d("review_poor_rate") >= 0.05), "structure_regression"),
            F.when(d("ocr_characters") <= -50, "ocr_regression"),
            F.when((d("table_retention_ratio") <= -0.1) | (d("table_like_lines") <= -2), "table_regression"),
            F.when((d("avg_duration_seconds") >= 1.0) | (d("max_duration_seconds") >= 2.0), "duration_regression"),
        )
    )
    return metrics.withColumn("tags", tags)


def coverage(rows: DataFrame, expected: Column, present: Column) -> DataFrame:
    """Row-wise set comparison: found, missing, extra, complete."""
    return rows.withColumns({"found": F.array_intersect(expected, present), "missing": F.array_except(expected, present), "extra": F.array_except(present, expected)}).withColumn("complete", F.size("missing") == 0)


def disambiguated(rows: DataFrame, name: str, order: str, parts: int = 32) -> DataFrame:
    """rows with output: the name, or the name with -2, -3, … for its later occurrences (case does not count).

    A common name is numbered in parts: ranges of the order column (numeric), whose counts by name tell where each part begins.
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    part = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    keyed = rows.withColumns({"_key": low, "_part": part})
    counts = keyed.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_key", "_part", before.alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_part").orderBy(order))
    numbered = keyed.join(starts, ["_key", "_part"]).withColumn("_nth", nth)
    return numbered.withColumn("output", F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("_nth").cast("string")))).drop("_key", "_part", "_before", "_nth")


def stratified(rows: DataFrame, category: str, order: str, per_category: int) -> DataFrame:
    """The first rows of each category."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(order))).filter(F.col("_n") <= per_category).drop("_n")
