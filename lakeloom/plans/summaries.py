"""Queries of the summaries, on runs derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as s
from . import derived
from .derived import LINES_SQL, RUNS_SQL
from .registry import query, table

_MAP = "array_to_string(list_sort(list(concat(k, '=', n))), ', ')"


@query(
    RUNS_SQL
    + f""", counted AS (SELECT kind, level AS k, count(*) AS n FROM runs WHERE level IS NOT NULL GROUP BY ALL)
SELECT kind, {_MAP} AS levels, count(*) AS different FROM counted GROUP BY kind"""
)
def nested_counts(spark, folder):
    """Counts of a nested field, rendered."""
    rows = s.count_map(derived.runs(spark, folder), ["kind"], F.col("level"), "levels")
    return rows.select("kind", s.rendered(F.col("levels")).alias("levels"), F.size("levels").cast("long").alias("different"))


_OCR = """count(*) AS samples, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (chars = 0) AS empty, round(count(*) FILTER (chars = 0) / count(*)::DOUBLE, 4) AS empty_rate, round(sum(seconds), 4) AS total_seconds, round(sum(seconds) / count(*), 4) AS avg_seconds,
 sum(chars)::BIGINT AS total_chars, round(sum(chars) / count(*)::DOUBLE, 2) AS avg_chars, sum(blocks)::BIGINT AS total_blocks, round(sum(blocks) / count(*)::DOUBLE, 2) AS avg_blocks, sum(boxes)::BIGINT AS total_boxes, coalesce(round(sum(boxes) / nullif(sum(blocks), 0)::DOUBLE, 4), 0) AS box_coverage"""


@query(RUNS_SQL + f"SELECT provider, {_OCR} FROM runs GROUP BY provider")
def ocr_providers(spark, folder):
    """OCR items of each provider."""
    return s.ocr_items(derived.runs(spark, folder), "provider")


@query(RUNS_SQL + f"SELECT coalesce(category, 'unknown') AS category, {_OCR} FROM runs GROUP BY ALL")
def ocr_categories(spark, folder):
    """OCR items of each category."""
    return s.ocr_items(derived.runs(spark, folder).fillna("unknown", ["category"]), "category")


@query(
    RUNS_SQL
    + """SELECT job, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status IN ('failed', 'timeout')) AS hard_failed, count(*) FILTER (status IS NULL OR status = 'skipped') AS other, sum(table_lines)::BIGINT AS review_items, sum(artifacts)::BIGINT AS artifact_reads FROM runs GROUP BY job"""
)
def batch_totals(spark, folder):
    """Outcome of the runs of each job."""
    rows = derived.runs(spark, folder).withColumns({"review_items": F.col("table_lines"), "artifact_reads": F.col("artifacts")})
    return s.batch_summary(rows, "job")


@query(
    RUNS_SQL
    + """SELECT provider, count(*) AS total, round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 3) AS success_rate, round(count(*) FILTER (artifacts > 3) / count(*)::DOUBLE, 3) AS artifact_read_rate, round(sum(seconds) / count(*), 3) AS avg_seconds, round(max(seconds), 3) AS max_seconds FROM runs GROUP BY provider"""
)
def load_test(spark, folder):
    """Rates and times of a load test."""
    return s.load_summary(derived.runs(spark, folder).withColumn("artifact_read", F.col("artifacts") > 3), "provider")


@query(
    RUNS_SQL
    + f""", kinds AS (SELECT job, {_MAP} AS types FROM (SELECT job, coalesce(nullif(provider, ''), 'unknown') AS k, count(*) AS n FROM runs GROUP BY ALL) GROUP BY job),
fails AS (SELECT job, list(path ORDER BY id) AS failed_paths FROM (SELECT job, id, concat('a/', id) AS path FROM runs WHERE status IS DISTINCT FROM 'ok' QUALIFY row_number() OVER (PARTITION BY job ORDER BY id) <= 20) GROUP BY job),
totals AS (SELECT job, count(*) AS total, count(*) FILTER (status = 'ok') AS ok FROM runs GROUP BY job)
SELECT t.job, total, ok, total - ok AS failed, types, coalesce(failed_paths, []) AS failed_paths FROM totals t JOIN kinds k ON k.job = t.job LEFT JOIN fails f ON f.job = t.job"""
)
def artifact_totals(spark, folder):
    """Artifacts of each job by type, and the first failures."""
    rows = derived.runs(spark, folder).select("job", F.col("provider").alias("type"), "status", F.concat(F.lit("a/"), "id").alias("path"), F.col("id").alias("ordinal"))
    return s.artifact_summary(rows, "job").withColumn("types", s.rendered(F.col("types")))


@query(
    RUNS_SQL
    + """, sums AS (SELECT job, count(*) FILTER (status IN ('failed', 'timeout')) AS h, count(*) FILTER (status = 'review') AS r, sum(table_lines) AS ri, count(*) FILTER (status IS DISTINCT FROM 'ok' AND artifacts > 5) AS f, min(id) AS m FROM runs GROUP BY job),
why AS (SELECT job, list_filter([CASE WHEN m % 2 = 0 THEN 'partial_run' END, CASE WHEN h > 20 THEN 'hard_failed_jobs' END, CASE WHEN r > 11 THEN 'review_jobs' END, CASE WHEN ri > 350 THEN 'review_items' END, CASE WHEN f > 6 THEN 'artifact_read_failures' END, CASE WHEN m % 3 = 0 THEN 'quality_regression' END], lambda x: x IS NOT NULL) AS reasons FROM sums)
SELECT job, reasons, len(reasons) > 0 AS needs_attention FROM why"""
)
def batch_attention(spark, folder):
    """Why a batch needs a look."""
    hard = F.col("status").isin("failed", "timeout")
    rows = derived.runs(spark, folder).groupBy("job").agg(
        (F.count_if(hard) - 20).alias("hard_failed"), (F.count_if(F.col("status") == "review") - 11).alias("review"), (F.sum("table_lines") - 350).alias("review_items"),
        (F.count_if((F.coalesce("status", F.lit("")) != "ok") & (F.col("artifacts") > 5)) - 6).alias("failed"), F.min("id").alias("m"),
    )
    rows = rows.withColumns({"partial": F.col("m") % 2 == 0, "comparison": F.when(F.col("m") % 3 == 0, "failed").otherwise("passed")})
    return s.attention(rows).select("job", "reasons", "needs_attention")


_QUALITY = """, leveled AS (SELECT *, CASE WHEN status IN ('ok', 'review') THEN 'ok' ELSE coalesce(status, 'unknown') END AS state, coalesce(level, CASE WHEN status = 'review' THEN 'review' WHEN status = 'ok' THEN 'good' END) AS lv FROM runs),
reports AS (SELECT kind, count(*) AS total, count(lv) AS scored, count(*) FILTER (lv IN ('review', 'poor')) AS review_or_poor, count(*) FILTER (state = 'ok') AS n_ok, count(*) FILTER (state = 'timeout') AS n_timeout, count(*) FILTER (state = 'failed') AS n_failed, count(*) FILTER (provider = 'umi') AS fallbacks,
 round(sum(headings) / count(*)::DOUBLE, 3) AS avg_headings, round(sum(seconds) / count(*), 3) AS avg_seconds, min(id) AS first_id FROM leveled GROUP BY kind) """


def _reports(spark, folder):
    rows = derived.runs(spark, folder).withColumn("pipeline", F.when(F.col("provider") == "umi", "Umi (Fallback)").otherwise("fast"))
    return s.batch_quality(rows, "kind")


@query(RUNS_SQL + _QUALITY + "SELECT * EXCLUDE (first_id) FROM reports")
def batch_quality(spark, folder):
    """Quality report of each kind of runs."""
    return _reports(spark, folder)


_RATES = "round(n_ok / total::DOUBLE, 3) AS success_rate, round(greatest(scored - review_or_poor, 0) / scored::DOUBLE, 3) AS good_rate, round(review_or_poor / scored::DOUBLE, 3) AS review_poor_rate, round(n_timeout / total::DOUBLE, 3) AS timeout_rate, round(n_failed / total::DOUBLE, 3) AS failed_rate"


@query(RUNS_SQL + _QUALITY + f"SELECT kind, {_RATES} FROM reports")
def comparison_rates(spark, folder):
    """Rates of a quality report."""
    return s.comparison_metrics(_reports(spark, folder)).select("kind", *(m for m, _, _ in s.CHECKS))


_SIDE = "SELECT kind, round(count(*) FILTER (status IN ('ok', 'review')) / count(*)::DOUBLE, 3) AS success_rate, round(count(*) FILTER (lv = 'good') / count(lv)::DOUBLE, 3) AS good_rate, round(count(*) FILTER (lv IN ('review', 'poor')) / count(lv)::DOUBLE, 3) AS review_poor_rate, round(count(*) FILTER (status = 'timeout') / count(*)::DOUBLE, 3) AS timeout_rate, round(count(*) FILTER (status = 'failed') / count(*)::DOUBLE, 3) AS failed_rate FROM leveled WHERE {} GROUP BY kind"


@query(
    RUNS_SQL
    + _QUALITY
    + f", a AS ({_SIDE.format('id % 2 = 0')}), b AS ({_SIDE.format('id % 2 = 1')}), "
    + "deltas AS ("
    + " UNION ALL ".join(f"SELECT a.kind, '{m}' AS metric, round(b.{m} - a.{m}, 4) AS delta, round(b.{m} - a.{m}, 4) {'>=' if least else '<='} 0 AS passed FROM a JOIN b ON a.kind = b.kind" for m, least, _ in s.CHECKS)
    + ") SELECT * FROM deltas"
)
def regression_checks(spark, folder):
    """Changes of the rates between two halves of the runs, and whether they pass."""
    rows = derived.runs(spark, folder).withColumn("pipeline", F.lit(""))
    half = lambda k: s.comparison_metrics(s.batch_quality(rows.filter(F.col("id") % 2 == k), "kind"))
    return s.regression_checks(half(0), half(1), "kind")


@query(
    RUNS_SQL
    + """, rates AS (SELECT user_bucket, count(*) AS samples, round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 3) AS success_rate, round(count(*) FILTER (status = 'ok' AND level = 'good') / count(*)::DOUBLE, 3) AS good_rate FROM (SELECT *, score % 40 AS user_bucket FROM runs WHERE NOT (score % 40 < 10 AND status IS DISTINCT FROM 'ok')) GROUP BY user_bucket)
SELECT *, CASE WHEN success_rate >= 0.8 AND good_rate >= 0.6 THEN 'enable_docling_for_docling_formats' WHEN success_rate >= 0.5 THEN 'keep_optional_collect_more' ELSE 'keep_optional' END AS decision FROM rates"""
)
def backend_policy(spark, folder):
    """Whether an optional backend is to be the default."""
    rows = derived.runs(spark, folder).withColumn("user_bucket", F.col("score") % 40)
    return s.policy(rows.filter(~((F.col("user_bucket") < 10) & (F.coalesce("status", F.lit("")) != "ok"))), "user_bucket")


@query(
    RUNS_SQL
    + """SELECT kind, count(*) AS decisions, count(*) FILTER (level = 'good') AS promoted, count(*) FILTER (score / 100.0 < 0.65) AS low_confidence FROM runs GROUP BY kind"""
)
def repair_metrics(spark, folder):
    """Structure decisions, promotions and those of low confidence."""
    rows = derived.runs(spark, folder).select("kind", F.when(F.col("level") == "good", "promoted_to_heading").otherwise("kept").alias("action"), (F.col("score") / 100.0).alias("confidence"))
    return s.repair_metrics(rows, "kind")


@query(RUNS_SQL + "SELECT id, CASE WHEN expected_lines > 0 THEN round(least(table_lines / expected_lines::DOUBLE, 1.0), 3) ELSE 0 END AS retention FROM runs")
def table_retention(spark, folder):
    """Share of the expected table lines that are there."""
    return derived.runs(spark, folder).select("id", s.retention(F.col("table_lines"), F.col("expected_lines")).alias("retention"))


@query(
    RUNS_SQL
    + """SELECT grp, CASE WHEN bool_or(coalesce(status = 'failed', false)) THEN 'failed' WHEN bool_or(coalesce(status = 'ok', false)) THEN 'ok' WHEN bool_or(coalesce(status = 'skipped', false)) THEN 'planned' ELSE 'skipped' END AS status FROM (SELECT id // 3 AS grp, status FROM runs) GROUP BY grp"""
)
def group_states(spark, folder):
    """State of groups of runs by priority."""
    rows = derived.runs(spark, folder).select(F.floor(F.col("id") / 3).alias("grp"), F.when(F.col("status") == "skipped", "planned").otherwise(F.col("status")).alias("status"))
    return s.status_of(rows, ("failed", "ok", "planned"), "grp")


@query(
    RUNS_SQL
    + """SELECT kind, count(*) AS manifest_jobs, count(*) FILTER (status IN ('failed', 'review')) AS selected, round(count(*) FILTER (status IN ('failed', 'review')) / count(*)::DOUBLE, 4) AS selection_ratio FROM runs GROUP BY kind"""
)
def job_selection(spark, folder):
    """Jobs chosen for another run."""
    rows = derived.runs(spark, folder)
    return s.selection(rows, rows.filter(F.col("status").isin("failed", "review")), "kind")


@query(RUNS_SQL + "SELECT job, arg_max(status, id) FILTER (status IS NOT NULL) AS status, max(id) FILTER (status IS NOT NULL) AS id, arg_max(seconds, id) FILTER (status IS NOT NULL) AS seconds FROM runs GROUP BY job")
def latest_runs(spark, folder):
    """The last run of each job that has a status."""
    return s.latest(derived.runs(spark, folder).select("job", "id", "status", "seconds").filter("status is not null"), "job", "id")


@query(
    RUNS_SQL
    + """, jobs AS (SELECT id AS ordinal, CASE WHEN id % 50 = 0 THEN '' WHEN id % 31 = 0 THEN 'same' ELSE concat('j', id) END AS jid, CASE WHEN id % 45 = 0 THEN NULL ELSE 'p' END AS path FROM runs), counted AS (SELECT *, count(*) OVER (PARTITION BY jid) AS n FROM jobs),
bad AS (SELECT ordinal, jid, path, list_filter([CASE WHEN jid = '' THEN 'missing_id' END, CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN path IS NULL THEN 'missing_input' END], lambda x: x IS NOT NULL) AS problems FROM counted) SELECT * FROM bad WHERE len(problems) > 0"""
)
def manifest_problems(spark, folder):
    """Jobs of a manifest with missing or repeated ids or no input."""
    i = F.col("id")
    rows = derived.runs(spark, folder).select(i.alias("ordinal"), F.when(i % 50 == 0, "").when(i % 31 == 0, "same").otherwise(F.concat(F.lit("j"), i)).alias("jid"), F.when(i % 45 != 0, "p").alias("path"))
    return s.invalid_jobs(rows, "jid", "path")


@query(
    RUNS_SQL
    + """SELECT provider, count(*) AS evidence, sum(blocks)::BIGINT AS blocks, sum(table_lines)::BIGINT AS table_lines, bool_or(artifacts = 6 AND headings = 2) AS has_layout, bool_or(blocks > 9) AS has_table, coalesce(list_sort(list(DISTINCT category) FILTER (category <> '')), []) AS artifact_types, list_sort(list(DISTINCT status) FILTER (status <> '')) AS statuss FROM runs GROUP BY provider"""
)
def backend_signals(spark, folder):
    """Evidence of each backend."""
    rows = derived.runs(spark, folder).withColumns({"artifact_type": F.col("category"), "has_layout": (F.col("artifacts") == 6) & (F.col("headings") == 2), "has_table": F.col("blocks") > 9})
    return s.signals(rows, "provider", ["blocks", "table_lines"], ["has_layout", "has_table"])


@query(
    RUNS_SQL
    + """SELECT kind, count(*) AS backends, coalesce(list_sort(list(DISTINCT job) FILTER (st = 'ok')), []) AS ready, coalesce(list_sort(list(DISTINCT job) FILTER (st = 'missing')), []) AS missing, coalesce(list_sort(list(DISTINCT job) FILTER (st = 'ok' AND score >= 75)), []) AS recommended FROM (SELECT *, coalesce(status, 'missing') AS st FROM runs WHERE id < 2000) GROUP BY kind"""
)
def backend_lists(spark, folder):
    """The ready, missing and recommended backends of the first two thousand runs."""
    rows = derived.runs(spark, folder).filter("id < 2000").withColumnRenamed("job", "name")
    return s.backend_summary(rows, "kind")


@query(
    """WITH recs AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS provider, CASE WHEN turn % 4 = 1 THEN 'failed' WHEN turn % 4 = 2 THEN NULL ELSE 'ok' END AS status, list_transform(string_split(text, chr(10)), lambda t: {'text': t, 'b': length(t) % 2 = 0}) AS blocks FROM conversations)
SELECT conv_id, count(*) AS records, coalesce(list_sort(list(DISTINCT provider) FILTER (provider <> '')), []) AS providers, sum(len(blocks))::BIGINT AS blocks, sum(len(list_filter(blocks, lambda b: b.b)))::BIGINT AS boxes, sum(list_sum(list_transform(blocks, lambda b: length(b.text))))::BIGINT AS chars, count(*) FILTER (coalesce(status, 'ok') = 'ok') AS ok FROM recs GROUP BY conv_id"""
)
def ocr_records(spark, folder):
    """Providers, blocks, boxes and characters of OCR records."""
    box = lambda t: F.when(F.length(t) % 2 == 0, F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    rows = table(spark, folder, "conversations").select(
        "conv_id", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("provider"), F.when(F.col("turn") % 4 == 1, "failed").when(F.col("turn") % 4 != 2, "ok").alias("status"),
        F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text"), box(t).alias("bbox"))).alias("blocks"),
    )
    return s.block_records(rows, "conv_id")


@query(
    """SELECT conv_id, turn, length(trim(text)) AS char_count, len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')) AS line_count, len(string_split(text, chr(10))) AS block_count, len(list_filter(string_split(text, chr(10)), lambda x: length(x) % 2 = 0)) AS bbox_count, trim(text) = '' AS empty, left(trim(text), 120) AS text_preview FROM conversations"""
)
def ocr_item_counters(spark, folder):
    """Counters of OCR items."""
    box = lambda t: F.when(F.length(t) % 2 == 0, F.array(F.lit(0)))
    rows = table(spark, folder, "conversations").withColumn("blocks", F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text"), box(t).alias("bbox"))))
    return s.item_counters(rows, "text", "blocks").select("conv_id", "turn", "char_count", "line_count", "block_count", "bbox_count", "empty", "text_preview")


@query(LINES_SQL + "SELECT doc_id, length(text) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#'))) AS headings, contains(text, '|') AND contains(text, '---') AS has_table FROM marked")
def response_hints(spark, folder):
    """What a model's Markdown holds."""
    return derived.marked_documents(spark, folder).select("doc_id", s.response_hints(F.col("text")).alias("h")).select("doc_id", "h.*")


@query(
    RUNS_SQL
    + f""", judged AS (SELECT *, coalesce(level, coalesce(status, 'unknown')) AS lv, CASE WHEN id % 25 = 0 THEN 'low_alignment' ELSE 'ok' END AS outline FROM runs), bad AS (SELECT *, lv IN ('review', 'poor', 'failed') OR coalesce(status, '') = 'failed' OR outline = 'low_alignment' AS b FROM judged),
levels AS (SELECT job, {_MAP} AS levels FROM (SELECT job, lv AS k, count(*) AS n FROM bad GROUP BY ALL) GROUP BY job), firsts AS (SELECT job, list(id ORDER BY id) AS review_ids FROM (SELECT job, id FROM bad WHERE b QUALIFY row_number() OVER (PARTITION BY job ORDER BY id) <= 20) GROUP BY job)
SELECT t.job, total, review_count, levels, review_ids FROM (SELECT job, count(*) AS total, count(*) FILTER (b) AS review_count FROM bad GROUP BY job) t JOIN levels l ON l.job = t.job LEFT JOIN firsts f ON f.job = t.job"""
)
def conversion_reviews(spark, folder):
    """Levels of each job's conversions and the first to review."""
    rows = derived.runs(spark, folder).withColumn("outline", F.when(F.col("id") % 25 == 0, "low_alignment").otherwise("ok"))
    return s.review_summary(rows, "job").withColumn("levels", s.rendered(F.col("levels")))
