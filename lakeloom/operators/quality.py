"""Markdown quality: counters, score, level, risks and queues. All of it works on in-row arrays, without a shuffle.

Lines and counters are made once for a row, behind a barrier (see functions.text.once), whatever is filtered or read later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headings import repeated_key
from ..functions.text import count_where, nonblank, once, ratio

GOOD, REVIEW = 85, 65


def _noise(items: Column) -> Column:
    """Sum of the counts of the keys that stand four times or more."""
    keys = F.array_sort(F.filter(F.transform(items, repeated_key), lambda k: k != ""))
    start = F.struct(F.lit("").alias("key"), F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(acc, key):
        run = F.when(acc["key"] == key, acc["run"] + 1).otherwise(1)
        # the fourth of a run brings its three predecessors along
        total = acc["total"] + F.when(run == 4, 4).when(run > 4, 1).otherwise(0)
        return F.struct(key.alias("key"), run.alias("run"), total.alias("total"))

    return F.aggregate(keys, start, step, lambda a: a["total"])


def counters(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counters of the quality score."""
    items = F.col("_lines")
    rows = once(docs, {"_lines": nonblank(text)})
    body = F.coalesce(F.col(text), F.lit(""))
    low = lambda x: x < ":"  # noqa: E731  begins with a digit or a mark before them; a cheap test ahead of the patterns
    rows = once(
        rows,
        {
            "characters": F.length(body).cast("long"),
            "nonempty_lines": F.size(items),
            "headings": count_where(items, lambda x: x.startswith("#") & x.rlike(r"^#{1,6}\s+\S")),
            "page_headings": count_where(items, lambda x: x.startswith("#") & x.rlike(r"(?i)^#{1,6}\s+(page|第?\s*\d+\s*页|p\.?\s*\d+)\b")),
            "page_number_lines": count_where(items, lambda x: (low(x) | x.startswith("第")) & x.rlike(r"^(第\s*)?\d{1,4}\s*(页)?$")),
            "footnote_like_lines": count_where(items, lambda x: ((low(x) | x.startswith("[")) & x.rlike(r"^(\[\^?\d+\]|\(\d+\)|\d+[.、])")) | x.contains("脚注") | x.contains("注释")),
            "html_tag_lines": count_where(items, lambda x: x.contains("<") & x.rlike(r"(?i)</?(div|span|p|br|html|body|section|aside|st)\b")),
            "table_like_lines": count_where(items, lambda x: (x.contains("|") & x.rlike(r"\|.*\|")) | x.contains("\t")),
            "replacement_chars": F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit(""))),
            "_short": count_where(items, lambda x: (F.length(x) <= 8) & ~x.rlike(r"^#{1,6}\s+")),
            "repeated_noise_lines": _noise(items),
        },
    )
    rows = rows.withColumn("short_line_ratio", ratio(F.col("_short"), F.greatest(F.col("nonempty_lines"), F.lit(1))))
    return rows.drop("_lines", "_short")


#: (reason, condition, points lost) of the score; the order is that of the reasons.
def _rules() -> list[tuple[str, Column, Column]]:
    c = F.col
    lines = F.greatest(c("nonempty_lines"), F.lit(1))
    return [
        ("short_output", c("characters") < 500, F.lit(45)),
        ("no_headings", (c("headings") == 0) & (c("characters") >= 1000), F.lit(25)),
        ("page_like_headings", (c("headings") > 0) & (c("page_headings") / F.greatest(c("headings"), F.lit(1)) > 0.7), F.lit(25)),
        ("page_numbers", c("page_number_lines") / lines > 0.08, F.lit(12)),
        ("footnotes", c("footnote_like_lines") / lines > 0.18, F.lit(10)),
        ("html_residue", c("html_tag_lines") > 0, F.least(F.lit(15), c("html_tag_lines"))),
        ("replacement_characters", c("replacement_chars") > 0, F.least(F.lit(20), c("replacement_chars"))),
        ("short_lines", (c("short_line_ratio") > 0.45) & (c("nonempty_lines") > 30), F.lit(10)),
        ("repeated_noise", c("repeated_noise_lines") >= 4, F.least(F.lit(12), F.floor(c("repeated_noise_lines") / 2).cast("int"))),
    ]


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """counters() with score (0 to 100), level and reasons."""
    rows = counters(docs, text)
    lost = F.lit(0)
    for _, test, points in _rules():
        lost = lost + F.when(test, points).otherwise(0)
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int"))
    rows = rows.withColumn("level", F.when(F.col("score") >= GOOD, "good").when(F.col("score") >= REVIEW, "review").otherwise("poor"))
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(test, name) for name, test, _ in _rules()))))


def risks(rows: DataFrame) -> DataFrame:
    """Rows of scored() with the array of risk codes; an empty document has no other risk."""
    c = F.col
    empty = (c("characters") == 0) | (c("nonempty_lines") == 0)
    noisy = (c("page_number_lines") / F.greatest(c("nonempty_lines"), F.lit(1)) > 0.08) | (c("repeated_noise_lines") >= 4)
    others = F.array_compact(F.array(F.when((c("characters") >= 500) & (c("headings") == 0), "heading_hierarchy_missing"), F.when(noisy, "page_number_noise"), F.when(c("table_like_lines") > 0, "table_structure_risk")))
    return rows.withColumn("risks", F.when(empty, F.array(F.lit("empty_document"))).otherwise(others))


def issue_categories(rows: DataFrame) -> DataFrame:
    """Rows of scored() with issue categories and the focus that comes first among them."""
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("headings") == 0, "weak_heading_structure"),
            F.when((c("short_line_ratio") >= 0.35) | (c("replacement_chars") > 0) | F.array_contains("reasons", "short_lines"), "ocr_noise_or_linebreaks"),
            F.when(c("html_tag_lines") > 0, "html_or_toc_residue"),
            F.when(c("page_number_lines") > 0, "page_number_noise"),
            F.when(c("table_like_lines") > 0, "table_or_layout_review"),
        )
    )
    rows = rows.withColumn("categories", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("manual_review_unknown"))))
    has = lambda x: F.array_contains("categories", x)
    focus = F.when(has("weak_heading_structure"), "structure_repair").when(has("ocr_noise_or_linebreaks"), "ocr_cleanup").when(has("html_or_toc_residue"), "markdown_cleanup").when(has("table_or_layout_review"), "table_layout_review").otherwise("manual_review")
    return rows.withColumn("focus", focus)


def queue(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that need work, with the ranks by which the queue is read."""
    todo = issue_categories(rows.filter(F.col("level").isin("review", "poor", "failed")))
    rank = F.when(F.col("level") == "failed", 0).when(F.col("level") == "poor", 1).otherwise(2)
    order = F.when(F.col("focus") == "structure_repair", 0).when(F.col("focus") == "ocr_cleanup", 1).when(F.col("focus") == "markdown_cleanup", 2).when(F.col("focus") == "table_layout_review", 3).otherwise(4)
    return todo.withColumns({"level_rank": rank, "focus_rank": order})
