"""Layout of pages from their blocks and words: columns, edges, images, difficulty, evidence and the reviews it calls for.

A page's blocks are an array in its row (at most what one page holds), so its tests are array functions without a shuffle;
documents are groups of such pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.text import collapse, compact, ratio

# Block kinds of layout models.
TITLES = ("title", "doc_title", "paragraph_title")
PICTURES = ("image", "image_body", "chart", "chart_body", "seal", "header_image", "footer_image")
TABLES = ("table", "table_body")
FURNITURE = ("header", "footer", "page_number", "page_header", "page_footer")
FOOTNOTES = ("footnote", "page_footnote", "image_footnote", "table_footnote", "chart_footnote")


def two_columns(blocks: Column, width: Column) -> Column:
    """Eight blocks or more, three on either side, and a gutter wider than 4 % of the page."""
    middle, half = lambda b: (b["x1"] + b["x2"]) / 2, width / 2
    left = F.filter(blocks, lambda b: middle(b) < half * 0.9)
    right = F.filter(blocks, lambda b: middle(b) > half * 1.1)
    gutter = F.array_min(F.transform(right, lambda b: b["x1"])) - F.array_max(F.transform(left, lambda b: b["x2"]))
    return F.coalesce((F.size(blocks) >= 8) & (F.size(left) >= 3) & (F.size(right) >= 3) & (gutter > width * 0.04), F.lit(False))


def word_columns(words: Column, width: Column) -> Column:
    """Forty words or more, twelve on either side and few in the middle."""
    place = F.transform(words, lambda w: (w["x1"] + w["x2"]) / 2)
    left, right = F.size(F.filter(place, lambda c: c < width * 0.42)), F.size(F.filter(place, lambda c: c > width * 0.58))
    between = F.size(place) - left - right
    return (F.size(words) >= 40) & (left >= 12) & (right >= 12) & (between <= F.greatest(F.lit(10), F.floor((left + right) * 0.25).cast("int")))


def slide_aspect(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0) & F.try_divide(width, height).between(1.28, 1.9), F.lit(False))


def area(block: Column) -> Column:
    return F.greatest(F.lit(0.0), block["x2"] - block["x1"]) * F.greatest(F.lit(0.0), block["y2"] - block["y1"])


def image_share(images: Column, width: Column, height: Column) -> Column:
    """Share of the page under images, 1 at most."""
    total = F.aggregate(images, F.lit(0.0), lambda s, b: s + area(b))
    return F.round(F.least(total / F.greatest(width * height, F.lit(1.0)), F.lit(1.0)), 3)


def noise_text(text: Column) -> Column:
    return collapse(text, 120)


def edge_texts(words: Column, height: Column) -> Column:
    """Texts in the upper and lower 8 % of a page."""
    edge = F.filter(words, lambda w: (w["y1"] <= height * 0.08) | (w["y2"] >= height * 0.92))
    return F.filter(F.transform(edge, lambda w: noise_text(w["text"])), lambda t: t != "")


def repeated_edges(pages: DataFrame, key: str, texts: str, most: int = 10) -> DataFrame:
    """The texts that stand at the edges of a document's pages twice or more, the `most` commonest: key, text, count."""
    counts = pages.select(key, F.explode(texts).alias("text")).groupBy(key, "text").agg(F.count("*").alias("count")).filter((F.col("count") >= 2) & (F.length("text") >= 2))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "text"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def kind_counts(blocks: Column) -> Column:
    """Number of blocks of each kind, as a map."""
    kinds = F.transform(blocks, lambda b: b["kind"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value"))))


def difficulty(blocks: Column, index: Column, width: Column, height: Column) -> Column:
    """Score and reasons of a page that is hard to read by machine, by ten rules."""
    of = lambda *names: F.size(F.filter(blocks, lambda b: b["kind"].isin(*names)))
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    visual = F.aggregate(F.filter(blocks, lambda b: b["kind"].isin(*PICTURES, *TABLES)), F.lit(0.0), lambda s, b: s + area(b)) / (width * height)
    chars = F.length(compact(text))
    rules = (
        ("cover-like", (index <= 2) & (visual > 0.25), F.lit(4)),
        ("toc/index", (of("index") > 0) | predicates.contents_lines(text), F.lit(5)),
        ("visual-heavy", visual > 0.45, F.lit(4)),
        ("table", of(*TABLES) >= 1, F.lit(4)),
        ("many-titles", of(*TITLES) >= 5, F.lit(3)),
        ("low-text-with-visual", (chars < 80) & (visual > 0.15), F.lit(3)),
        ("page-furniture", of(*FURNITURE) >= 2, F.lit(2)),
        ("footnotes", of(*FOOTNOTES) > 0, F.least(F.lit(3), of(*FOOTNOTES))),
        ("many-short-lines", predicates.short_lines(text), F.lit(2)),
        ("ocr-noise", predicates.odd_characters(text), F.lit(2)),
    )
    score = F.lit(0)
    for _, test, points in rules:
        score = score + F.when(test, points).otherwise(0)
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test, _ in rules)))
    return F.struct(score.alias("score"), reasons.alias("reasons"), chars.alias("text_chars"))


def preflight_pages(pages: DataFrame) -> DataFrame:
    """Page rows (text, blocks, images, width, height) with what preflight() of a document sums up."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return pages.withColumns(
        {
            "chars": F.length(text),
            "toc_like": predicates.toc_page(text),
            "table_like": predicates.table_page(text),
            "two_column": two_columns(F.col("blocks"), F.col("width")),
            "image_ratio": image_share(F.col("images"), F.col("width"), F.col("height")),
            "slide": slide_aspect(F.col("width"), F.col("height")),
            "n_blocks": F.size("blocks"),
        }
    )


def positive_median(values: Column) -> Column:
    """Exact median of the positive values, 10 without any."""
    known = F.array_sort(F.filter(values, lambda x: x > 0))
    n = F.size(known)
    upper, lower = F.get(known, F.floor(n / 2).cast("int")), F.get(known, F.floor((n - 1) / 2).cast("int"))
    return F.coalesce((upper + lower) / 2, F.lit(10.0))


def layout_evidence(pages: DataFrame, key: str) -> DataFrame:
    """Page rows (text_chars, line_count, table_count, image_count, two_column, repeated) per document: sums, flags, what to review and why."""
    n = F.count("*")
    rows = pages.groupBy(key).agg(
        n.alias("page_count"),
        *(F.sum(c).alias(c) for c in ("text_chars", "line_count", "table_count", "image_count")),
        F.array_sort(F.collect_list(F.when(F.col("table_count") > 0, F.col("page")))).alias("table_pages"),
        F.array_sort(F.collect_list(F.when(F.col("two_column"), F.col("page")))).alias("two_column_pages"),
        F.array_sort(F.collect_list(F.when((F.col("image_count") >= 1) & (F.col("text_chars") < 200), F.col("page")))).alias("image_heavy_pages"),
        F.max("repeated").alias("repeated_noise"),
    )
    some = lambda c: F.size(c) > 0
    rows = rows.withColumn("avg_chars", F.round(F.col("text_chars") / F.col("page_count"), 2))
    rows = rows.withColumns(
        {
            "text_layer_present": F.col("text_chars") > 0,
            "low_text_density": F.col("avg_chars") < 80,
            "layout_heavy_suspected": some("two_column_pages") | some("image_heavy_pages") | (F.col("repeated_noise") > 0),
            "table_heavy_suspected": some("table_pages"),
            "review_needed": some("table_pages") | some("two_column_pages") | some("image_heavy_pages") | (F.col("repeated_noise") > 0),
        }
    )
    named = lambda c, name: F.when(some(c), F.concat(F.lit(f"{name}: "), F.array_join(F.transform(F.slice(c, 1, 30), lambda p: p.cast("string")), ", ")))
    reasons = F.array_compact(F.array(named("table_pages", "table pages"), named("two_column_pages", "two-column pages"), named("image_heavy_pages", "image-heavy pages"), F.when(F.col("repeated_noise") > 0, "repeated header or footer")))
    return rows.withColumn("review_reasons", reasons)


def text_layer_change(pages: DataFrame, key: str, stage: str, chars: str) -> DataFrame:
    """Sampled pages before and after a text layer was made (stage before, after): ratios, averages and what was added."""
    at = lambda name, x: F.when(F.col(stage) == name, x)
    agg = []
    for name in ("before", "after"):
        pages_of = F.count(at(name, F.lit(1)))
        agg += [ratio(F.count_if((F.col(stage) == name) & (F.col(chars) >= 80)), pages_of).alias(f"{name}_ratio"), F.round(F.avg(at(name, F.col(chars))), 1).alias(f"{name}_avg"), F.coalesce(F.sum(at(name, F.col(chars))), F.lit(0)).alias(f"{name}_chars")]
    rows = pages.groupBy(key).agg(*agg)
    return rows.withColumns(
        {
            "ratio_delta": F.round(F.col("after_ratio") - F.col("before_ratio"), 3),
            "avg_delta": F.round(F.col("after_avg") - F.col("before_avg"), 1),
            "characters_added": F.greatest(F.col("after_chars") - F.col("before_chars"), F.lit(0)),
        }
    )


def vlm_candidates(pages: DataFrame, key: str, page: str, text: str, most: int, least_chars: int, mode: str = "auto") -> DataFrame:
    """The first `most` pages of each document that a vision model should see, in page order, with the reasons."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    if mode == "never" or most <= 0:
        return pages.select(key, page).limit(0).withColumn("reasons", F.array().cast("array<string>"))
    if mode == "always":
        reasons = F.array(F.lit("vlm_mode_always"))
    else:
        tests = (("low_ocr_text", F.length(compact(body)) < max(1, least_chars)), ("fragmented_short_blocks", predicates.fragmented(body)), ("table_or_grid_candidate", predicates.tabular(body)))
        reasons = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
    rows = pages.select(key, page, reasons.alias("reasons")).filter(F.size("reasons") > 0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(page))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def sampled_pages(page_count: Column, wanted: int) -> Column:
    """Ascending indexes to sample: all pages if few, else the first two, the last, and a stride from the third on until there are enough."""
    stride = F.greatest(F.lit(1), F.floor(page_count / max(wanted - 3, 1)).cast("int"))
    walk = F.when(page_count > 3, F.sequence(F.lit(2), F.greatest(page_count - 2, F.lit(2)), stride)).otherwise(F.array().cast("array<int>"))
    some = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(1), page_count - 1), F.slice(walk, 1, max(wanted - 3, 1)))))
    few = F.when(page_count > 0, F.sequence(F.lit(0), F.greatest(page_count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.when(page_count <= wanted, few).otherwise(F.filter(some, lambda i: (i >= 0) & (i < page_count)))


def representative_pages(page_count: Column, limit: int = 8) -> Column:
    """Page numbers that stand for a document: first, second, last, the quarters, and a stride up to the limit."""
    at = lambda a, b: F.greatest(F.lit(1), F.floor(page_count * a / b).cast("int"))
    marks = F.array_distinct(F.array(F.lit(1), F.lit(2), page_count, at(1, 4), at(1, 2), at(3, 4)))
    stride = F.greatest(F.lit(1), F.floor(page_count / F.greatest(limit - F.size(marks), F.lit(1))).cast("int"))
    walk = F.filter(F.sequence(stride, F.greatest(page_count - 1, stride), stride), lambda i: ~F.array_contains(marks, i) & (i < page_count))
    some = F.slice(F.array_sort(F.concat(marks, F.slice(walk, F.lit(1), F.greatest(limit - F.size(marks), F.lit(0))))), 1, limit)
    few = F.when(page_count > 0, F.sequence(F.lit(1), F.greatest(page_count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(page_count <= limit, few).otherwise(some)
