"""Decision tables over rows: preflight of PDFs, pipelines, routes, lifecycle states, fusion, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigram_coverage, ratio


def preflight(pages: DataFrame, source: str = "source") -> DataFrame:
    """Page rows (source, chars, image_ratio, blocks, width, height, toc_like, table_like, two_column, bookmarks) per source: ratios and classes."""
    n = F.count("*")
    rows = pages.groupBy(source).agg(
        n.alias("page_count"),
        F.max("bookmarks").alias("bookmark_count"),
        ratio(F.count_if(F.col("chars") >= 80), n).alias("text_page_ratio"),
        F.round(F.avg("chars"), 1).alias("avg_text_chars"),
        F.round(F.avg("blocks"), 1).alias("avg_text_blocks"),
        ratio(F.count_if(F.col("image_ratio") >= 0.25), n).alias("image_page_ratio"),
        F.round(F.avg("image_ratio"), 3).alias("avg_image_area_ratio"),
        F.count_if("toc_like").alias("toc_like_pages"),
        F.count_if("table_like").alias("table_like_pages"),
        F.count_if("two_column").alias("two_column_like_pages"),
        ratio(F.count_if((F.col("width") / F.col("height")).between(1.28, 1.9)), n).alias("slide_aspect_page_ratio"),
    )
    c = F.col
    rows = rows.withColumn("scanned_likely", (c("text_page_ratio") < 0.5) | (c("avg_text_chars") < 120))
    rows = rows.withColumn("presentation_like", (c("slide_aspect_page_ratio") >= 0.65) & (c("toc_like_pages") == 0) & (c("bookmark_count") == 0) & (c("avg_text_blocks") <= 12))
    complex_ = (c("image_page_ratio") >= 0.35) | (c("avg_image_area_ratio") >= 0.25) | (c("table_like_pages") > 0) | (c("two_column_like_pages") > 0) | c("presentation_like")
    rows = rows.withColumn("complex_layout_likely", complex_)
    return rows.withColumn("recommended_pipeline", F.when((c("page_count") <= 12) & ~c("complex_layout_likely"), "marker").otherwise("mineru"))


def estimated_seconds(pipeline: Column, pages: Column, marker: float = 8.0) -> Column:
    per = F.create_map(*(F.lit(x) for kv in {"mineru": 3.0, "umi": 2.0, "docling": 2.0, "markitdown": 0.8, "pymupdf4llm": 0.5, "marker": marker}.items() for x in kv))
    return F.try_element_at(per, pipeline) * pages


def cost_risk(pages: Column) -> Column:
    return F.when(pages >= 100, "high").when(pages >= 20, "medium").otherwise("low")


def sample_pages(page_count: Column, wanted: int) -> Column:
    """Ascending indexes of the pages to sample: the first two, the last and an even stride between."""
    stride = F.greatest(F.floor(page_count / wanted), F.lit(1)).cast("int")
    some = F.slice(F.sequence(F.lit(0), page_count - 1, stride), 1, wanted)
    ends = F.filter(F.array(F.lit(0), F.lit(1), page_count.cast("int") - 1), lambda i: (i >= 0) & (i < page_count))
    return F.when(page_count > 0, F.slice(F.array_sort(F.array_distinct(F.concat(ends, some))), 1, wanted + 3)).otherwise(F.array().cast("array<int>"))


def fused(ocr: DataFrame, vlm: DataFrame, key: str = "page_number") -> DataFrame:
    """OCR pages with the VLM's text: kept without one, replaced where it covers the OCR's character pairs to 0.8, appended elsewhere."""
    rows = ocr.join(vlm.select(key, F.col("text").alias("_v"), F.col("status").alias("_s")), key, "left")
    usable = (F.coalesce("_s", F.lit("failed")) == "ok") & (F.coalesce("_v", F.lit("")) != "")
    share = bigram_coverage(F.coalesce("text", F.lit("")), F.coalesce("_v", F.lit("")))
    action = F.when(~usable, "kept_ocr").when((F.coalesce("text", F.lit("")) == "") | (share >= 0.8), "replaced").otherwise("appended")
    rows = rows.withColumn("action", action)
    return rows.withColumn("text", F.when(F.col("action") == "replaced", F.col("_v")).when(F.col("action") == "appended", F.concat("text", F.lit("\n\n"), F.col("_v"))).otherwise(F.col("text"))).drop("_v", "_s")


def scaled_confidences(confidences: Column) -> Column:
    """Confidences in 0..1 from mixed scales: values over 1 are percentages, invalid ones dropped."""
    known = F.filter(confidences, lambda x: x.isNotNull() & (x >= 0) & (x <= 100))
    return F.transform(known, lambda x: F.when(x > 1, x / 100).otherwise(x))


def embedded_confidences(items: Column) -> Column:
    """Confidences in 0..1 of a map's values (average_confidence); others are left out."""
    values = F.transform(F.map_values(items), lambda i: i["average_confidence"].try_cast("double"))
    return F.filter(values, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))


def low_confidence(confidences: Column) -> Column:
    """Whether OCR confidences call for a review: mean under 0.70, or 30 % under 0.65."""
    c = scaled_confidences(confidences)
    n = F.size(c)
    mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
    return F.coalesce((n > 0) & ((mean < 0.70) | (F.size(F.filter(c, lambda x: x < 0.65)) / n >= 0.30)), F.lit(False))


def blocks(candidates: DataFrame, items: str = "blocks") -> DataFrame:
    """Candidate artifacts (source, backend, pages: [{page, blocks: [{kind, text, bbox}]}]) as one row per block with an id."""
    each = candidates.select("source", "backend", F.explode("pages").alias("p")).select("source", "backend", F.col("p.page").alias("page"), F.posexplode(F.col(f"p.{items}")).alias("ordinal", "b"))
    name = F.concat_ws(":", "source", "b.kind", F.col("page").cast("string"), (F.col("ordinal") + 1).cast("string"))
    return each.select(name.alias("block_id"), "source", "backend", "page", (F.col("ordinal") + 1).alias("ordinal"), "b.kind", F.coalesce("b.text", F.lit("")).alias("text"), "b.bbox")


def block_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("blocks"), F.count_if(F.col("bbox").isNull() | (F.size("bbox") == 0)).alias("without_box"), F.sum(F.length("text")).alias("chars"))


def outline_alignment(outline: DataFrame, headings: DataFrame, source: str = "source") -> DataFrame:
    """Share of outline titles found among a source's headings (equal, or one inside the other from 4 characters), and its class."""
    key = lambda c: F.lower(F.regexp_replace(c, r"(?U)[\s\p{Punct}]+", ""))
    have = headings.groupBy(source).agg(F.collect_set(key(F.col("title"))).alias("have"))
    rows = outline.withColumn("k", key(F.col("title"))).join(have, source, "left")
    hit = F.exists(F.coalesce("have", F.array().cast("array<string>")), lambda h: (h == F.col("k")) | ((F.least(F.length(h), F.length("k")) >= 4) & (h.contains(F.col("k")) | F.col("k").contains(h))))
    out = rows.groupBy(source).agg(F.count("*").alias("titles"), F.count_if(hit).alias("matched"), F.max(F.size(F.coalesce("have", F.array().cast("array<string>")))).alias("n_headings"))
    out = out.withColumn("match_ratio", ratio(F.col("matched"), F.col("titles")))
    state = F.when(F.col("n_headings") == 0, "no_markdown_headings").when((F.col("match_ratio") < 0.4) & (F.col("titles") >= 2), "low_alignment").when(F.col("match_ratio") < 0.75, "partial_alignment").otherwise("ok")
    return out.withColumn("status", state).drop("n_headings")
