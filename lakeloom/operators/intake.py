"""What is known of a material before and after its conversion: registries, manifests, logs of tools, online routes, image texts, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, or_unknown, strip
from .candidates import first_kept, ranked
from .decisions import named
from .routing import cost_risk
from .summaries import count_map

# Aliases of classes and backends, marks of failures, words of sites in file names.
CLASS_ALIASES = {
    "pdf": "pdf_text_layer", "complex_pdf": "pdf_two_column", "scanned_pdf": "scanned_pdf", "pdf_scan": "scanned_pdf", "pdf_table_heavy": "pdf_table", "chinese_contract": "chinese_hierarchy_document",
    "insurance_policy": "chinese_hierarchy_document", "insurance_contract": "chinese_hierarchy_document", "policy_contract": "chinese_hierarchy_document", "chinese_hierarchy": "chinese_hierarchy_document",
    "table_pdf": "pdf_table", "pdf_ppt": "ppt_export_pdf", "presentation_pdf": "ppt_export_pdf", "image": "infographic_image", "image_set_duplicates": "image_set", "docling_doc": "doc_office",
    "ebook_epub": "doc_office", "text_doc": "doc_office",
}
CLASSES = ("pdf_text_layer", "scanned_pdf", "pdf_two_column", "pdf_table", "pdf_formula", "chinese_hierarchy_document", "ppt_export_pdf", "infographic_image", "image_set", "web_archive", "academic_pdf", "doc_office")
ENHANCERS = {
    "mineru": "mineru-vlm", "mineru-vlm": "mineru-vlm", "paddle": "paddleocr-vl", "paddleocr": "paddleocr-vl", "paddleocr-vl": "paddleocr-vl", "p2t": "pix2text", "pix2text": "pix2text",
    "surya": "surya", "surya-ocr": "surya", "qwen": "qwen-vl", "qwen-vl": "qwen-vl",
}
ENHANCER_ORDER = ("pix2text", "surya", "paddleocr-vl", "mineru-vlm", "qwen-vl")
FAILURES = (
    "arraymemoryerror", "unable to allocate", "error: 1 task(s) failed", " task(s) failed while processing documents", "failed for task#", "managed mineru process", "winerror 1455", "error loading",
    "local mineru-api exited before becoming healthy", "no markdown file was produced",
)
PROGRESS = (r"(?:page|pages|页)\s*[:#]?\s*(\d{1,5})\s*(?:/|of|共)\s*(\d{1,5})", r"(\d{1,5})\s*/\s*(\d{1,5})\s*(?:page|pages|页)?", r"第\s*(\d{1,5})\s*页()", r"(?:processing|processed|parse|ocr).*?(?:page|页)\s*[:#]?\s*(\d{1,5})()")
SITES = r"(?:z-library\.sk|1lib\.sk|z-lib\.sk)"
SITE_RULES = (
    (rf"(?i)[\s._-]*[\(\[\{{（【]?\s*{SITES}(?:\s*[,，、;/|]\s*{SITES})*\s*[\)\]\}}）】]?", " "),
    (r"(?i)[\s,，、;/|]*\b(?:z-library|z-lib|z-li|1lib|1li|1l)(?:\.[a-z]{0,3})?\s*-\s*([0-9a-z][0-9a-z-]{1,})", "-$1"),
    (r"(?i)[\s,，、;/|]*\b(?:1l[a-z]*|z-l[a-z]*)\s*-\s*([0-9a-f]{2,})", "-$1"),
    (r"(?i)[\s,，、;/|]*\b(?:1l[a-z]*|z-l[a-z]*)\b(?=(?:\.[A-Za-z0-9_-]+)?$)", ""),
    (r"[\(\[\{（【]\s*[\)\]\}）】]", " "),
    (r"(?i)[\(\[\{（【]\s*(-[0-9a-z][0-9a-z-]*)(?=(?:\.[A-Za-z0-9_-]+)?$)", "$1"),
    (r"\s+([,，、;；])", "$1"),
    (r"\s+(\.[A-Za-z0-9_-]+)$", "$1"),
    (r"(?i)\s+(-[0-9a-z][0-9a-z-]*)(?=(?:\.[A-Za-z0-9_-]+)?$)", "$1"),
    (r"[,，、;；\s._-]+$", ""),
    (r"^[,，、;；\s._-]+", ""),
    (r"\s+", " "),
)


def _mapped(c: Column, values: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c), default)


def clean_stem(name: Column | str) -> Column:
    """A file's stem without the marks of the site that it came from."""
    out = F.coalesce(col(name), F.lit(""))
    for pattern, new in SITE_RULES:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def benchmark_class(category: Column) -> Column:
    c = F.coalesce(category, F.lit("unknown"))
    return _mapped(c, CLASS_ALIASES, F.when(c.isin(*CLASSES), c).otherwise("doc_office"))


def benchmark_plan(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Samples (id, category) with their class and its profile (class, backends); classes without a sample follow with none."""
    rows = samples.withColumn("class", benchmark_class(F.col("category"))).join(F.broadcast(profiles), "class", "left")  # a row for each class
    none = profiles.join(rows.select("class").distinct(), "class", "left_anti").withColumns({"id": F.lit(None).cast("string"), "category": F.lit(None).cast("string")})
    return rows.select("id", "category", "class", "backends").unionByName(none.select("id", "category", "class", "backends"))


def registered(backends: DataFrame, most: int = 50, *, backend: str = "", sample_class: str = "", capability: str = "", artifact: str = "") -> DataFrame:
    """Backends (key, names, classes, capabilities, artifacts, ordinal) that fit all given filters, the first `most`; case and separators do not count."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_.-]+", "_")
    rows = backends
    for wanted, field in ((backend, "names"), (sample_class, "classes"), (capability, "capabilities"), (artifact, "artifacts")):
        if wanted:
            rows = rows.filter(F.array_contains(F.transform(field, plain), plain(F.lit(wanted))))
    return rows.orderBy("ordinal").limit(max(1, most))


def chosen(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The rows of the given names; none of them present is an error, as a run without rows would look like a success."""
    out = rows.filter(F.col(key).isin(names)) if names else rows
    if out.isEmpty():
        raise ValueError(f"no {key} of {', '.join(names)}")
    return out


def with_split(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages (source, order_confidence) with the split (path, split_group, split_index) that they were cut from."""
    key = lambda c: F.lower(F.replace(F.trim(c), F.lit("\\"), F.lit("/")))
    cuts = first_kept(manifest.select(key("path").alias("_k"), "split_group", "split_index").withColumn("_o", F.col("split_index")), ["_k"], "_o").drop("_o")
    rows = pages.withColumn("_k", key("source")).join(cuts, "_k", "left").drop("_k")
    return rows.withColumn("order_confidence", F.when(F.col("split_group").isNotNull(), F.greatest("order_confidence", F.lit(0.99))).otherwise(F.col("order_confidence")))


def overlaid(results: DataFrame, reports: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Results whose fields a report of theirs replaces where it has one."""
    rows = results.join(reports.select(key, *(F.col(f).alias(f"_r_{f}") for f in fields)), key, "left")
    return rows.withColumns({f: F.coalesce(f"_r_{f}", f) for f in fields}).drop(*(f"_r_{f}" for f in fields))


def manual_reviews(records: DataFrame) -> DataFrame:
    """Hand-made reviews (source, ordinal, and more), the last one of each source."""
    others = [c for c in records.columns if c != "source"]
    return records.filter(F.coalesce("source", F.lit("")) != "").groupBy("source").agg(F.max_by(F.struct(*others), "ordinal").alias("r")).select("source", "r.*")


def tables_by_page(artifacts: DataFrame, key: str) -> DataFrame:
    """Table artifacts (page, backend, rank, rows) of three tools by page: how many, whose, and their row counts in the tools' order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ordinal", "rows"))), lambda x: x["rows"])
    return artifacts.groupBy(key, "page").agg(F.count("*").alias("tables"), F.array_sort(F.collect_set("backend")).alias("backends"), items.alias("rows"))


def review_items(items: DataFrame, key: str, most: int) -> DataFrame:
    """The first review items (ordinal, position) of a batch."""
    return ranked(items, [key], [F.col("ordinal"), F.col("position")]).filter(F.col("rank") <= most).drop("rank")


def evidence_kind(tool: Column, schema: Column) -> Column:
    """Which academic evidence a payload is: grobid, formula or bundle; null for none."""
    return F.when(tool == "grobid", "grobid").when(schema == "formula-candidates-v1", "formula").when(schema == "layout-table-review-bundle-v1", "bundle")


def with_image_texts(text: Column, texts: Column) -> Column:
    """A Markdown text with the recognised text (map of source to text) in a comment block behind each image; a text that has such blocks stays."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\([^)\s]+\)"), 0))

    def put(acc, ref):
        found = F.try_element_at(texts, F.regexp_extract(ref, r"\(([^)\s]+)\)$", 1))
        return F.when(F.coalesce(found, F.lit("")) != "", F.replace(acc, ref, F.concat(ref, F.lit("\n\n<!-- embedded-image-ocr: "), found, F.lit(" -->")))).otherwise(acc)

    return F.when(text.contains("embedded-image-ocr:"), text).otherwise(F.aggregate(refs, text, put))


def remote_markdown(value: Column | str) -> Column:
    """A model's Markdown without the fence around it."""
    t = strip(F.regexp_replace(F.regexp_replace(F.coalesce(col(value), F.lit("")), "\r\n", "\n"), "\r", "\n"))
    return F.when(t.rlike(r"(?is)^```(?:markdown|md)[^\S\n]*\n.*\n?```$"), strip(F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:markdown|md)[^\S\n]*\n", ""), r"\n?```$", ""))).otherwise(t)


def markdown_block(value: Column | str) -> Column:
    """One block of a wrapper's Markdown, null for a blank one."""
    t = strip(F.coalesce(col(value), F.lit("")))
    return F.when(t != "", F.struct(F.lit("markdown_text").alias("type"), F.substring(t, 1, 1000).alias("text_preview"), F.length(t).alias("text_char_count")))


def tool_progress(line: Column | str, pages: Column) -> Column:
    """The page that a tool says it is at: the first pattern that fits and agrees with the page count."""
    low = F.lower(col(line))
    found = []
    for pattern in PROGRESS:
        now = F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).cast("int")
        total = F.coalesce(F.nullif(F.regexp_extract(low, pattern, 2), F.lit("")).cast("int"), pages)
        far = (pages > 0) & (total > 0) & (F.abs(total - pages) > F.greatest(F.lit(5.0), pages * 0.2))
        found.append(F.when(now.isNotNull() & ~far & (now > 0) & ~((pages > 0) & (now > pages)), now))
    return F.coalesce(*found)


def tool_failure(line: Column | str) -> Column:
    """The line, if it tells of a failure that ends the tool."""
    low, bad = F.lower(col(line)), F.lit(False)
    for mark in FAILURES:
        bad = bad | F.contains(low, F.lit(mark))
    return F.when(bad, F.substring(col(line), 1, 500))


def duplicate_reason(images: Column, texts: Column) -> Column:
    """Why pages (numbers of different image and text hashes) are duplicates."""
    return F.when(images == 1, "same_image_hash").when(texts == 1, "same_text_hash").otherwise("near_duplicate_text")


def enhancer_order(order: Column | str) -> Column:
    """Backends in the order asked for, each once; the usual order if none is known."""
    names = F.transform(F.split(F.lower(F.coalesce(col(order), F.lit(""))), r"[,;\s]+"), lambda x: _mapped(x, ENHANCERS, F.lit("")))
    known = F.array_distinct(F.filter(names, lambda x: x != ""))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*(F.lit(x) for x in ENHANCER_ORDER)))


def block_text(block: Column) -> Column:
    """A block's own text and that of its lines' spans (text, lines: [{spans: [{content, text}]}])."""
    spans = F.flatten(F.transform(F.coalesce(block["lines"], F.array().cast("array<struct<spans:array<struct<content:string,text:string>>>>")), lambda line: line["spans"]))
    inner = F.transform(spans, lambda s: F.coalesce(F.nullif(s["content"], F.lit("")), s["text"]))
    return F.array_join(F.array_compact(F.concat(F.array(block["text"]), inner)), "\n")


def mime_type(metadata: Column) -> Column:
    at = lambda k: F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    return F.coalesce(*(at(k) for k in ("Content-Type", "content-type", "dc:format", "resourceName")), F.lit(""))


def baseline_risks(level: Column, headings: Column, short_ratio: Column, table_lines: Column, tika: Column) -> Column:
    """Risks of a baseline's row."""
    bad = level.isin("review", "poor", "failed")
    return named((F.concat(F.lit("quality_"), level), bad), ("missing_headings", headings == 0), ("ocr_or_linebreak_noise", short_ratio >= 0.35), ("table_shape_needs_review", table_lines > 0), ("inspect_only_not_markdown_route", tika))


def comparison_summary(items: DataFrame, run: str) -> DataFrame:
    """Compared pipelines (pipeline, status, score, headings, seconds) of a run: states, and the best of those that ended well."""
    ok = F.when(F.col("status") == "ok", F.struct(F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("headings", F.lit(0)).alias("headings"), (-F.col("seconds")).alias("faster"), "pipeline"))
    best = items.groupBy(run).agg(F.max(ok).alias("b")).select(run, F.coalesce("b.pipeline", F.lit("")).alias("best_pipeline"), F.col("b.score").alias("best_score"), F.col("b.headings").alias("best_headings"))
    return best.join(count_map(items, [run], or_unknown("status"), "states"), run)


def review_reasons(reasons: Column, human_status: Column, human_score: Column, status: Column, message: Column, bookmarks: Column) -> Column:
    """Reasons of a review decision: the quality's, the reviewer's, the failure's, the bookmarks'."""
    manual = F.concat(F.lit("Manual review: "), human_status, F.coalesce(F.concat(F.lit(" score="), human_score.cast("string")), F.lit("")))
    return F.concat(reasons, named((manual, human_status.isNotNull()), (message, (status == "failed") & (F.coalesce(message, F.lit("")) != "")), (F.concat(F.lit("PDF outline/bookmarks available: "), bookmarks), bookmarks > 0)))


def queue_actions(items: DataFrame, key: str) -> DataFrame:
    """What to do next with a quality queue (focus, output, report)."""
    has = lambda f, c: F.max((F.col("focus") == f) & (F.coalesce(c, F.lit("")) != ""))
    rows = items.groupBy(key).agg(has("structure_repair", "output").alias("s"), F.max(F.col("focus") == "structure_repair").alias("s0"), has("ocr_cleanup", "report").alias("o"), F.max(F.col("focus") == "ocr_cleanup").alias("o0"), F.max(F.col("focus") == "markdown_cleanup").alias("m"))
    c = F.col
    rules = (("run_safe_structure_enhancement", c("s")), ("manual:structure_repair", c("s0") & ~c("s")), ("inspect_ocr_noise", c("o")), ("manual:ocr_cleanup", c("o0") & ~c("o")), ("improve_markdown_cleanup_fixture", c("m")), ("open_quality_queue", F.lit(True)))
    return rows.select(key, named(*rules).alias("actions"))


def online_pdf(pages: Column, scanned: Column, complex_layout: Column, presentation: Column, bookmarks: Column) -> Column:
    """Online routes for a PDF, each once in the order of their rules, and the risks of cost and privacy."""
    part = lambda test, *names: F.when(test, F.array(*(F.lit(n) for n in names))).otherwise(F.array().cast("array<string>"))
    routes = F.array_distinct(F.concat(part(presentation, "vlm_layout", "text_structure_llm"), part(scanned, "ocr_layout", "vlm_layout"), part(complex_layout, "vlm_layout", "table_repair", "text_structure_llm"), part(bookmarks > 0, "text_structure_llm")))
    return F.struct(routes.alias("routes"), cost_risk(pages).alias("cost_risk"), F.when(F.size(routes) > 0, "high").otherwise("none").alias("privacy_risk"))


def online_image(width: Column, height: Column) -> Column:
    pixels = F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))
    long = (width > 0) & (height > 0) & (F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1)) >= 1.8)
    routes = F.when((pixels >= 1_800_000) | long, F.array(F.lit("vlm_layout"), F.lit("ocr_layout"))).otherwise(F.array().cast("array<string>"))
    return F.struct(routes.alias("routes"), F.when(pixels < 4_000_000, "low").otherwise("medium").alias("cost_risk"), F.when(F.size(routes) > 0, "medium").otherwise("none").alias("privacy_risk"))


def online_document(suffix: Column) -> Column:
    return F.when(suffix.isin(".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".csv"), F.array(F.lit("text_structure_llm"))).otherwise(F.array().cast("array<string>"))


def folder_baselines(samples: DataFrame, key: str) -> DataFrame:
    """Cheap routes of a folder: those of its sampled files (ordinal, baselines), each once in their order."""
    each = samples.select(key, "ordinal", F.posexplode("baselines").alias("_p", "baseline"))
    kept = each.groupBy(key, "baseline").agg(F.min(F.struct("ordinal", "_p")).alias("_o"))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "baseline"))), lambda x: x["baseline"]).alias("baselines"))


def folder_sizes(files: DataFrame, folder: str, size: str) -> DataFrame:
    return files.groupBy(folder).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))
