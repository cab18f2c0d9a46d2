"""Queries of names, suffixes, aliases and small conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as f
from . import derived
from .derived import FILES_SQL, RUNS_SQL
from .registry import query, table

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"
_STEM = f"regexp_replace({_NAME}, '^(.+)\\.[^.]+$', '\\1')"
_SAFE = f"regexp_replace(regexp_replace({_STEM}, '[<>:\"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g')"
_KIND = "CASE WHEN s IN ('.epub', '.fb2', '.odt', '.txt') THEN 'pandoc' WHEN s IN ('.azw', '.azw3', '.mobi', '.rtf') THEN 'calibre' WHEN s = '.pdf' THEN 'pdf' WHEN s IN ('.docx', '.pptx', '.xlsx', '.html', '.htm', '.md', '.csv', '.tsv') THEN 'docling' ELSE 'unsupported' END"


@query(
    FILES_SQL
    + f""", parts AS (SELECT page_id, path, lower(path) AS low, lower({_NAME}) AS name, {_SUFFIX} AS s, {_SAFE} AS safe FROM files)
SELECT page_id, path, {_KIND} AS kind, CASE WHEN s IN ('.epub', '.docx', '.pptx', '.xlsx', '.html', '.htm') THEN 'markitdown' ELSE {_KIND} END AS kind_markitdown,
 CASE WHEN s = '' THEN 'UNKNOWN' ELSE upper(s[2:]) END AS label,
 CASE WHEN s = '.pdf' THEN CASE WHEN page_id % 2 = 0 THEN 'scanned_pdf' WHEN page_id % 3 = 0 THEN 'complex_pdf' ELSE 'pdf' END WHEN s IN ('.epub', '.azw', '.azw3', '.mobi', '.fb2') THEN 'ebook' WHEN s IN ('.docx', '.pptx', '.xlsx', '.html', '.htm', '.md', '.csv') THEN 'docling_doc'
  WHEN s IN ('.txt', '.rtf', '.odt') THEN 'text_doc' WHEN s = '.png' THEN 'image' ELSE 'unknown' END AS class,
 CASE WHEN contains(low, '/ocr/') THEN CASE WHEN contains(name, 'chinese') THEN 'image_ocr_chinese' WHEN contains(name, 'english') THEN 'image_ocr_english' WHEN contains(name, 'lowres') THEN 'image_ocr_lowres' WHEN contains(name, 'infographic') THEN 'image_ocr_infographic' ELSE 'image_ocr_misc' END
  WHEN contains(name, 'infographic') THEN 'image_infographic' WHEN contains(low, 'screenshot') OR starts_with(name, 'page-') THEN 'image_screenshot' ELSE 'image' END AS image_class,
 safe, concat('out/', regexp_extract(path, '^(.*/)', 1), safe, '.md') AS output FROM parts"""
)
def file_kinds(spark, folder):
    """Route, label, class and output path of files."""
    rows = derived.files(spark, folder)
    return rows.select(
        "page_id",
        "path",
        f.source_kind("path").alias("kind"),
        f.source_kind("path", "markitdown").alias("kind_markitdown"),
        f.format_label("path").alias("label"),
        f.sample_class("path", F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0).alias("class"),
        f.image_class("path").alias("image_class"),
        f.safe_stem(f.stem("path")).alias("safe"),
        f.output_path("path", "out", ".md").alias("output"),
    )


@query(
    """WITH long AS (SELECT doc_id, concat('books/part ', doc_id, '/', left(regexp_replace(text, '[^a-z ]', '', 'g'), 40 + (doc_id * 7 % 200)::INT), '.epub') AS path FROM documents),
parts AS (SELECT doc_id, path, regexp_extract(path, '([^/]*)\\.epub$', 1) AS stem, regexp_extract(path, '^(.*/)', 1) AS folder FROM long),
safe AS (SELECT *, CASE WHEN trim(regexp_replace(stem, '\\s+', ' ', 'g')) = '' THEN 'converted-book' ELSE trim(regexp_replace(stem, '\\s+', ' ', 'g')) END AS base FROM parts)
SELECT doc_id, CASE WHEN length(path) <= 120 AND length(stem) + 5 <= 150 THEN path ELSE concat(folder, rtrim(left(base, 135), ' ._-'), '-', left(sha1(path), 10), '.epub') END AS short,
 CASE WHEN length(path) <= 120 AND length(stem) + 5 <= 150 THEN path ELSE concat(folder, rtrim(left(base, 131), ' ._-'), '-new', '-', left(sha1(path), 10), '.epub') END AS kept FROM safe WHERE trim(stem) <> '' AND stem NOT LIKE '%.'""".replace("\\\\", "\\")
)
def shortened_paths(spark, folder):
    """Output paths of long names, with and without an ending that stays."""
    name = F.expr("left(regexp_replace(text, '[^a-z ]', ''), 40 + cast(doc_id * 7 % 200 as int))")
    # The name itself is judged: the stem of a path whose name is only a suffix is that suffix, not empty.
    rows = table(spark, folder, "documents").withColumn("name", name).filter((F.trim("name") != "") & ~F.col("name").endswith("."))
    rows = rows.select("doc_id", F.concat(F.lit("books/part "), "doc_id", F.lit("/"), "name", F.lit(".epub")).alias("path"))
    return rows.select("doc_id", f.shortened("path", "path", 120).alias("short"), f.shortened("path", "path", 120, "-new").alias("kept"))


_WORDS = ("PyMuPDF", "Umi_OCR", " mineru ", "use marker now", "compare both", "searchable PDF first", "docling-v2 run", "mark-it-down", "fast", "tika server", "MonkeyOCR-worker", "paddle.ocr vl", "complex-pdf", "Pandoc (fallback)", "")
_PICK = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "][id % 15 + 1]"


@query(
    RUNS_SQL
    + f""", named AS (SELECT id, {_PICK} AS w, lower({_PICK}) AS low FROM runs), cleaned AS (SELECT *, replace(trim(low), '_', '-') AS dash, trim(regexp_replace(low, '[-. ]', '_', 'g')) AS under FROM named)
SELECT id, w, CASE WHEN dash = 'umi-ocr' THEN 'umi' WHEN dash = 'pymupdf' THEN 'pymupdf4llm' WHEN dash IN ('auto', 'fast', 'pymupdf4llm', 'mineru', 'marker', 'umi', 'docling', 'markitdown', 'ocrmypdf') THEN dash ELSE '' END AS pipeline,
 CASE WHEN contains(low, 'compare') THEN 'auto' WHEN contains(low, 'pymupdf') THEN 'pymupdf4llm' WHEN contains(low, 'mineru') THEN 'mineru' WHEN contains(low, 'marker') THEN 'marker' WHEN contains(low, 'umi') THEN 'umi' WHEN contains(low, 'docling') THEN 'docling'
  WHEN contains(low, 'markitdown') OR contains(low, 'mark-it-down') THEN 'markitdown' WHEN contains(low, 'ocrmypdf') OR contains(low, 'searchable pdf') THEN 'ocrmypdf' ELSE '' END AS suggested,
 CASE WHEN regexp_matches(trim(low), '^(pymupdf4llm|mineru|marker|umi|docling|markitdown|ocrmypdf|pdfcraft|olmocr)') THEN regexp_extract(trim(low), '^(pymupdf4llm|mineru|marker|umi|docling|markitdown|ocrmypdf|pdfcraft|olmocr)', 1) ELSE 'asked' END AS actual,
 CASE WHEN contains(low, 'markitdown') THEN 'markitdown' WHEN contains(low, 'docling') THEN 'docling' WHEN contains(low, 'pandoc') THEN 'pandoc' WHEN contains(low, 'tika') THEN 'tika' ELSE 'unknown' END AS baseline,
 CASE under WHEN 'monkeyocr_worker' THEN 'monkeyocr' WHEN 'paddle_ocr_vl' THEN 'paddleocr_vl' ELSE under END AS backend,
 CASE WHEN w = '' THEN 'unknown' WHEN replace(trim(low), '-', '_') = 'complex_pdf' THEN 'text_pdf' ELSE replace(trim(low), '-', '_') END AS material FROM cleaned"""
)
def name_aliases(spark, folder):
    """Names of pipelines, backends, baselines and material kinds by their aliases."""
    rows = derived.runs(spark, folder).select("id", F.get(F.array(*(F.lit(w) for w in _WORDS)), (F.col("id") % 15).cast("int")).alias("w"))
    return rows.select(
        "id",
        "w",
        f.pipeline_name("w").alias("pipeline"),
        f.pipeline_of_text("w").alias("suggested"),
        f.actual_pipeline("w", F.lit("asked")).alias("actual"),
        f.baseline_of(F.lit(""), F.col("w")).alias("baseline"),
        f.backend_name("w").alias("backend"),
        f.material_kind("w").alias("material"),
    )


@query(
    r"""SELECT doc_id, replace(replace(replace(left(text, 80), '\', '\\'), '%', '\%'), '_', '\_') AS escaped, trim(replace(replace(left(text, 90), '|', '\|'), chr(10), ' / ')) AS one_line,
 rtrim(left(regexp_replace(regexp_replace(concat('-', trim(left(t, 70))), '[<>:"/\\|?*]', '_', 'g'), '\s+', '-', 'g'), 60), ' ._-') AS ending, trim(regexp_replace(concat('— ', left(t, 25), ' ·'), '\s+', ' ', 'g'), '·•-—– ') AS toc_title
 FROM (SELECT doc_id, text, regexp_replace(text, '[^A-Za-z0-9 ?:,.]', '', 'g') AS t FROM documents) WHERE regexp_matches(t, '^[A-Za-z0-9?:,]')"""
)
def text_forms(spark, folder):
    """Texts as patterns, table cells, name endings and titles."""
    rows = table(spark, folder, "documents").withColumn("t", F.regexp_replace("text", "[^A-Za-z0-9 ?:,.]", "")).filter(F.col("t").rlike("^[A-Za-z0-9?:,]"))
    return rows.select(
        "doc_id",
        f.like_escaped(F.left("text", F.lit(80))).alias("escaped"),
        f.inline(F.left("text", F.lit(90))).alias("one_line"),
        f.name_suffix(F.left("t", F.lit(70))).alias("ending"),
        f.toc_title(F.concat(F.lit("— "), F.left("t", F.lit(25)), F.lit(" ·"))).alias("toc_title"),
    )


@query(
    RUNS_SQL
    + """SELECT id, CASE WHEN id % 3 = 0 THEN concat('page:', id % 50) WHEN id % 3 = 1 THEN concat('source:', id, '.png') ELSE 'document' END AS place,
 CASE WHEN id % 7 = 6 THEN NULL ELSE list_concat(range((id % 5 + 1)::INT, (id % 5 + 1 + id % 7 + 1)::INT), [(id % 9)::INT]) END AS pages,
 greatest(1, least(20, coalesce(TRY_CAST(CASE WHEN id % 4 = 0 THEN 'x' ELSE concat('', id % 60 - 10) END AS INT), 5))) AS clamped, CASE WHEN id % 4 = 0 THEN NULL ELSE greatest(0.0, least(1.0, (id % 300 - 100) / 100.0))::DOUBLE END AS unit,
 round(seconds / 7, 4) AS plain, greatest(round((id % 3) * seconds / 1e7, 6), 0.000001) AS budget, CASE WHEN category IN ('scanned_pdf', 'image') THEN chars ELSE 0 END AS ocr_characters,
 CASE WHEN id % 5 = 0 THEN 1 WHEN id % 4 = 1 THEN 2 WHEN id % 4 = 2 THEN 3 WHEN id % 4 = 3 THEN 4 WHEN id % 5 = 1 THEN 2 ELSE 3 END AS mineru_level FROM runs"""
)
def small_conversions(spark, folder):
    """Places, page lists, limits, scores, budgets and levels."""
    i = F.col("id")
    text = lambda c: c.cast("string")
    image = F.when(i % 3 == 1, F.concat(F.lit("a/b/"), i, F.lit(".png"))).otherwise("")
    listed = F.when(i % 7 == 6, "5-2").otherwise(F.concat((i % 5 + 1).cast("string"), F.lit("-"), (i % 5 + 1 + i % 7).cast("string"), F.lit(", "), (i % 9).cast("string"), F.lit(",")))
    title = F.when(i % 4 == 1, "第3章 x").when(i % 4 == 2, "第二条 x").when(i % 4 == 3, "（三）x").otherwise("plain")
    kind = F.when(i % 5 == 0, "doc_title").when(i % 5 == 1, "title").otherwise("text")
    return derived.runs(spark, folder).select(
        "id",
        f.page_place(F.when(i % 3 == 0, i % 50), image, F.lit("")).alias("place"),
        f.page_list(listed).alias("pages"),
        f.clamped(F.when(i % 4 == 0, "x").otherwise(text(i % 60 - 10)), 1, 20, 5).alias("clamped"),
        f.unit_score(F.when(i % 4 == 0, "x").otherwise(text((i % 300 - 100) / 100.0))).alias("unit"),
        f.plain_score(F.col("seconds") / 7).alias("plain"),
        f.budget((i % 3) * F.col("seconds") / 1e7).alias("budget"),
        f.ocr_characters(F.coalesce("category", F.lit("")), F.col("chars")).alias("ocr_characters"),
        f.mineru_level(kind, title).alias("mineru_level"),
    )
