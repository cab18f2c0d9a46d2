"""Names of files, backends, pipelines and categories: kinds by suffix, output names, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, file_name, stem, strip, suffix

# Suffixes of each route, names and their aliases.
PANDOC, CALIBRE, PDF = (".epub", ".fb2", ".odt", ".txt"), (".azw", ".azw3", ".mobi", ".rtf"), (".pdf",)
DOCLING, DELIMITED = (".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".csv"), (".csv", ".tsv")
MARKITDOWN = (".epub", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".pdf")
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
PIPELINES = ("auto", "fast", "pymupdf4llm", "mineru", "marker", "umi", "docling", "markitdown", "ocrmypdf")
PIPELINE_WORDS = (
    ("pymupdf", "pymupdf4llm"), ("mineru", "mineru"), ("marker", "marker"), ("umi", "umi"), ("docling", "docling"),
    ("markitdown", "markitdown"), ("mark-it-down", "markitdown"), ("ocrmypdf", "ocrmypdf"), ("ocr my pdf", "ocrmypdf"), ("searchable pdf", "ocrmypdf"),
)
ACTUAL_PIPELINES = ("pymupdf4llm", "mineru", "marker", "umi", "docling", "markitdown", "ocrmypdf", "pdfcraft", "olmocr")
BASELINES = ("markitdown", "docling", "pandoc", "tika", "mammoth", "kreuzberg")
BACKEND_ALIASES = {"monkeyocr_worker": "monkeyocr", "dots_mocr_provider": "dots_mocr", "doclayout_yolo_baseline": "doclayout_yolo", "pdf_table_worker": "pdf_table", "paddle_ocr_vl": "paddleocr_vl", "fake_vlm_layout": "qwen_vl", "fake_ocr_layout": "qwen_vl"}
KIND_ALIASES = {"pdf": "text_pdf", "complex_pdf": "text_pdf", "office_docx": "office", "images": "image_set"}
ILLEGAL = r"[<>:\"/\\|?*\x00-\x1f]"


def _chosen(c: Column, pairs, otherwise: Column) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def source_kind(path: Column | str, mode: str = "auto") -> Column:
    """The route of a file: pandoc, calibre, pdf, docling or unsupported; a forced document mode comes first."""
    s = suffix(path)
    out = F.when(s.isin(*PANDOC), "pandoc").when(s.isin(*CALIBRE), "calibre").when(s.isin(*PDF), "pdf").when(s.isin(*DOCLING, *DELIMITED), "docling").otherwise("unsupported")
    if mode == "markitdown":
        return F.when(s.isin(*(x for x in MARKITDOWN if x not in PDF)), "markitdown").otherwise(out)
    return F.when(s.isin(*DOCLING), "docling").otherwise(out) if mode == "docling" else out


def format_label(path: Column | str) -> Column:
    return F.coalesce(F.nullif(F.upper(F.ltrim(suffix(path), F.lit("."))), F.lit("")), F.lit("UNKNOWN"))


def sample_class(path: Column | str, scanned: Column, complex_layout: Column) -> Column:
    """Benchmark class of a file; a PDF's by what its pages look like."""
    s = suffix(path)
    pdf = F.when(scanned, "scanned_pdf").when(complex_layout, "complex_pdf").otherwise("pdf")
    pairs = ((s.isin(*PDF), pdf), (s.isin(".epub", ".azw", ".azw3", ".mobi", ".fb2"), "ebook"), (s.isin(*DOCLING), "docling_doc"), (s.isin(".txt", ".rtf", ".odt"), "text_doc"), (s.isin(*IMAGES), "image"))
    return _chosen(s, pairs, F.lit("unknown"))


def image_class(path: Column | str) -> Column:
    """Category of an image by its folder and name."""
    whole, name = F.lower(F.replace(col(path), F.lit("\\"), F.lit("/"))), F.lower(file_name(path))
    ocr = _chosen(name, [(name.contains(w), f"image_ocr_{w}") for w in ("chinese", "english", "lowres", "infographic")], F.lit("image_ocr_misc"))
    return F.when(whole.contains("/ocr/"), ocr).when(name.contains("infographic"), "image_infographic").when(whole.contains("screenshot") | name.startswith("page-"), "image_screenshot").otherwise("image")


def safe_stem(name: Column | str) -> Column:
    """A stem without characters that file systems refuse."""
    out = strip(F.regexp_replace(F.regexp_replace(col(name), ILLEGAL, "_"), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("converted-book"))


def name_suffix(value: Column | str) -> Column:
    """A suffix of output names: begins with a separator, holds no white space, sixty characters at most."""
    c = strip(F.coalesce(col(value), F.lit("")))
    led = F.when(c.rlike(r"^[-_.]"), c).otherwise(F.concat(F.lit("-"), c))
    cut = F.substring(F.regexp_replace(F.regexp_replace(led, ILLEGAL, "_"), r"(?U)\s+", "-"), 1, 60)
    return F.when(c == "", "").otherwise(F.regexp_replace(cut, r"[ ._-]+$", ""))


def shortened(path: Column | str, source: Column | str, most: int = 220, keep: str = "") -> Column:
    """An output path, its stem cut and marked by the source's hash if the path or the name is too long; `keep` ends the stem."""
    p, name = col(path), file_name(path)
    tail = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    base = safe_stem(stem(path))
    if keep:
        base = F.when(base.endswith(keep), F.regexp_replace(F.substring(base, F.lit(1), F.length(base) - len(keep)), r"[ ._-]+$", "")).otherwise(base)
    cut = F.regexp_replace(F.substring(base, F.lit(1), F.greatest(F.lit(30), 140 - F.length(tail) - len(keep))), r"[ ._-]+$", "")
    folder = F.substring(p, F.lit(1), F.length(p) - F.length(name))
    short = F.concat(folder, cut, F.lit(f"{keep}-"), F.substring(F.sha1(col(source).cast("binary")), 1, 10), tail)
    return F.when((F.length(p) <= most) & (F.length(name) <= 150), p).otherwise(short)


def output_path(path: Column | str, root: str, new_suffix: str, added: str = "") -> Column:
    """Where the conversion of a file (a path below the input root) goes."""
    name = file_name(path)
    folder = F.substring(col(path), F.lit(1), F.length(col(path)) - F.length(name))
    out = F.concat(F.lit(f"{root}/"), folder, safe_stem(stem(path)), F.lit(added + new_suffix))
    return shortened(out, path, keep=added)


def pipeline_name(value: Column | str) -> Column:
    """A PDF pipeline's own name, empty for unknown ones."""
    c = F.replace(F.lower(F.trim(F.coalesce(col(value), F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(c == "umi-ocr", "umi").when(c == "pymupdf", "pymupdf4llm").when(c.isin(*PIPELINES), c).otherwise("")


def pipeline_of_text(value: Column | str) -> Column:
    """The pipeline that a suggestion names; auto for a comparison, empty for none."""
    c = F.lower(F.coalesce(col(value), F.lit("")))
    return F.when(c.contains("compare") | c.contains("对比"), "auto").otherwise(_chosen(c, [(c.contains(w), name) for w, name in PIPELINE_WORDS], F.lit("")))


def actual_pipeline(actual: Column | str, requested: Column | str) -> Column:
    c = F.lower(F.trim(F.coalesce(col(actual), F.lit(""))))
    return _chosen(c, [(c.startswith(x), F.lit(x)) for x in ACTUAL_PIPELINES], col(requested))


def baseline_of(*texts: Column) -> Column:
    c = F.lower(F.concat_ws(" ", *texts))
    return _chosen(c, [(c.contains(x), F.lit(x)) for x in BASELINES], F.lit("unknown"))


def backend_name(name: Column | str) -> Column:
    c = F.trim(F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"[-. ]", "_"))
    return _chosen(c, [(c == a, F.lit(b)) for a, b in BACKEND_ALIASES.items()], c)


def material_kind(value: Column | str) -> Column:
    c = F.replace(F.lower(F.trim(F.coalesce(F.nullif(col(value), F.lit("")), F.lit("unknown")))), F.lit("-"), F.lit("_"))
    return _chosen(c, [(c == a, F.lit(b)) for a, b in KIND_ALIASES.items()], c)


def mineru_level(kind: Column | str, title: Column | str) -> Column:
    """Heading level of a layout model's title."""
    t, numerals = col(title), "一二三四五六七八九十百零〇"
    pairs = (
        (col(kind) == "doc_title", F.lit(1)),
        (t.rlike(rf"^第[{numerals}\d]+[章节篇部卷]\s*\S"), F.lit(2)),
        (t.rlike(rf"^第[{numerals}\d]+条\s*\S"), F.lit(3)),
        (t.rlike(rf"^（[{numerals}]+）\S"), F.lit(4)),
        (col(kind) == "title", F.lit(2)),
    )
    return _chosen(t, pairs, F.lit(3))


def toc_title(title: Column | str) -> Column:
    """A title of a contents list without marks at its ends."""
    return F.regexp_replace(strip(F.regexp_replace(col(title), r"(?U)\s+", " ")), r"^[·•\-—– ]+|[·•\-—– ]+$", "")


def inline(text: Column | str) -> Column:
    """A text on one line of a table."""
    return F.trim(F.replace(F.replace(F.replace(col(text), F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" / ")))


def like_escaped(value: Column | str) -> Column:
    return F.regexp_replace(col(value), r"([\\%_])", r"\\$1")


def page_place(page: Column, image: Column, source: Column) -> Column:
    """page:N, else source:name, else document."""
    named = F.coalesce(F.nullif(image, F.lit("")), F.nullif(source, F.lit("")))
    return F.when(page.isNotNull(), F.concat(F.lit("page:"), page.cast("string"))).when(named.isNotNull(), F.concat(F.lit("source:"), file_name(named))).otherwise("document")


def page_list(value: Column | str) -> Column:
    """`1-3,2` as its numbers in the order they stand, null where a range runs backwards."""
    parts = F.filter(F.transform(F.split(col(value), ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.transform(parts, lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("a"), F.element_at(F.split(x, "-"), -1).cast("int").alias("b")))
    return F.when(~F.exists(ends, lambda e: e["b"] < e["a"]), F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], F.greatest(e["a"], e["b"])))))


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


def unit_score(value: Column) -> Column:
    """A number between 0 and 1, null for what is no number."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def plain_score(value: Column) -> Column:
    return F.round(value.try_cast("double"), 4)


def budget(value: Column) -> Column:
    """A budget of six digits that is never zero."""
    return F.greatest(F.round(value.cast("double"), 6), F.lit(0.000001))


def ocr_characters(category: Column, characters: Column) -> Column:
    return F.when(category.isin("scanned_pdf", "image", "image_infographic", "image_set", "image_set_duplicates"), F.coalesce(characters, F.lit(0))).otherwise(0)
