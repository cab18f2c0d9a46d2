"""Documents, tables, summaries and reports rendered from rows, and what is checked of the files that they name.

Pages and lines of one document are gathered in their order, no more than the document that is rendered.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import font_heading
from ..functions.text import duration, file_name, or_unknown, stem, strip, table_escape
from .cleaning import without_repeated_start

LARGE_FILE = 5_000_000


def in_order(rows: DataFrame, key: str, order: list[str], text: Column, between: str) -> DataFrame:
    """Texts of a key in their order as one."""
    each = rows.select(key, *order, text.alias("_x")).filter(F.col("_x").isNotNull())
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_x"))), lambda x: x["_x"]), between).alias("text"))


def text_layer(pages: DataFrame, outline: DataFrame, key: str) -> DataFrame:
    """Pages (page, text) of a document's text layer as Markdown: the outline's titles (page, level, title, ordinal) as headings, else the page's number."""
    marks = outline.filter((F.trim("title") != "") & (F.col("page") > 0))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)) + 1, F.lit(2)), F.lit(6))
    heads = in_order(marks.withColumn("h", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("title"))).withColumn("at", F.struct(key, "page")), "at", ["ordinal"], F.col("h"), "\n\n")
    heads = heads.select(F.col(f"at.{key}").alias(key), F.col("at.page").alias("page"), F.col("text").alias("heads"))
    rows = pages.withColumn("body", strip(F.coalesce("text", F.lit("")))).filter("body <> ''").join(heads, [key, "page"], "left")
    part = F.concat(F.coalesce("heads", F.concat(F.lit("## Page "), "page")), F.lit("\n\n"), "body")
    return in_order(rows, key, ["page"], part, "\n\n")


def merged_segments(segments: DataFrame, key: str, label: str = "segment") -> DataFrame:
    """Page-range segments (first, last, text) of a document as one text, each behind a comment that names its pages."""
    part = F.concat(F.lit(f"<!-- {label} pages "), F.col("first") + 1, F.lit("-"), "last", F.lit(" -->\n\n"), strip(F.coalesce("text", F.lit(""))))
    return in_order(segments, key, ["first"], part, "\n\n")


def book(pages: DataFrame, key: str, title: Column) -> DataFrame:
    """Ordered pages (order_index, source, order_confidence, infographic, signals, text) as a book with comments on their sources and doubts."""
    notes = F.array_compact(
        F.array(
            F.concat(F.lit("<!-- source: "), "source", F.lit(" -->")),
            F.when(F.col("order_confidence") < 0.45, F.concat(F.lit("<!-- low-confidence-order: "), F.format_string("%.2f", "order_confidence"), F.lit(" -->"))),
            F.when(F.col("infographic"), F.concat(F.lit("<!-- likely-infographic: "), F.coalesce(F.nullif(F.array_join("signals", ", "), F.lit("")), F.lit("layout-heavy image")), F.lit(" -->"))),
            F.when(F.col("infographic"), F.concat(F.lit("![source image]("), "source", F.lit(")"))),
        )
    )
    rows = in_order(pages, key, ["order_index"], F.concat(F.array_join(notes, "\n"), F.lit("\n"), F.coalesce("text", F.lit(""))), "\n\n")
    return rows.withColumn("text", F.concat(F.lit("# "), title, F.lit("\n\n"), F.regexp_replace("text", r"\s+$", ""), F.lit("\n")))


def joined_pages(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Pages of one split image as one text, without the paragraphs that a page repeats from the one before."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    rows = pages.withColumn("_b", before)
    return in_order(rows, key, [order], without_repeated_start(F.coalesce("_b", F.lit("")), "text"), "\n\n")


def visual_blocks(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """Pages (source, index, text, status) and headings (source, title, level) as one list of typed blocks."""
    text = F.coalesce("text", F.lit(""))
    a = pages.select(F.lit("ocr_page").alias("type"), "source", "index", F.length(text).alias("char_count"), F.coalesce("status", F.lit("")).alias("ocr_status"), F.substring(text, 1, 240).alias("text_preview"))
    return a.unionByName(headings.select(F.lit("structure_heading").alias("type"), "source", "title", "level"), allowMissingColumns=True)


def run_summary(results: DataFrame, key: str, order: str) -> DataFrame:
    """Results (source, status, output) of a run as a Markdown table."""
    line = F.concat(F.lit("| "), file_name("source"), F.lit(" | `"), or_unknown("status"), F.lit("` | "), F.coalesce("output", F.lit("")), F.lit(" |"))
    rows = in_order(results, key, [order], line, "\n")
    return rows.withColumn("text", F.concat(F.lit("| Source | Status | Output |\n| --- | --- | --- |\n"), "text"))


def csv_line(cells: Column) -> Column:
    """Cells as a line of CSV, quoted where need be."""
    one = lambda c: F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, lambda c: one(F.coalesce(c.cast("string"), F.lit("")))), ",")


def table_files(rows: DataFrame, key: str, prefix: str = "pdfplumber") -> DataFrame:
    """Rows (page, table, ordinal, cells) of tables as files: name, CSV and Markdown of each."""
    at = F.struct(key, "page", "table")
    wide = F.max(F.size("cells")).over(Window.partitionBy(key, "page", "table"))
    padded = rows.withColumn("_w", wide).withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))).withColumn("at", at)
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", table_escape), " | "), F.lit(" |"))
    ruled = F.when(F.col("ordinal") == 0, F.concat(line, F.lit("\n| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |"))).otherwise(line)
    md = in_order(padded, "at", ["ordinal"], ruled, "\n").withColumnRenamed("text", "markdown")
    csv = in_order(padded, "at", ["ordinal"], csv_line(F.col("cells")), "\n").withColumnRenamed("text", "csv")
    name = F.format_string(f"{prefix}-page-%04d-table-%02d", F.col("at.page").cast("int"), F.col("at.table").cast("int"))
    return md.join(csv, "at").select(F.col(f"at.{key}").alias(key), name.alias("name"), "csv", "markdown")


def workbook(rows: list[list[object]]) -> bytes:
    """A minimal spreadsheet of one small table, as the bytes of an OOXML file. The rows are in the driver, as the file is one."""

    def column(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    sheet = "".join(f'<row r="{r}">' + "".join(f'<c r="{column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    main, rel, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="table" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return out.getvalue()


def report(rows: DataFrame, sections: dict[str, list[str]]) -> Column:
    """A JSON report of a row: its sections, each of some columns; a section of nulls is left out."""
    parts = [F.when(F.greatest(*(F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) > 0, F.struct(*cols)).alias(name) for name, cols in sections.items()]
    return F.to_json(F.struct(*parts))


def image_places(assets: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Image assets (ordinal, markdown_path, asset_path) with the first line of the Markdown (pos, line) that shows them, 0 if none does."""
    refs = F.regexp_extract_all("line", F.lit(r'!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), 1)
    first = lines.select(key, "pos", F.explode(refs).alias("src")).groupBy(key, "src").agg((F.min("pos") + 1).alias("at"))
    a = first.select(key, F.col("src").alias("markdown_path"), F.col("at").alias("_a"))
    b = first.select(key, F.col("src").alias("asset_path"), F.col("at").alias("_b"))
    return assets.join(a, [key, "markdown_path"], "left").join(b, [key, "asset_path"], "left").withColumn("markdown_line", F.coalesce("_a", "_b", F.lit(0))).drop("_a", "_b")


def missing_files(refs: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """References whose file is not listed."""
    return refs.filter(F.coalesce(path, F.lit("")) != "").join(files.select(path).distinct(), path, "left_anti")


def large_files(files: DataFrame, most: int = LARGE_FILE) -> DataFrame:
    return files.filter(F.col("bytes") > most)


def found_patterns(files: DataFrame, patterns: list[str], path: str, text: str) -> DataFrame:
    """path, pattern of the files that hold a pattern: the patterns are a short list, so each file is read once."""
    hits = F.array_compact(F.array(*(F.when(F.contains(F.col(text), F.lit(p)), F.lit(p)) for p in patterns)))
    return files.select(path, F.explode(hits).alias("pattern"))


def output_refs(results: DataFrame) -> DataFrame:
    """Files that results (output, report, sidecar) bring, with their types."""
    md = F.col("output").rlike(r"(?i)\.(?:md|markdown)$")
    each = F.array(
        F.struct(F.when(md, "markdown").otherwise("text").alias("type"), F.col("output").alias("path")), F.struct(F.lit("conversion_report").alias("type"), F.col("report").alias("path")), F.struct(F.lit("docling_document_json").alias("type"), F.col("sidecar").alias("path"))
    )
    return results.select(F.explode(F.filter(each, lambda r: F.coalesce(r["path"], F.lit("")) != "")).alias("r")).select("r.*").distinct()


def font_headings(lines: DataFrame, key: str, most: int = 180) -> DataFrame:
    """Lines (page, ordinal, text, font_size, font) set larger than a document's body, the `most` best: title, level, score.

    The body's size is the median over lines of twenty characters or more, or over all lines where there are none.
    """
    long = F.median(F.when((F.length("text") >= 20) & (F.col("font_size") > 0), F.col("font_size")))
    sizes = lines.groupBy(key).agg(F.coalesce(long, F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(10.0)).alias("_body"))
    rows = lines.join(sizes, key).withColumn("_ratio", F.col("font_size") / F.greatest("_body", F.lit(1.0)))
    bold = F.lower(F.coalesce("font", F.lit(""))).contains("bold")
    rows = rows.filter(font_heading("text") & ((F.col("_ratio") >= 1.18) | (bold & (F.col("_ratio") >= 1.08))))
    score = F.least(F.lit(0.92), 0.55 + (F.col("_ratio") - 1) * 0.7 + F.when(bold, 0.08).otherwise(0.0))
    rows = rows.withColumns({"score": F.round(score, 6), "level": F.when(F.col("_ratio") >= 1.55, 1).when(F.col("_ratio") >= 1.32, 2).otherwise(3)})
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "page", "ordinal"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "page", "ordinal", F.trim("text").alias("title"), "level", "score")


def outline_candidates(outline: DataFrame) -> DataFrame:
    """Bookmarks (title, level, page) as heading candidates."""
    return outline.filter(F.trim("title") != "").withColumns({"title": F.trim("title"), "level": F.coalesce("level", F.lit(1)), "score": F.lit(0.95), "source": F.lit("pdf_outline")})


def provider_catalog(profiles: DataFrame) -> DataFrame:
    """Enabled remote profiles (provider, stage, enabled, location, ready) by provider: stages, how many, how many are ready."""
    rows = profiles.filter(F.coalesce("enabled", F.lit(True)) & (F.lower(F.trim(F.coalesce("location", F.lit("remote")))) == "remote"))
    return rows.groupBy(or_unknown(F.trim("provider")).alias("provider")).agg(F.array_sort(F.collect_set("stage")).alias("stages"), F.count("*").alias("profiles"), F.count_if("ready").alias("ready"))


def web_archive(inputs: Column) -> Column:
    """Whether a manifest's inputs (map) name a page's source or screenshot."""
    return F.arrays_overlap(F.map_keys(inputs), F.array(F.lit("source_html"), F.lit("source_markdown"), F.lit("screenshot")))


def time_text(seconds: Column) -> Column:
    """Epoch seconds as `yyyy-MM-dd HH:mm:ss` in the session's zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def timeout_reason(finalizing: Column, idle: Column, finalize_limit: float, idle_limit: float) -> Column:
    """Why a tool is stopped: too long at its end, else too long without output; null if neither, a limit of 0 being none."""
    return F.when(F.lit(finalize_limit > 0) & (finalizing >= finalize_limit), F.concat(F.lit("finalize timeout after "), duration(finalizing))).when(F.lit(idle_limit > 0) & (idle >= idle_limit), F.concat(F.lit("idle timeout after "), duration(idle), F.lit(" without output")))


def report_name(path: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(stem(path), r"[^\w.-]+", "_"), 1, 120), F.lit(".report.json"))
