"""Cleaning of converted Markdown: OCR pages, repeated headers, contents lists, front matter, chapter headings, EPUB tags.

Rules between lines are windows over lines (id, pos, line) partitioned by document; what is removed stays as an HTML comment.
`joined` makes texts of lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.cleanup import footnote_references, unwrapped
from ..functions.headings import heading_key, repeated_key
from ..functions.text import col, strip
from .pages import heading_guess

# Marks of a publication page, titles of front matter, headings without a number.
PAGE_MARK = r"(?i)^<!--\s*Page\s+\d+\s*-->\s*$"
PAGE_HEADING = r"(?i)^##\s+Page\s+\d+\s*$"
CHAPTER = r"^第[一二三四五六七八九十百零〇\d]+章[\s　]*(?:.+)?$"
CLOSING = ("致谢", "结语", "后记")
FRONT_TITLES = ("扉页", "版权页", "书名页", "封面")
IMPRINT = (
    "图书在版编目", "cip", "isbn", "copyright", "all rights reserved", "书名原文", "著作权合同登记号", "出版", "出版人", "责任编辑", "特约编辑",
    "产品经理", "封面设计", "制版印刷", "经销", "发行", "地址", "邮政编码", "邮购电话", "网址", "电子信箱", "开本", "印张", "印数", "字数",
    "版次印次", "定价", "版权所有", "侵权必究", "published by arrangement", "simplified chinese translation copyright",
)
TOC_LINK = r"^(?:-|\d+\.\s+|- ) ?\[[^\]]+\]\([^)]+\)$"
DROPPED = ("# Landmarks", "# 总目录", "目录", "总目录")


def _by(id_col: str):
    return Window.partitionBy(id_col).orderBy("pos")


def joined(rows: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines as texts. A document's lines are gathered, no more than its text."""
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias(text))


def _paged(rows: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """Lines with _t (stripped), _mark, _page (number of marks so far)."""
    rows = rows.withColumn("_t", strip("line")).withColumn("_mark", mark)
    return rows.withColumn("_page", F.sum(F.col("_mark").cast("int")).over(_by(id_col)))


def _edges(rows: DataFrame, id_col: str) -> DataFrame:
    """Paged lines with _edge: among the first or the last two lines of a page that are neither blank nor comments."""
    body = (F.col("_page") > 0) & (F.col("_t") != "") & ~F.col("_t").startswith("<!--")
    own = Window.partitionBy(id_col, "_page", "_body")
    rows = rows.withColumn("_body", body)
    rows = rows.withColumns({"_up": F.row_number().over(own.orderBy("pos")), "_all": F.count("*").over(own)})
    return rows.withColumn("_edge", F.col("_body") & ((F.col("_up") <= 2) | (F.col("_up") > F.col("_all") - 2))).drop("_body", "_up", "_all")


def edge_keys(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, key: short lines that stand at the edges of four pages or more of a document of four pages or more."""
    paged = _edges(_paged(rows, id_col, strip("line").rlike(PAGE_MARK)), id_col).withColumn("key", repeated_key("line"))
    counts = paged.filter(F.col("_edge") & (F.col("key") != "")).groupBy(id_col, "key").agg(F.count("*").alias("_n"))
    return counts.filter((F.col("_n") >= 4) & (F.length("key") <= 24)).drop("_n")


def without_edge_numbers(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Printed page numbers at the edges of marked pages become comments."""
    paged = _edges(_paged(rows, id_col, strip("line").rlike(PAGE_MARK)), id_col)
    pages = F.max("_page").over(Window.partitionBy(id_col))
    gone = F.col("_edge") & predicates.ocr_page_number("_t", pages)
    return paged.withColumn("line", F.when(gone, F.concat(F.lit("<!-- removed OCR page number: "), F.col("_t"), F.lit(" -->"))).otherwise(F.col("line"))).drop("_t", "_mark", "_page", "_edge")


def _without_repeated(rows: DataFrame, id_col: str, key: Column, noisy, label: str) -> DataFrame:
    rows = rows.withColumn("_key", key)
    counts = F.count("*").over(Window.partitionBy(id_col, "_key"))
    gone = (F.col("_key") != "") & noisy(counts, F.length("_key"))
    return rows.withColumn("_gone", gone).withColumn("line", F.when(F.col("_gone"), F.concat(F.lit(f"<!-- {label}: "), strip("line"), F.lit(" -->"))).otherwise(F.col("line"))).drop("_key", "_gone")


def without_repeated_ocr(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Short lines that stand four times (longer ones six times) in a document become comments."""
    return _without_repeated(rows, id_col, repeated_key("line"), lambda n, size: (n >= 4) & ((size <= 12) | (n >= 6)), "removed repeated OCR header/footer")


def without_repeated_screens(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines of up to eighteen characters that stand three times on a book's screens become comments."""
    return _without_repeated(rows, id_col, predicates.screen_key("line"), lambda n, size: (n >= 3) & (size <= 18), "repeated screenshot header/footer")


def chapters_promoted(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Plain chapter lines as headings, with a short next line as their subtitle; closing words and appendices, too."""
    w = _by(id_col)
    t = strip("line")
    rows = rows.withColumn("_t", t)
    rows = rows.withColumns({"_before": F.coalesce(F.lag("_t").over(w), F.lit("")), "_next": F.coalesce(F.lead("_t").over(w), F.lit("")), "_after": F.coalesce(F.lead("_t", 2).over(w), F.lit(""))})
    c, plain = F.col("_t"), ~F.col("_t").startswith("#") & (F.col("_t") != "")
    alone = (F.col("_before") == "") | (F.col("_next") == "")
    chapter = plain & c.rlike(CHAPTER) & (alone | (F.length(c) <= 80))
    takes = chapter & (F.col("_next") != "") & (F.length("_next") <= 48) & (F.col("_after") == "") & ~F.col("_next").rlike(r"^[->#]")
    rows = rows.withColumns({"_chapter": chapter, "_takes": takes})
    rows = rows.withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    other = plain & alone & (c.isin(*CLOSING) | (c.startswith("附录") & (F.length(c) <= 80)))
    line = (
        F.when(F.col("_chapter") & F.col("_takes"), F.concat(F.lit("## "), c, F.lit("　"), F.col("_next")))
        .when(F.col("_chapter") | other, F.concat(F.lit("## "), c))
        .when(plain & alone & (c == "学习要点"), F.lit("### 学习要点"))
        .otherwise(F.col("line"))
    )
    return rows.withColumn("line", line).filter(~F.col("_taken")).drop("_t", "_before", "_next", "_after", "_chapter", "_takes", "_taken")


def _trimmed(rows: DataFrame, id_col: str, start: Column) -> DataFrame:
    """Lines from _start on, if what stays is enough of a long document (see predicates.safe_trim)."""
    whole = Window.partitionBy(id_col)
    rows = rows.withColumn("_start", start)
    filled = (strip("line") != "").cast("int")
    kept = F.col("pos") >= F.col("_start")
    sizes = {
        "_a": F.sum(F.length("line") + 1).over(whole), "_b": F.sum(F.when(kept, F.length("line") + 1).otherwise(0)).over(whole),
        "_c": F.sum(filled).over(whole), "_d": F.sum(F.when(kept, filled).otherwise(0)).over(whole),
    }
    rows = rows.withColumns(sizes)
    safe = (F.col("_a") < 5000) | ((F.col("_b") >= 1000) & (F.col("_b") >= F.col("_a") * 0.2) & ~((F.col("_c") >= 200) & (F.col("_d") < 25)))
    return rows.filter(F.col("_start").isNull() | ~safe | kept).drop("_start", "_a", "_b", "_c", "_d")


def without_leading_toc(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents whose first lines are three links of a contents list or more, up to a first heading, begin at that heading."""
    whole, t = Window.partitionBy(id_col), strip("line")
    other = F.min(F.when((t != "") & ~t.rlike(TOC_LINK), F.col("pos"))).over(whole)
    rows = rows.withColumn("_other", other)
    links = F.sum(F.when((t != "") & (F.col("pos") < F.col("_other")), 1).otherwise(0)).over(whole)
    heading = F.max(F.when((F.col("pos") == F.col("_other")) & t.startswith("# "), F.col("pos"))).over(whole)
    return _trimmed(rows.withColumns({"_links": links, "_heading": heading}), id_col, F.when((F.col("_links") >= 3) & (F.col("_heading") > 0), F.col("_heading"))).drop("_other", "_links", "_heading")


def without_front_matter(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents begin at the first heading that no publication page follows, if what stands before is one or is short."""
    w, whole, t = _by(id_col), Window.partitionBy(id_col), strip("line")
    mark = F.lit(False)
    for m in IMPRINT:
        mark = mark | F.contains(F.lower(t), F.lit(m))
    rows = rows.withColumns({"_t": t, "_hit": mark.cast("int")})
    near = F.sum(F.when(F.col("_t") != "", F.col("_hit")).otherwise(0)).over(w.rowsBetween(0, 29))
    title = F.trim(F.substring("_t", 3, 1_000_000))
    skip = (title.isin(*FRONT_TITLES) & (near >= 3)) | (near >= 5)
    rows = rows.withColumn("_first", F.col("_t").startswith("# ") & ~skip)
    rows = rows.withColumn("_chosen", F.min(F.when(F.col("_first"), F.col("pos"))).over(whole))
    before = (F.col("pos") < F.col("_chosen")) & (F.col("_t") != "")
    rows = rows.withColumns({"_n": F.sum(before.cast("int")).over(whole), "_h": F.sum(F.when(before, F.col("_hit")).otherwise(0)).over(whole)})
    start = F.when((F.col("_chosen") > 0) & ((F.col("_h") >= 3) | (F.col("_n") <= 5)), F.col("_chosen"))
    return _trimmed(rows, id_col, start).drop("_t", "_hit", "_first", "_chosen", "_n", "_h")


def with_toc_headings(rows: DataFrame, titles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Plain lines after a blank one that a contents list (id, title) names become headings."""
    known = titles.select(id_col, heading_key("title").alias("_key")).filter(F.col("_key") != "").distinct().withColumn("_named", F.lit(True))
    t = strip("line")
    rows = rows.withColumns({"_t": t, "_key": heading_key(t)}).withColumn("_before", F.coalesce(F.lag("_t").over(_by(id_col)), F.lit("")))
    rows = rows.join(known, [id_col, "_key"], "left")
    c = F.col("_t")
    promote = F.coalesce("_named", F.lit(False)) & (c != "") & ~c.rlike(r"^[#*>-]") & (F.length(c) <= 120) & (F.col("_before") == "")
    return rows.withColumn("line", F.when(promote, F.concat(F.lit("## "), c)).otherwise(F.col("line"))).drop("_t", "_key", "_before", "_named")


def ocr_pages(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines of an OCR text: page headings as comments, the first telling line of a page as a heading, page numbers and repeated headers as comments."""
    noise = edge_keys(rows, id_col).withColumn("_noisy", F.lit(True)).withColumnRenamed("key", "_key")
    mark = strip("line").rlike(PAGE_HEADING) | strip("line").rlike(PAGE_MARK)
    paged = _paged(rows, id_col, mark).withColumn("_key", repeated_key("line")).join(noise, [id_col, "_key"], "left")
    back = Window.partitionBy(id_col).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    paged = paged.withColumn("_next", F.coalesce(F.last(F.nullif("_t", F.lit("")), ignorenulls=True).over(back), F.lit("")))
    telling = ~F.col("_mark") & (F.col("_page") > 0) & (F.col("_t") != "") & ~predicates.ocr_header("_t") & ~F.coalesce("_noisy", F.lit(False))
    paged = paged.withColumn("_telling", telling)
    first = F.col("_telling") & (F.row_number().over(Window.partitionBy(id_col, "_page", "_telling").orderBy("pos")) == 1)
    paged = paged.withColumn("_first", first)
    number = F.regexp_extract("_t", r"(\d+)", 1)
    line = F.when(F.col("_mark"), F.concat(F.lit("<!-- Page "), number, F.lit(" -->"))).when(F.col("_first") & predicates.ocr_heading("_t", "_next"), F.concat(F.lit("## "), F.col("_t"))).otherwise(F.col("line"))
    out = paged.withColumn("line", line).select(*rows.columns)
    return without_repeated_ocr(without_edge_numbers(out, id_col), id_col)


def generic(text: Column | str) -> Column:
    """The last step of all cleaning: footnote marks, joined lines, no runs of blank lines, one line feed at the end."""
    out = F.regexp_replace(F.regexp_replace(col(text), "\r\n", "\n"), "\r", "\n")
    out = unwrapped(footnote_references(out))
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")
    return F.concat(strip(out), F.lit("\n"))


def without_st(text: Column | str) -> Column:
    """Without the st tags that some converters leave."""
    return F.regexp_replace(col(text), r"(?i)</st>|<st\b[^>]*>", "")


#: Rewrites of an EPUB's leftover HTML, in order: pattern, replacement.
EPUB_RULES = (
    (r'(?is)<nav\b[^>]*epub:type="landmarks"[^>]*>.*?</nav>', ""),
    (r'(?m)^[^\S\n]*<span id="[^"]+"></span>[^\S\n]*$\n?', ""),
    (r"(?m)^[^\S\n]*</?(?:div|svg|nav|ol|ul|li)[^>]*>[^\S\n]*$\n?", ""),
    (r"(?m)^[^\S\n]*<image[^>]*>\s*</image>[^\S\n]*$\n?", ""),
    (r"(?m)^[^\S\n]*<img [^>]*>[^\S\n]*$\n?", ""),
    (r"(?m)^[^\S\n]*<a [^>]*>[^\S\n]*(.*?)[^\S\n]*</a>[^\S\n]*$", "$1"),
    (r"(?m)^[^\S\n]*(?:# Landmarks|# 总目录|目录|总目录|\[返回总目录\]\(.*)[^\S\n]*$\n?", ""),
    (r"\A\s*!\[\]\([^)]+\)\s*\n+", ""),
    (r"(?m)^(\[[^\]]+\]\([^)]+\))[^\S\n]*$", "- $1"),
    (r"(?i)</?(?:span|font|small|nav|ol|ul|li)[^>]*>", ""),
    (r"(?is)<\s*(?:b|strong)(?:\s[^>]*)?>(.*?)</\s*(?:b|strong)\s*>", "**$1**"),
    (r"(?is)<\s*(?:i|em)(?:\s[^>]*)?>(.*?)</\s*(?:i|em)\s*>", "*$1*"),
    (r"(?is)<sup>\s*<a [^>]*>\[(\d+)\]</a>\s*</sup>", "[$1]"),
    (r"(?is)<a [^>]*>\[(\d+)\]</a>", "[$1]"),
    (r"(?is)<sup>\s*(.*?)\s*</sup>", "[$1]"),
    (r"(?i)</?(?:a|p)(?:\s[^>]*)?>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"\*\*\s*\*\*", ""),
    (r"([^\n])\n{1,2}\[(\^?\d+)\](?=\n)", "$1[$2]"),
    (r"(?m)^[^\S\n]*!\[[^\]]*\]\([^)]+\)[^\S\n]*$\n?", ""),
)


def epub_markdown(text: Column | str) -> Column:
    """Markdown of an EPUB without leftover HTML, navigation and cover images."""
    out = without_st(F.regexp_replace(F.regexp_replace(col(text), "\r\n", "\n"), "\r", "\n"))
    for pattern, new in EPUB_RULES:
        out = F.regexp_replace(out, pattern, new)
    return out


def epub_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text: the whole cleaning of EPUB Markdown."""
    rows = docs.select(id_col, F.posexplode(F.split(epub_markdown(text_col), "\n")).alias("pos", "line"))
    rows = chapters_promoted(without_front_matter(without_leading_toc(rows, id_col), id_col), id_col)
    return joined(rows, id_col).select(id_col, generic("text").alias("text"))


def screen_markdown(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines of a page's text as Markdown: headings guessed, runs of blank lines as one, repeated headers as comments."""
    rows = without_repeated_screens(rows, id_col).withColumn("_t", strip("line"))
    rows = rows.withColumn("_blank", F.coalesce(F.lag("_t").over(_by(id_col)), F.lit("")) == "")
    level = heading_guess(F.col("_t"), F.col("_blank"))
    marked = F.when(predicates.markdown_line("_t") | level.isNull(), F.col("_t")).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("_t")))
    return rows.withColumn("line", marked).filter(~((F.col("_t") == "") & F.col("_blank"))).drop("_t", "_blank")


def text_blocks(text: Column | str) -> Column:
    """Paragraphs with trimmed lines, without blank ones."""
    body = F.regexp_replace(F.regexp_replace(col(text), "\r\n", "\n"), "\r", "\n")
    blocks = F.transform(F.split(body, r"\n\s*\n+"), lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), "\n"))
    return F.filter(blocks, lambda b: b != "")


def without_repeated_start(previous: Column | str, text: Column | str, most: int = 8) -> Column:
    """A page's text without the paragraphs at its start that end the page before."""
    a, b = text_blocks(previous), text_blocks(text)
    sizes = F.reverse(F.sequence(F.lit(1), F.lit(most)))
    fits = F.filter(sizes, lambda n: (n <= F.size(a)) & (n <= F.size(b)) & (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == F.slice(b, F.lit(1), n)))
    n = F.get(fits, F.lit(0))
    return F.when(n.isNotNull(), strip(F.array_join(F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0))), "\n\n"))).otherwise(col(text))


def unique_blocks(blocks: Column) -> Column:
    """Different blocks in their order, right ends trimmed, blank ones left out."""
    trimmed = F.transform(blocks, lambda b: strip(F.array_join(F.transform(F.split(strip(b), "\n"), lambda x: F.rtrim(x)), "\n")))
    return F.array_distinct(F.filter(trimmed, lambda b: b != ""))


def markdown_tables(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Islands of pipe lines behind a header and a separator: id, start_line, end_line, rows."""
    w = _by(id_col)
    pipe = F.col("line").contains("|")
    sep = F.col("line").rlike(r"\|\s*:?-{3,}:?\s*\|")
    rows = rows.withColumns({"_pipe": pipe, "_sep": sep & F.coalesce(F.lag(pipe).over(w), F.lit(False))})
    # a separator inside a table's body is one of its rows
    rows = rows.withColumn("_run", F.sum((~F.col("_pipe")).cast("int")).over(w))
    first = F.min(F.when(F.col("_sep"), F.col("pos"))).over(Window.partitionBy(id_col, "_run"))
    rows = rows.withColumn("_first", first).filter(F.col("_pipe") & (F.col("pos") >= F.col("_first") - 1))
    return rows.groupBy(id_col, "_run").agg((F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.count("*").alias("rows")).drop("_run")


def tabular_islands(rows: DataFrame, id_col: str = "doc_id", least: int = 3) -> DataFrame:
    """Islands of three lines or more that stand in columns: id, start_line, end_line, rows, columns."""
    t = strip("line")
    cells = F.size(F.split(t, r"\s{2,}|\t+"))
    rows = rows.withColumns({"_t": t, "_cells": cells}).withColumn("_in", F.col("_t").contains("\t") | (F.size(F.split("_t", r"\s{2,}")) >= 3))
    rows = rows.withColumn("_run", F.sum((~F.col("_in")).cast("int")).over(_by(id_col))).filter("_in")
    out = rows.groupBy(id_col, "_run").agg((F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.count("*").alias("rows"), F.max("_cells").alias("columns"))
    return out.filter(F.col("rows") >= least).drop("_run")


def formulas(text: Column | str) -> Column:
    """LaTeX of a text: display formulas, then inline ones outside of them, as array of struct(kind, latex)."""
    body = col(text)
    tidy = lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))
    found = lambda pattern, kind, source: F.transform(F.filter(F.transform(F.regexp_extract_all(source, F.lit(pattern), 1), tidy), predicates.latex), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("latex")))
    rest = F.regexp_replace(body, r"(?s)\$\$.+?\$\$", " ")
    return F.concat(found(r"(?s)\$\$(.+?)\$\$", "isolated", body), found(r"(?s)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)", "embedding", rest))


def fallback_messages(rows: DataFrame, stamp: Column) -> DataFrame:
    """Lines (line) of a screenshot without coordinates as messages: kind, speaker, side, confidence, review flags."""
    t = strip("line")
    rows = rows.withColumn("text", t).filter(F.col("text") != "")
    kind = F.when(stamp, "timestamp").when(predicates.system_line("text"), "system").otherwise("message")
    plain = kind == "message"
    return rows.withColumns(
        {
            "kind": kind,
            "speaker": F.when(plain, "unknown").otherwise("system"),
            "side": F.when(plain, "unknown").otherwise("center"),
            "confidence": F.when(plain, 0.20).otherwise(0.75),
            "review_flags": F.when(plain, F.array(F.lit("missing_ocr_coordinates"), F.lit("unknown_speaker"))).otherwise(F.array().cast("array<string>")),
        }
    )


def order_reason(previous: Column, page: Column, overlap: Column, section: Column, file_number: Column) -> Column:
    """Why a page follows another: printed numbers first, then overlapping text, a new section, the file's number."""
    step = page - previous
    numbers = F.when(step == 1, "page_number_continuity").when(step > 1, F.concat(F.lit("page_number_gap_"), step.cast("string"))).otherwise("page_number_conflict")
    return (
        F.when(previous.isNotNull() & page.isNotNull(), numbers)
        .when(overlap > 0, F.concat(F.lit("text_overlap_"), overlap.cast("string")))
        .when(section, "starts_new_section")
        .when(file_number.isNotNull(), "filename_number")
        .otherwise("fallback_order")
    )


def split_order(pages: DataFrame, book: str) -> DataFrame:
    """Order of pages cut from one long image: only books all of whose pages are pieces of one group."""
    one = pages.groupBy(book).agg(F.count("*").alias("_n"), F.count("split_index").alias("_k"), F.countDistinct("split_group").alias("_g"))
    books = one.filter((F.col("_n") == F.col("_k")) & (F.col("_g") == 1)).select(book)
    rank = F.row_number().over(Window.partitionBy(book).orderBy("split_index", "y_start", F.lower("name")))
    return pages.join(books, book, "left_semi").withColumns({"order_index": rank, "order_confidence": F.lit(0.99)})
