"""Tests of lines and pages by their text: contents, tables, noise, headings, formulas; and guards of rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, compact, count_where, lines, strip

# The rules' words and patterns.
OCR_HEADERS = ("高中医", "名老中医走路", "多老中医建露", "老中医", "·老中匠")
FRONT_LINES = ("目录", "序", "编者的话", "出版者的话")
TOC_WORDS = ("目录", "contents", "table of contents")
SYSTEM_LINES = (r"^.+撤回了一条消息$", r"^.+(?:加入|退出)了群聊$", r"^.+拍了拍.+$", r"^(?:以下|以上)是.+内容$", r"^你已添加了.+现在可以开始聊天了$", r"^消息已发出，但被对方拒收了$")
SENTENCE_MARK = r"[。！？!?；;，,]$"
MATH_MARKS = ("\\", "_", "^", "=", "{", "}", "∑", "∫", "α", "β", "γ")
CREDENTIAL_NAMES = (
    "access_token", "accesstoken", "api_key", "apikey", "auth_token", "authorization", "authtoken", "bearer", "client_secret",
    "clientsecret", "credentials", "password", "private_key", "privatekey", "refresh_token", "refreshtoken", "secret", "token", "x_api_key", "xapikey", "x_api_key", "xapikey",
)
CREDENTIAL_ENDS = ("_access_token", "_api_key", "_auth_token", "_client_secret", "_id_token", "_private_key", "_refresh_token", "_secret")
CREDENTIAL_SAFE = (
    "api_keys_exposed", "api_keys_copied", "api_keys_persisted_in_artifacts", "credential_artifact_scan", "credential_ready_profile_count",
    "credential_status_available", "credential_store", "max_tokens", "token_budget", "token_count",
)


def _begins(c: Column, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(c, F.lit(m))
    return out


def _found(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), 0))


def _filled(text: Column | str) -> Column:
    return F.filter(lines(text), lambda x: strip(x) != "")


def toc_page(text: Column | str) -> Column:
    """A page of contents: a word for it, three dot leaders or five numbered lines."""
    t, low = F.coalesce(col(text), F.lit("")), F.lower(F.coalesce(col(text), F.lit("")))
    word = F.lit(False)
    for w in TOC_WORDS:
        word = word | low.contains(w)
    numbered = _found(low, r"(?m)^\s*(?:第.+章|chapter\s+\d+|[一二三四五六七八九十]+[、.])")
    return (t != "") & (word | (_found(t, r"\.{3,}\s*\d{1,4}") >= 3) | (numbered >= 5))


def table_page(text: Column | str) -> Column:
    """Four lines in columns, or four lines of four numbers."""
    rows = _filled(text)
    columns = count_where(rows, lambda x: x.contains("\t") | (_found(x, r"\s{2,}") >= 3))
    numbers = count_where(rows, lambda x: _found(x, r"\d+(?:[.,]\d+)?") >= 4)
    return (columns >= 4) | (numbers >= 4)


def fragmented(markdown: Column | str) -> Column:
    """Six lines or more, of which seven in ten are short."""
    bare = F.transform(F.filter(_filled(markdown), lambda x: ~F.ltrim(x).startswith("<!--")), lambda x: strip(F.regexp_replace(x, r"^\s*(?:#{1,6}|[-*+]\s+|\d+[.)]\s+)", "")))
    return (F.size(bare) >= 6) & (count_where(bare, lambda x: F.length(x) <= 36) / F.greatest(F.size(bare), F.lit(1)) >= 0.7)


def tabular(markdown: Column | str) -> Column:
    """Two lines or more with two pipes."""
    return count_where(lines(markdown), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) >= 2


def contents_lines(text: Column | str) -> Column:
    """Three lines of five or more that end in a page number behind a leader, a gap or a chapter."""
    rows = F.transform(_filled(text), strip)
    return (F.size(rows) >= 5) & (count_where(rows, lambda x: x.rlike(r"(\.{2,}|\s{2,}|第.+[章节篇部]).{0,60}\d{1,4}$")) >= 3)


def short_lines(text: Column | str) -> Column:
    """Eight lines or more, most of them of up to twelve characters."""
    rows = F.transform(_filled(text), strip)
    return (F.size(rows) >= 8) & (count_where(rows, lambda x: F.length(x) <= 12) / F.greatest(F.size(rows), F.lit(1)) > 0.55)


def odd_characters(text: Column | str) -> Column:
    """More than three odd marks in a hundred characters."""
    t = compact(F.coalesce(col(text), F.lit("")))
    return (F.length(t) >= 40) & (_found(t, r"[□�|]|[A-Za-z]{1,2}[^\w\s][A-Za-z]{1,2}") / F.greatest(F.length(t), F.lit(1)) > 0.03)


def safe_trim(original: Column | str, candidate: Column | str) -> Column:
    """Whether a trimmed text keeps enough of a long one."""
    a, b = F.length(strip(original)), F.length(strip(candidate))
    most = (F.size(_filled(original)) >= 200) & (F.size(_filled(candidate)) < 25)
    return (a < 5000) | ((b >= 1000) & (b >= a * 0.2) & ~most)


def probe_error(line: Column | str) -> Column:
    low = F.lower(col(line))
    return _begins(low, "traceback", "error") | low.contains("not recognized") | low.contains("exception")


def external_image(src: Column | str) -> Column:
    return _begins(F.lower(col(src)), "http://", "https://", "data:", "file:")


def ocr_header(line: Column | str) -> Column:
    c = col(line)
    return c.isin(*OCR_HEADERS) | (_begins(c, "·", "•") & (F.length(c) <= 12))


def ocr_heading(line: Column | str, following: Column | str) -> Column:
    """Whether a short line at the top of an OCR page is a heading, by the next line that is not blank."""
    c, n = col(line), col(following)
    skip = (c == "") | _begins(c, "#", "-", "*", ">", "|", "<!--") | (F.length(c) > 24) | c.rlike(r"^[\d\s().（）\-—–]+$") | c.rlike(r"^[A-Za-z]{1,8}$") | ocr_header(c) | c.isin("目", "录", "MULU")
    return ~skip & ((n == "") | (F.length(n) >= 18) | c.isin(*FRONT_LINES))


def ocr_page_number(line: Column | str, pages: Column) -> Column:
    """A printed page number; one of four digits or more counts up to twenty past the pages."""
    number = F.regexp_extract(compact(line), r"^[\-—–_·•]*第?(\d{1,4})页?(?:/\d{1,4})?[\-—–_·•]*$", 1)
    return (number != "") & ~((F.length(number) >= 4) & (F.nullif(number, F.lit("")).cast("int") > pages + 20))


def layout_heading(text: Column | str) -> Column:
    c = col(text)
    return (c != "") & (F.length(c) <= 120) & ~c.rlike(SENTENCE_MARK)


def font_heading(text: Column | str) -> Column:
    c = strip(text)
    return (c != "") & (F.length(c) <= 80) & ~_begins(c, "-", "*", ">", "|") & ~c.rlike(r"^\d{1,4}$") & ~c.rlike(SENTENCE_MARK)


def external_candidate(line: Column | str, alone: Column, score: Column, source: Column) -> Column:
    """Whether a heading candidate from elsewhere is taken: a plain line on its own, and a good score or the outline's word."""
    c = strip(line)
    return (c != "") & ~_begins(c, "#", "-", "*", ">", "|", "<!--") & (F.length(c) <= 100) & alone & ((score >= 0.65) | (source == "pdf_outline"))


def markdown_line(line: Column | str) -> Column:
    """A line that is Markdown or a tag already."""
    return col(line).rlike(r"^#{1,6}\s+\S+|^>\s+|^(?:\||[-*+]\s+|\d+[.)]\s+)|^</?\w+[^>]*>$")


def latex(text: Column | str) -> Column:
    c = F.trim(F.coalesce(col(text), F.lit("")))
    inner = F.when(_begins(c, "$") & c.endswith("$"), F.trim(F.regexp_replace(c, r"^\$+|\$+$", ""))).otherwise(c)
    mark = F.lit(False)
    for m in MATH_MARKS:
        mark = mark | F.contains(inner, F.lit(m))
    return (F.length(c) >= 2) & (mark | inner.rlike(r"[A-Za-z0-9]\s*[+\-*/<>]\s*[A-Za-z0-9]"))


def system_line(text: Column | str) -> Column:
    """A chat's own notice."""
    c = compact(F.coalesce(col(text), F.lit("")))
    out = F.lit(False)
    for p in SYSTEM_LINES:
        out = out | c.rlike(p)
    return out


def credential_name(key: Column | str) -> Column:
    """Whether a field of that name holds a credential."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(col(key), F.lit("")))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    ends = F.lit(False)
    for e in CREDENTIAL_ENDS:
        ends = ends | name.endswith(e)
    return (name != "") & ~name.isin(*CREDENTIAL_SAFE) & (name.isin(*CREDENTIAL_NAMES) | F.replace(name, F.lit("_"), F.lit("")).isin(*CREDENTIAL_NAMES) | ends)


def screen_key(line: Column | str) -> Column:
    """Key under which repeated screenshot headers and footers are counted; empty for other lines."""
    k = compact(F.coalesce(col(line), F.lit("")))
    other = (F.length(k) > 24) | k.rlike(r"^\d{1,4}$") | k.rlike(r"(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\d+|Part\w+)") | k.rlike(r"[。！？!?；;：:，,、]$")
    return F.when(other, "").otherwise(k)


def table_evidence(table_count: Column, targets: Column, roles: Column) -> Column:
    """Whether a review page has a table to look at: a count, a target or an artifact's role."""
    return (F.coalesce(table_count, F.lit(0)) > 0) | F.array_contains(targets, "table_candidates") | F.exists(roles, lambda r: r.startswith("table_"))


def formula_evidence(formula_count: Column, targets: Column, roles: Column) -> Column:
    return (F.coalesce(formula_count, F.lit(0)) > 0) | F.array_contains(targets, "formula_candidates") | F.exists(roles, lambda r: r.startswith("formula_"))


FORMULA_KINDS = ("formula", "isolated", "embedding", "latex", "math", "math_formula")


def formula_item(kind: Column, has_latex: Column, text: Column) -> Column:
    """Whether an item is a formula by its kind, a formula field, or the word in its kind with some text."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return k.isin(*FORMULA_KINDS) | has_latex | (k.contains("formula") & (F.trim(F.coalesce(text, F.lit(""))) != ""))


def calibre_fallback(suffix: Column, markdown: Column, direct_failed: Column, level: Column, headings: Column) -> Column:
    """Whether a book is tried again by way of the converter: after a failure, or for a poor or headless Markdown text."""
    return suffix.isin(".epub", ".fb2", ".odt") & F.when(~markdown, direct_failed).otherwise(direct_failed | (level == "poor") | (headings == 0))


RETRYABLE = ("models.datalab.to", "failed to establish a new connection", "max retries exceeded", "connectionerror", "marker completed but no markdown file was produced")


def pdf_tool_fallback(selected: Column, error: Column, details: Column) -> Column:
    """Whether the fast route takes over from a PDF tool, by the kind of its error (timeout, failed, missing, process, other)."""
    low, retry = F.lower(F.coalesce(details, F.lit(""))), F.lit(False)
    for m in RETRYABLE:
        retry = retry | low.contains(m)
    other = selected.isin("marker", "mineru", "docling", "pdfcraft", "olmocr")
    return (selected != "pymupdf4llm") & F.when(error.isin("timeout", "failed", "missing"), True).when(error == "process", retry).otherwise(other)


def docling_fallback(suffix: Column) -> Column:
    return suffix.isin(".docx", ".html", ".htm", ".md", ".csv", ".tsv")


def hard_failed(status: Column) -> Column:
    return F.coalesce(status, F.lit("")).isin("failed", "timeout", "unsupported", "no_job")
