"""The heading grammar: Markdown headings, six levels of numbered headings, page markers and noise keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, compact, strip

# The grammar's patterns.
NUMERALS = "一二三四五六七八九十百零〇"
CHAPTER = rf"^第[{NUMERALS}\d]+[章篇部卷]\s*\S"
SECTION = rf"^第[{NUMERALS}\d]+节\s*\S"
ARTICLE = rf"^第[{NUMERALS}\d]+条\s*\S"
CLAUSE = rf"^(?:（[{NUMERALS}]+）|\([{NUMERALS}]+\))\S"
ITEM = r"^\d{1,2}[.、]\s*\S"
DIGIT = r"^(?:（\d{1,2}）|\(\d{1,2}\))\S"
LEVELS = (("chapter", CHAPTER), ("section", SECTION), ("article", ARTICLE), ("parenthesized_clause", CLAUSE), ("numeric_item", ITEM), ("parenthesized_digit_item", DIGIT))
PAGE_NUMBER = r"^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$"
LEADING_NUMBER = r"^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]+"
TRAILING_NUMBER = r"[\-—–_·•]+第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$"
EDGE_MARKS = r"^[\-—–_·•]+|[\-—–_·•]+$"
END_PUNCTUATION = r"[。！？!?；;：:，,、]$"
TOC_LEADER = r"^.{2,90}(?:\.{3,}|…{2,}|·{3,})\s*\d{1,4}\s*$"
PAGE_MARKERS = (r"(?i)^<!--\s*page[:=]\s*(\d{1,5})\s*-->$", r"(?i)^\[page\s+(\d{1,5})\]$", r"(?i)^---\s*page\s+(\d{1,5})\s*---$")
BOOK_PART = r"(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\d+|Part\w+)"


def heading_level(line: Column | str) -> Column:
    """Level of a Markdown heading line, null for others."""
    marks = F.regexp_extract(strip(line), r"^(#{1,6})\s+\S", 1)
    return F.nullif(F.length(marks), F.lit(0))


def heading_title(line: Column | str) -> Column:
    return F.nullif(F.regexp_extract(strip(line), r"^#{1,6}\s+(.+?)\s*$", 1), F.lit(""))


def domain_level(title: Column | str) -> Column:
    """1 to 6 for the numbered headings, null for others."""
    out = F.when(F.lit(False), F.lit(0))
    for level, (_, pattern) in enumerate(LEVELS, 1):
        out = out.when(col(title).rlike(pattern), level)
    return out


def domain_kind(title: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in LEVELS:
        out = out.when(col(title).rlike(pattern), kind)
    return out.otherwise("unknown")


def page_marker(line: Column | str) -> Column:
    """Page number of a page marker line, null for others."""
    return F.coalesce(*(F.nullif(F.regexp_extract(strip(line), p, 1), F.lit("")).cast("int") for p in PAGE_MARKERS))


def is_page_number(line: Column | str) -> Column:
    return compact(line).rlike(PAGE_NUMBER)


def is_toc_leader(line: Column | str) -> Column:
    t = strip(line)
    return t.rlike(TOC_LEADER) & ~t.rlike(r"^(?:#|\||<!--)")


def without_page_number(key: Column) -> Column:
    """A running header's key without its page number at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(key, LEADING_NUMBER, ""), TRAILING_NUMBER, ""), EDGE_MARKS, "")


def repeated_key(line: Column | str) -> Column:
    """Key under which the repetitions of a short header or footer line are counted; empty for other lines."""
    t, k = strip(line), compact(line)
    skip = (k == "") | t.startswith("#") | t.rlike(r"(?i)^<!--\s*Page\s+\d+\s*-->\s*$") | k.rlike(BOOK_PART) | k.rlike(r"^\d{1,4}$")
    key = without_page_number(k)
    # a long line with neither mark nor number at its ends has a long key, which need not be made
    long = (F.length(k) > 24) & ~k.rlike(r"^[\-—–_·•第\d]|[\-—–_·•页\d]$")
    return F.when(long, "").when(skip | (F.length(key) > 24) | key.rlike(END_PUNCTUATION), "").otherwise(key)


def document_key(line: Column | str) -> Column:
    """The same for the cleanup of documents: up to 32 characters, case folded, no structural lines."""
    t, k = strip(line), compact(line)
    structural = F.lit(False)
    for _, pattern in LEVELS:
        structural = structural | k.rlike(pattern)
    key = without_page_number(k)
    skip = (k == "") | t.rlike(r"^(?:#|\||>|-|\*|<!--)") | structural | is_page_number(line)
    return F.when(skip | (F.length(key) > 32) | key.rlike(END_PUNCTUATION), "").otherwise(F.lower(key))


def heading_key(title: Column | str) -> Column:
    """Key under which equal headings meet: no marks, white space or punctuation, case folded."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(title), r"^#{1,6}\s*", ""), r"(?U)[\s\p{Punct}、，。：；！？（）《》“”‘’·—…]+", ""))
