"""HTML pages: headings, visible text, links, images, URL parts, table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, html_text, unescape


def plain(c: Column) -> Column:
    return collapse(unescape(F.regexp_replace(c, r"(?s)<[^>]*>", "")))


def headings(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, n (from 1), level, title of the headings of each page."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), 0)
    rows = pages.select(id_col, F.posexplode(found).alias("n", "raw"))
    return rows.select(id_col, (F.col("n") + 1).alias("n"), F.regexp_extract("raw", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), plain(F.col("raw")).alias("title"))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    return html_text(html)


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, href, label of the links of each page."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), 0)
    rows = pages.select(id_col, F.explode(found).alias("raw"))
    return rows.select(id_col, F.regexp_extract("raw", r"(?is)href=[\"']([^\"']*)[\"']", 1).alias("href"), plain(F.col("raw")).alias("label"))


def nav_titles(html: Column) -> Column:
    """Different titles of the links inside nav elements, in order."""
    inside = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<nav\b.*?</nav>"), 0), " ")
    found = F.transform(F.regexp_extract_all(inside, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), plain)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def image_sources(html: Column) -> Column:
    """Different local image sources of HTML and Markdown, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*?src=[\"']([^\"']+)[\"']"), 1)
    marks = F.regexp_extract_all(html, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), 1)
    return F.array_distinct(F.filter(F.concat(tags, marks), lambda x: ~x.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)")))


def url_parts(url: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)).alias("host"),
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
    )
