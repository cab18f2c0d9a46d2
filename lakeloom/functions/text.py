"""Text helpers as Column expressions. White space and digits are Unicode, as in the rules they serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def collapse(c: Column | str, limit: int | None = None) -> Column:
    """Runs of white space as one space, none at the ends; cut to a length."""
    out = strip(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.substring(out, 1, limit) if limit else out


def lines(c: Column | str) -> Column:
    """Lines of a text; a line feed at the end does not begin another line."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n")
    return F.split(F.regexp_replace(text, r"\n$", ""), "\n")


def nonblank(c: Column | str) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the columns, each computed once for a row: behind a generator, so that no later use or filter repeats their expressions."""
    made = rows.withColumn("__once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.select(*(F.col(f"`{c}`") for c in rows.columns if c not in columns), "__once.*")


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b rounded, 0 where b is 0 or null."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def or_unknown(c: Column | str) -> Column:
    """`unknown` for null and empty."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit("unknown"))


def slug(c: Column | str, limit: int = 80) -> Column:
    """Lower-case letters, digits and hyphens; `sample` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"(?U)[^\w.-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, limit), F.lit("")), F.lit("sample"))


def normal_text(c: Column | str) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(col(c), r"(?U)[\W_]+", ""))


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha1(col(c).cast("binary")), 1, 16)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), -1)


def suffix(path: Column | str) -> Column:
    """Lower-cased suffix with its dot, empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def is_hidden(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\\", "/").rlike(r"(^|/)\.[^/.][^/]*")


def natural_key(c: Column | str) -> Column:
    """A key in which runs of digits sort by their value."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def filename_number(path: Column | str) -> Column:
    """The last run of digits in a stem."""
    found = F.regexp_extract_all(stem(path), F.lit(r"(\d+)"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("long")


def page_ranges(c: Column | str) -> Column:
    """`1-3,5` as ascending different numbers."""
    parts = F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")
    spans = F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def fence_free(c: Column | str, tags: str = "json") -> Column:
    """Without one outer code fence."""
    return F.regexp_replace(strip(c), rf"(?s)^```(?:{tags})?\s*\n(.*?)\n?```$", "$1")


def redact_paths(c: Column | str) -> Column:
    """Local paths replaced by a placeholder."""
    return F.regexp_replace(col(c), r"(?:[A-Za-z]:\\[^\s\"'<>|]+|/(?:home|Users|root|mnt|tmp)/[^\s\"'<>|]+)", "<local-path>")


def duration(seconds: Column | str) -> Column:
    """Seconds as `m:ss` or `h:mm:ss`."""
    s = F.greatest(F.lit(0), F.floor(col(seconds))).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def byte_size(n: Column | str) -> Column:
    x = col(n).cast("double")
    out = F.when(x < 1024, F.format_string("%d B", x.cast("long")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(x < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", x / 1024.0**k))
    return out.otherwise(F.format_string("%.1f TB", x / 1024.0**4))


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescape(c: Column | str) -> Column:
    """The common HTML entities as characters."""
    out = col(c)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_text(c: Column | str) -> Column:
    """Visible text of an HTML fragment: breaks and blocks as line feeds, no tags, entities decoded, lines trimmed."""
    out = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr)\s*>", "\n")
    out = unescape(F.regexp_replace(out, r"(?s)<[^>]*>", ""))
    kept = F.filter(F.transform(F.split(out, "\n"), lambda x: collapse(x)), lambda x: x != "")
    return F.array_join(kept, "\n")


def table_escape(c: Column | str) -> Column:
    """A cell of a Markdown table."""
    return F.replace(collapse(c), F.lit("|"), F.lit("\\|"))


def comment_safe(c: Column | str) -> Column:
    """Text that can stand in an HTML comment."""
    return strip(F.replace(col(c), F.lit("--"), F.lit("- -")))


def bigrams(c: Column | str) -> Column:
    """Different character pairs of the compacted lower-case text; a single character is its own."""
    t = F.lower(compact(c))
    pairs = F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), 1)
    return F.array_distinct(F.when(F.size(pairs) > 0, pairs).otherwise(F.filter(F.array(t), lambda x: x != "")))


def bigram_coverage(source: Column | str, candidate: Column | str) -> Column:
    """Share of the source's character pairs that the candidate has; without any, 1 if the candidate has text, else 0."""
    a, b = bigrams(source), bigrams(candidate)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.when(F.size(b) > 0, 1.0).otherwise(0.0))
