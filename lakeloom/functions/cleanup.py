"""Rewrites of Markdown: footnotes, hard-wrapped paragraphs, packed pieces of long texts, cuts of long images, OCR boxes.

Rules that test the accumulated text are folds over an in-row array, so they stay in Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

PLAIN = r"^(?!(?:#|-|\*|>|\||```))(?!\d+\.\s)(?!\[[^\]]+\]:)(?!!\[[^\]]*\]\([^)]+\)$).+"
SENTENCE_END = r"[。！？!?；;：:”’」』】》]$"


def footnote_references(text: Column | str) -> Column:
    """[3] as [^3]."""
    return F.regexp_replace(col(text), r"\[(\d+)\]", "[^$1]")


def with_footnotes(text: Column | str, notes: Column) -> Column:
    """A text with the notes (map of number to text) in a section at its end; without notes the text as it is."""
    entries = F.array_sort(F.map_entries(notes))
    block = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("[^"), e["key"].cast("string"), F.lit("]: "), e["value"])), "\n")
    body = F.regexp_replace(col(text), r"(?s)(?<=^|\n)## 注释[^\S\n]*(?:\n.*?)?(?=\n## |\z)", "")
    return F.when(F.size(entries) > 0, F.concat(F.regexp_replace(body, r"(?U)\s+$", ""), F.lit("\n\n## 注释\n\n"), block, F.lit("\n"))).otherwise(col(text))


def unwrapped(text: Column | str) -> Column:
    """Consecutive plain lines of more than eight characters joined until one ends a sentence; other lines as they are."""
    lines = F.transform(F.split(col(text), "\n"), strip)
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def step(acc, line):
        before = last(acc)
        joins = before.rlike(PLAIN) & line.rlike(PLAIN) & (F.length(before) > 8) & (F.length(line) > 8) & ~before.rlike(SENTENCE_END)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(before, line)))).otherwise(F.concat(acc, F.array(line)))

    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), step), "\n")


def packed(text: Column | str, limit: int) -> Column:
    """Paragraphs packed greedily into pieces of at most `limit` characters; a longer paragraph is cut."""
    paragraphs = F.transform(F.split(col(text), r"\n{2,}"), strip)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        joined = F.when(acc["open"] != "", F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p)
        full = (acc["open"] != "") & (F.length(joined) > limit)
        cut = ~full & (F.length(joined) > limit)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(joined), F.lit(1)) - 1) / limit).cast("int")), lambda i: F.substring(joined, i * limit + 1, F.lit(limit)))
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).when(cut, F.concat(acc["done"], pieces)).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, p).when(cut, F.lit("")).otherwise(joined).alias("open"))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def with_markers(source: Column | str, repaired: Column | str) -> Column:
    """The repaired text with the source's page and image markers that it lost in front."""
    marks = F.regexp_extract_all(col(source), F.lit(r"(?m)^<!--\s*source-(?:page|image):\s*\d+\s*-->\s*?$"), 0)
    lost = F.filter(marks, lambda m: ~col(repaired).contains(m))
    return F.when(F.size(lost) > 0, F.concat(F.array_join(lost, "\n"), F.lit("\n\n"), F.regexp_replace(col(repaired), r"(?U)^\s+", ""))).otherwise(col(repaired))


def image_cuts(height: Column, chunk: int = 2200, overlap: int = 160) -> Column:
    """Start and end of the overlapping cuts of a long image."""
    chunk = max(400, chunk)
    step = chunk - max(0, min(overlap, chunk // 2))
    starts = F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0)), F.lit(step))
    cuts = F.transform(starts, lambda y: F.struct(y.alias("start"), F.least(height, y + chunk).alias("end")))
    first_whole = F.filter(cuts, lambda c: (c["start"] == 0) | (c["start"] + (chunk - step) < height))
    return F.when(height > 0, first_whole).otherwise(F.slice(cuts, 1, 0))


def polygon_box(points: Column) -> Column:
    """Box of a polygon (array of [x, y]), rounded to hundredths; null without points."""
    xs, ys = F.transform(points, lambda p: p[0].cast("double")), F.transform(points, lambda p: p[1].cast("double"))
    return F.when(F.size(points) > 0, F.array(F.round(F.array_min(xs), 2), F.round(F.array_min(ys), 2), F.round(F.array_max(xs), 2), F.round(F.array_max(ys), 2)))


def ordered_box(box: Column) -> Column:
    """A box with its corners in order, rounded to hundredths; null unless it has four numbers."""
    low, high = lambda i: F.round(F.least(box[i], box[i + 2]), 2), lambda i: F.round(F.greatest(box[i], box[i + 2]), 2)
    return F.when((F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull()), F.array(low(0), low(1), high(0), high(1)))
