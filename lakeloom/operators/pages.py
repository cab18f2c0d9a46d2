"""Page records of image books: page numbers, titles, layout, near-duplicates and order.

Rules on one page are Column expressions. Duplicate leaders and the order of a book depend on the pages before, so they are
folds over one book's pages (applyInPandas by book); a book is the largest unit of work.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, ratio, strip

SIMILAR, LEAST_CHARS, HASHED_CHARS = 0.92, 40, 20
END = r"[。！？.!?，,；;：:]$"


def heading_guess(line: Column, previous_blank: Column) -> Column:
    """Heading level that a plain line suggests, null if none."""
    dotted = F.regexp_extract(line, r"^(\d+(?:\.\d+){0,3})[\s、.．]+", 1)
    dots = F.length(dotted) - F.length(F.replace(dotted, F.lit("."), F.lit("")))
    chapter = line.rlike(r"(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\s+\d+|Part\s+\w+)\b")
    short = previous_blank & F.length(line).between(2, 28) & ~line.rlike(END)
    return F.when(chapter, 2).when(dotted != "", F.least(2 + dots, F.lit(5))).when(short, 3)


def title_score(line: Column, index: Column, previous_blank: Column, next_blank: Column) -> Column:
    """Likelihood of a title from eleven signals, 0 to 1."""
    signals = (
        (heading_guess(line, previous_blank).isNotNull(), 0.55),
        (index <= 6, 0.12),
        (previous_blank, 0.08),
        (next_blank, 0.08),
        (F.length(line).between(2, 32) & ~line.rlike(END), 0.18),
        (line.rlike(r"(?i)^(?:序|前言|目录|后记|附录|致谢|引言|绪论)$"), 0.25),
        (line.rlike(r"(?i)^(?:chapter|section|part)\b"), 0.18),
        (line.rlike(r"^\d+(?:\.\d+){0,3}\s+.+"), 0.20),
        (line.rlike(r"^[\-•·*]\s+"), -0.35),
        (F.length(line) > 48, -0.30),
        (line.rlike(r"[。！？.!?]$"), -0.25),
    )
    total = F.lit(0).cast("decimal(4,2)")
    for test, points in signals:
        total = total + F.when(test, F.lit(points).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total.cast("double")))


def title_candidates(lines: DataFrame, id_col: str, limit: int = 6, least: float = 0.42) -> DataFrame:
    """The likeliest titles of each page of lines (id, pos, t): rank, title, confidence."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("pos")
    before = F.coalesce(F.lag("t").over(w), F.lit("")) == ""
    after = F.coalesce(F.lead("t").over(w), F.lit("")) == ""
    rows = lines.withColumns({"_b": before, "_a": after}).filter("t <> ''")
    rows = rows.withColumn("confidence", title_score(F.col("t"), F.col("pos"), F.col("_b"), F.col("_a"))).filter(F.col("confidence") >= least)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("confidence"), "pos"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select(id_col, "rank", F.col("t").alias("title"), F.round("confidence", 3).alias("confidence"))


def page_number(text: Column, filename_number: Column) -> Column:
    """Page number printed in the first or last eight lines; the file's number where the print begins with it."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    edge = F.concat(F.slice(lines, 1, 8), F.slice(lines, F.greatest(F.size(lines) - 7, F.lit(1)), F.lit(8)))
    printed = F.transform(edge, lambda x: F.regexp_extract(x, r"\b0*(\d{1,4})\s*[/／]\s*0*\d{1,4}\b", 1))
    digits = F.transform(edge, lambda x: F.regexp_replace(x, r"\D+", ""))
    named = F.exists(digits, lambda x: (F.length(x) >= 3) & (x.startswith(filename_number.cast("string")) | x.startswith(F.lpad(filename_number.cast("string"), 2, "0")) | x.startswith(F.lpad(filename_number.cast("string"), 3, "0"))))
    alone = F.filter(F.transform(edge, lambda x: F.regexp_extract(x, r"(?:第\s*)?(\d{1,5})(?:\s*页)?$", 1)), lambda x: x != "")
    slashed = F.try_element_at(F.filter(printed, lambda x: x != ""), F.lit(1)).cast("int")
    return F.coalesce(slashed, F.when(F.coalesce(named, F.lit(False)), filename_number.cast("int")), F.try_element_at(alone, F.lit(-1)).cast("int"))


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of the page, clamped; boxes that are shares already stay."""
    small = (F.greatest(F.abs(box[0]), F.abs(box[2])) <= 1.5) & (F.greatest(F.abs(box[1]), F.abs(box[3])) <= 1.5)
    part = lambda v, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(small, v).otherwise(v / size))), 4)
    return F.when((F.size(box) == 4) & (width > 0) & (height > 0), F.array(part(box[0], width), part(box[1], height), part(box[2], width), part(box[3], height)))


def region(box: Column) -> Column:
    """One of nine regions by the centre of a unit box."""
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return F.concat(F.when(y < 0.33, "top").when(y > 0.67, "bottom").otherwise("middle"), F.lit("-"), F.when(x < 0.33, "left").when(x > 0.67, "right").otherwise("center"))


def layout_profile(pages: DataFrame) -> DataFrame:
    """pages (text, width, height, boxes) with line and box statistics, signals, and whether the page looks like an infographic."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), strip), lambda x: x != "")
    rows = pages.withColumns({"_l": lines, "_u": F.filter(F.transform("boxes", lambda b: unit_box(b, F.col("width"), F.col("height"))), lambda u: u.isNotNull())})
    centre = F.transform("_u", lambda u: (u[0] + u[2]) / 2)
    columns = [F.size(F.filter(centre, t)) >= 3 for t in (lambda x: x < 0.33, lambda x: (x >= 0.33) & (x <= 0.67), lambda x: x > 0.67)]
    n = F.greatest(F.size("_l"), F.lit(1))
    rows = rows.withColumns(
        {
            "line_count": F.size("_l"),
            "box_count": F.size("boxes"),
            "short_line_ratio": ratio(F.size(F.filter("_l", lambda x: F.length(x) <= 18)), n),
            "bullet_like_ratio": ratio(F.size(F.filter("_l", lambda x: x.rlike(r"^(?:[\-•·*]|\d+[.、．])\s*"))), n),
            "aspect_ratio": ratio(F.col("width"), F.col("height")),
            "active_columns": sum((c.cast("int") for c in columns), F.lit(0)),
            "regions": F.array_sort(F.transform("_u", region)),
        }
    )
    c = F.col
    signals = F.array_compact(
        F.array(
            F.when((c("box_count") >= 12) & (c("active_columns") >= 2), "multi_region_ocr_blocks"),
            F.when((c("line_count") >= 10) & (c("short_line_ratio") >= 0.55), "short_label_dense"),
            F.when(c("bullet_like_ratio") >= 0.35, "list_or_flow_dense"),
            F.when((c("aspect_ratio") >= 1.65) | ((c("aspect_ratio") > 0) & (c("aspect_ratio") <= 0.62)), "non_page_aspect_ratio"),
        )
    )
    rows = rows.withColumn("signals", signals)
    return rows.withColumn("likely_infographic", (F.size("signals") > 0) & ((c("line_count") >= 8) | (c("box_count") >= 8))).drop("_l", "_u")


def similar(left: str, right: str) -> bool:
    a, b = "".join(left.split()).lower(), "".join(right.split()).lower()
    return len(a) > LEAST_CHARS and len(b) > LEAST_CHARS and SequenceMatcher(None, a, b).ratio() >= SIMILAR


def mark_duplicates(pages: DataFrame, book: str = "book", order: str = "ordinal") -> DataFrame:
    """pages (book, ordinal, name, text, image_hash) with duplicate_group (from 1) and whether the page represents it.

    In order, a page joins the first group whose first page it repeats: equal image, equal long text, or similar text. The
    longest text of the shortest name represents a group.
    """

    def of_book(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        groups: list[list[int]] = []
        for i, page in pdf.iterrows():
            text = page["text"] or ""
            for members in groups:
                first = pdf.loc[members[0]]
                other = first["text"] or ""
                same_image = bool(page["image_hash"]) and page["image_hash"] == first["image_hash"]
                same_text = len(other) > HASHED_CHARS and "".join(text.split()).lower() == "".join(other.split()).lower()
                if same_image or same_text or similar(other, text):
                    members.append(i)
                    break
            else:
                groups.append([i])
        number, best = {}, set()
        for g, members in enumerate(groups, 1):
            number |= dict.fromkeys(members, g)
            best.add(max(members, key=lambda i: (len(pdf.loc[i, "text"] or ""), -len(pdf.loc[i, "name"]))))
        pdf["duplicate_group"] = [number[i] for i in range(len(pdf))]
        pdf["represents"] = [i in best for i in range(len(pdf))]
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields) + ", duplicate_group int, represents boolean"
    return pages.groupBy(book).applyInPandas(of_book, schema)


#: Characters at a page's ends that may overlap, and of a gram that two ends must share to be compared.
ENDS, END_GRAM = 500, 6


def overlap(left: str, right: str, limit: int = ENDS) -> int:
    """Longest end of the left text that begins the right one: equal from 8 characters, similar from 12."""
    a, b = "".join((left or "").split())[-limit:], "".join((right or "").split())[:limit]
    for n in range(min(len(a), len(b)), 7, -1):
        if a[-n:] == b[:n] or (n >= 12 and SequenceMatcher(None, a[-n:], b[:n]).ratio() >= 0.82):
            return n
    return 0


def overlaps(pages: DataFrame, book: str = "book", name: str = "name") -> DataFrame:
    """book, before, after, overlap of the pages of a book whose ends overlap.

    Pages are joined on grams that one's end and the other's beginning share, and each pair is measured once, in any task; only its
    two ends travel.
    """
    body = compact(F.coalesce("text", F.lit("")))
    ends = pages.select(book, name, F.substring(body, -ENDS, ENDS).alias("tail"), F.substring(body, 1, ENDS).alias("head"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - END_GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(END_GRAM))))
    a = ends.select(book, F.col(name).alias("before"), F.explode(grams(F.col("tail"))).alias("g"))
    b = ends.select(book, F.col(name).alias("after"), F.explode(grams(F.col("head"))).alias("g"))
    pairs = a.join(b, [book, "g"]).filter("before <> after").select(book, "before", "after").distinct()
    pairs = pairs.join(ends.select(book, F.col(name).alias("before"), "tail"), [book, "before"]).join(ends.select(book, F.col(name).alias("after"), "head"), [book, "after"])

    def measure(batches):
        for t in batches:
            n = [overlap(x, y) for x, y in zip(t.column(3).to_pylist(), t.column(4).to_pylist(), strict=True)]
            keep = pa.array([k > 0 for k in n])
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(n, pa.int32())], [book, "before", "after", "overlap"]).filter(keep)

    kind = pages.schema[book].dataType.simpleString()
    return pairs.select(book, "before", "after", "tail", "head").mapInArrow(measure, f"`{book}` {kind}, before string, after string, overlap int")


def _walk(pages: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Orders one book from its pages' numbers and its overlaps; texts are not needed any more."""
    pages = pages.sort_values(["tier", "number", "second", "low"], kind="stable").reset_index(drop=True)
    shared = {(r.before, r.after): int(r.overlap) for r in links.itertuples()}
    names, numbers, trust = pages["name"].tolist(), pages["page_number"].tolist(), pages["trust"].tolist()
    numbers = [None if pd.isna(x) else int(x) for x in numbers]
    rest, now = list(range(len(names))), 0
    if any(x is None for x in numbers):
        into, out = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for (x, y), n in shared.items():
            out[x], into[y] = max(out[x], n), max(into[y], n)
        now = min(rest, key=lambda i: (into[names[i]], -out[names[i]], i))  # little comes before a first page, much after it
    found = []
    sure, met = trust[now], 0
    while True:
        rest.remove(now)
        found.append((now, sure, met))
        if not rest:
            break
        best = None
        for place, i in enumerate(rest):
            n = 0
            if numbers[now] is not None and numbers[i] is not None:
                step = numbers[i] - numbers[now]
                fit = 0.95 if step == 1 else max(0.15, 0.75 - 0.03 * min(step, 20)) if step > 1 else 0.02
            else:
                n = shared.get((names[now], names[i]), 0)
                fit = 0.9 if n >= 80 else 0.75 if n >= 30 else 0.35
            score = fit + 0.08 * trust[i] + max(0.0, 0.04 - 0.001 * place)
            if best is None or score > best[0]:
                best = (score, i, n)
        now, sure, met = best[1], min(max(best[0], 0.0), 1.0), best[2]
    return pages.assign(order_index=pd.Series({i: k for k, (i, _, _) in enumerate(found, 1)}), confidence=pd.Series({i: c for i, c, _ in found}), overlap=pd.Series({i: n for i, _, n in found}))


def infer_order(pages: DataFrame, book: str = "book") -> DataFrame:
    """pages (book, name, text, page_number, filename_number; names differ within a book) with order_index (from 1), confidence and overlap with the page before.

    What costs, the comparison of page ends, is a join over all books; the walk from page to page sees a book's numbers only.
    """
    has, filed = F.col("page_number").isNotNull(), F.col("filename_number").isNotNull()
    light = pages.select(
        book, "name", "page_number", F.when(has, 0).when(filed, 1).otherwise(2).alias("tier"), F.coalesce("page_number", "filename_number", F.lit(0)).cast("long").alias("number"),
        F.when(has, F.coalesce("filename_number", F.lit(0))).otherwise(0).cast("long").alias("second"), F.lower("name").alias("low"), F.when(has, 0.9).when(filed, 0.65).otherwise(0.45).alias("trust"),
    )
    links = overlaps(pages, book)

    def of_book(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[book, "name", "order_index", "confidence", "overlap"])
        return _walk(left, right)[[book, "name", "order_index", "confidence", "overlap"]]

    kind = pages.schema[book].dataType.simpleString()
    placed = light.groupBy(book).cogroup(links.groupBy(book)).applyInPandas(of_book, f"`{book}` {kind}, name string, order_index int, confidence double, overlap int")
    return pages.join(placed, [book, "name"])


def rebuild(pages: DataFrame, order: DataFrame, key: str = "name") -> DataFrame:
    """Pages in a hand-made order (key, rank); pages it does not name follow in their own order. missing: named but absent."""
    named = order.join(pages, key, "left").withColumn("missing", F.col("text").isNull())
    rest = pages.join(order, key, "left_anti").withColumns({"rank": F.lit(None).cast("int"), "missing": F.lit(False)})
    return named.unionByName(rest)


def text_hash(text: Column | str) -> Column:
    return F.substring(F.sha1(F.lower(compact(text)).cast("binary")), 1, 16)
