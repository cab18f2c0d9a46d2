"""Structure of documents: lines, noise cleanup, headings, outline, blocks and retrieval chunks.

Line rules are windows over exploded lines, partitioned by document, so a document is the largest unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions.text import comment_safe, lines, strip

CHUNK_CHARS = 1800


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (from 0), line, t (stripped) of every line."""
    return docs.select(id_col, F.posexplode(lines(text_col)).alias("pos", "line")).withColumn("t", strip("line"))


def _by(id_col: str) -> Window:
    return Window.partitionBy(id_col).orderBy("pos")


def blank_separated(id_col: str = "doc_id") -> Column:
    """Whether the lines before and after are blank or missing."""
    w = _by(id_col)
    return (F.coalesce(F.lag("t").over(w), F.lit("")) == "") & (F.coalesce(F.lead("t").over(w), F.lit("")) == "")


def next_nonblank(id_col: str = "doc_id") -> Column:
    back = Window.partitionBy(id_col).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)  # one running pass
    return F.last(F.when(F.col("t") != "", F.col("t")), ignorenulls=True).over(back)


def noise_kinds(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines with their noise kind, null for lines that stay. The first rule that holds names the kind.

    Equal neighbours are those whose key equals that of the last line with a key that stays; blank lines between do not matter,
    and a removed line ends the comparison, so of three equal lines the second goes and the third stays.
    """
    w, whole = _by(id_col), Window.partitionBy(id_col)
    rows = rows.withColumn("key", H.document_key("line"))
    rows = rows.withColumn("_toc", (F.col("pos") < 160) & H.is_toc_leader("line")).withColumn("_num", H.is_page_number("line") & blank_separated(id_col))
    counts = Window.partitionBy(id_col, "key")
    rows = rows.withColumns({"_tocs": F.count_if("_toc").over(whole), "_nums": F.count_if("_num").over(whole), "_same": F.count("*").over(counts)})
    repeated = (F.col("key") != "") & (F.col("_same") >= 4) & ((F.length("key") <= 20) | (F.col("_same") >= 6))
    first = F.when(F.col("_toc") & (F.col("_tocs") >= 3), "toc_remnant").when(F.col("_num") & (F.col("_nums") >= 3), "standalone_page_number").when(repeated, "repeated_header_footer")
    rows = rows.withColumn("kind", first)
    # runs of one key: what breaks a run is another key, a removal, or a plain line without a key
    neutral = F.col("kind").isNull() & (F.col("key") == "") & ((F.col("t") == "") | F.col("t").startswith("<!--"))
    mark = F.when(~neutral, F.when(F.col("kind").isNull(), F.col("key")).otherwise(""))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ~neutral & ((mark == "") | F.coalesce(before != mark, F.lit(True)))
    rows = rows.withColumn("_run", F.sum(F.when(fresh, 1).otherwise(0)).over(w)).withColumn("_member", (~neutral & (mark != "")).cast("int"))
    nth = F.sum("_member").over(Window.partitionBy(id_col, "_run").orderBy("pos"))
    twin = (F.col("_member") == 1) & (nth % 2 == 0)
    return rows.withColumn("kind", F.coalesce("kind", F.when(twin, "consecutive_duplicate"))).drop("_toc", "_num", "_tocs", "_nums", "_same", "_run", "_member")


CLEANUP_CONFIDENCE = {"toc_remnant": 0.80, "standalone_page_number": 0.86, "repeated_header_footer": 0.88, "consecutive_duplicate": 0.82}


def cleanup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the text with noise lines replaced by audit comments."""
    rows = noise_kinds(line_table(docs, id_col, text_col), id_col)
    line = F.when(F.col("kind").isNotNull(), F.concat(F.lit("<!-- removed "), F.col("kind"), F.lit(": "), comment_safe("t"), F.lit(" -->"))).otherwise(F.col("line"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


_MARKED = r"^(?:#|-|\*|>|\||<!--)"


def promotions(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Plain lines that are headings of the numbered grammar: kind and level by what stands above them."""
    w = _by(id_col)
    rows = rows.withColumns({"kind": H.domain_kind("t"), "_blank": blank_separated(id_col), "_next": next_nonblank(id_col)})
    plain = ~F.col("t").rlike(_MARKED) & F.col("_blank")
    calm = ~F.col("t").rlike(H.END_PUNCTUATION.replace("、", "")) & (F.length(F.coalesce("_next", F.lit(""))) >= 8)
    size = F.length("t")
    clause_next = ~F.coalesce(F.col("_next"), F.lit("")).rlike(_MARKED)
    ok = (
        (F.col("kind").isin("chapter", "section") & (size <= 100))
        | ((F.col("kind") == "article") & (size <= 160))
        | ((F.col("kind") == "parenthesized_clause") & (size <= 56) & calm & clause_next)
        | (F.col("kind").isin("numeric_item", "parenthesized_digit_item") & (size <= 80) & calm)
    )
    title = F.coalesce(H.heading_title("t"), F.col("t"))
    existing = H.heading_level("t")
    rows = rows.withColumn("kind", F.when(existing.isNotNull(), H.domain_kind(title)).otherwise(F.col("kind")))
    taken = existing.isNotNull() | (plain & ok)
    rows = rows.withColumns({"title": title, "existing": existing, "heading": taken})
    at = lambda *kinds: F.last(F.when(F.col("heading") & F.col("kind").isin(*kinds), F.col("pos")), ignorenulls=True).over(w)
    top = F.last(F.when(F.col("heading") & (F.col("kind").isin("chapter", "section") | ((F.col("kind") == "unknown") & (F.col("existing") <= 2))), F.col("pos")), ignorenulls=True).over(w)
    rows = rows.withColumns({"_top": top, "_article": at("article"), "_clause": at("parenthesized_clause"), "_item": at("numeric_item")})
    since = lambda c, *above: F.col(c).isNotNull() & (F.col(c) > F.greatest(*(F.coalesce(F.col(a), F.lit(-1)) for a in above), F.lit(-1)))
    article, clause, item = since("_article", "_top"), since("_clause", "_top", "_article"), since("_item", "_top", "_article", "_clause")
    level = (
        F.when(F.col("kind") == "chapter", 1)
        .when(F.col("kind") == "section", 2)
        .when(F.col("kind") == "article", 3)
        .when(F.col("kind") == "parenthesized_clause", F.when(article, 4).otherwise(3))
        .when(F.col("kind") == "numeric_item", F.when(clause, 5).otherwise(4))
        .when(F.col("kind") == "parenthesized_digit_item", F.when(item | clause, 6).otherwise(4))
        .otherwise(F.col("existing"))
    )
    return rows.filter("heading").select(id_col, "pos", "title", "kind", "existing", level.alias("level"))


def outline(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Headings (id, pos, level, title) with their path: the last heading of each upper level that no higher one has closed."""
    w = _by(id_col)
    for k in range(1, 7):
        here = F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w)
        rows = rows.withColumn(f"_h{k}", here)
    parts, closed = [], F.lit(-1)
    for k in range(1, 7):
        mine = F.col(f"_h{k}")
        parts.append(F.when((F.lit(k) <= F.col("level")) & (mine["pos"] > closed), mine["title"]))
        closed = F.greatest(closed, F.coalesce(mine["pos"], F.lit(-1)))
    path = F.array_compact(F.array(*parts))
    return rows.withColumn("path", path).withColumn("parent", F.try_element_at(F.col("path"), F.lit(-2))).drop(*(f"_h{k}" for k in range(1, 7)))


def elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: id, first and last line (from 1), type, chars, level, title, page.

    Fences toggle; outside them a heading, a page marker and a blank line each end a block.
    """
    w = _by(id_col)
    rows = line_table(docs, id_col, text_col)
    rows = rows.withColumn("_fence", F.col("t").startswith("```"))
    rows = rows.withColumn("_fences", F.sum(F.col("_fence").cast("int")).over(w))
    rows = rows.withColumn("_code", F.col("_fence") | (F.col("_fences") % 2 == 1))
    rows = rows.withColumns({"_page": F.when(~F.col("_code"), H.page_marker("t")), "_level": F.when(~F.col("_code"), H.heading_level("t"))})
    kind = F.when(F.col("_code"), "code").when(F.col("_page").isNotNull(), "page_break").when(F.col("_level").isNotNull(), "title").when(F.col("t") == "", "blank").otherwise("text")
    rows = rows.withColumn("_kind", kind)
    before = F.lag("_kind").over(w)
    opens = F.col("_fence") & (F.col("_fences") % 2 == 1)
    new = opens | F.col("_kind").isin("page_break", "title") | before.isNull() | (before != F.col("_kind"))
    rows = rows.withColumn("_block", F.sum(new.cast("int")).over(w)).withColumn("page", F.last("_page", ignorenulls=True).over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    blocks = rows.filter("_kind <> 'blank'").groupBy(id_col, "_block").agg(
        (F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"), F.first("_kind").alias("_kind"), F.first("_level").alias("level"), F.first("page").alias("page"), F.array_join(ordered, "\n").alias("raw")
    )
    raw = strip("raw")
    items = F.filter(F.split(raw, "\n"), lambda x: strip(x) != "")
    kinds = (
        F.when(F.col("_kind").isin("page_break", "title"), F.col("_kind"))
        .when(F.col("_kind") == "code", "code_block")
        .when(raw.startswith("|") & raw.contains("\n|"), "table")
        .when(F.forall(items, lambda x: x.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+")), "list")
        .when(raw.rlike(r"^!\[.*?\]\(.+?\)"), "image")
        .otherwise("narrative_text")
    )
    title = F.when(F.col("_kind") == "title", H.heading_title("raw"))
    chars = F.when(F.col("_kind") == "page_break", 0).when(F.col("_kind") == "title", F.length(title)).otherwise(F.length(raw))
    return blocks.select(id_col, "line_start", "line_end", kinds.alias("type"), chars.alias("chars"), "level", title.alias("title"), "page")


def chunks(blocks: DataFrame, id_col: str = "doc_id", limit: int = CHUNK_CHARS) -> DataFrame:
    """Greedy chunks of blocks: a title starts one, and so does a block that would exceed the limit; blocks stay whole.

    One fold over the sorted blocks of a document, in Catalyst.
    """
    items = F.array_sort(F.collect_list(F.struct("line_start", "line_end", "type", "chars", "page")))
    per_doc = blocks.filter("type <> 'page_break'").groupBy(id_col).agg(items.alias("items"))
    empty = "cast(array() as array<struct<chunk:int,first:int,last:int,blocks:int,chars:int>>)"
    step = f"""aggregate(items, {empty}, (acc, x) ->
      case when size(acc) = 0 or x.type = 'title' or element_at(acc, -1).chars + greatest(x.chars, 1) > {limit}
      then concat(acc, array(named_struct('chunk', size(acc) + 1, 'first', x.line_start, 'last', x.line_end, 'blocks', 1, 'chars', greatest(x.chars, 1))))
      else concat(slice(acc, 1, size(acc) - 1), array(named_struct('chunk', size(acc), 'first', element_at(acc, -1).first, 'last', x.line_end,
        'blocks', element_at(acc, -1).blocks + 1, 'chars', element_at(acc, -1).chars + greatest(x.chars, 1)))) end)"""
    return per_doc.select(id_col, F.explode(F.expr(step)).alias("c")).select(id_col, "c.*")


def table_islands(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Runs of lines with two pipes or more: id, first and last line, rows, columns."""
    pipes = F.length("t") - F.length(F.replace("t", F.lit("|"), F.lit("")))
    rows = rows.withColumn("_n", pipes).filter("_n >= 2").withColumn("_island", F.col("pos") - F.row_number().over(_by(id_col)))
    return rows.groupBy(id_col, "_island").agg((F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"), F.count("*").alias("n_rows"), F.max(F.col("_n") + 1).alias("n_columns")).drop("_island")
