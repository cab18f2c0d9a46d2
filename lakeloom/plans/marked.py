"""The quality and structure queries on marked-up documents, which hold headings, tables, page numbers and repeated headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, structure, web
from ..operators.chat import message_key, page_overlap
from . import derived
from .quality import _COUNTERS, COUNTERS, LINES
from .registry import query, table
from .structure import _ELEMENTS, _KEYED

_DOCS = "WITH marked AS (" + derived.LINES_SQL + "SELECT doc_id, text FROM marked)"


def _over_marked(sql: str) -> str:
    """SQL over documents as SQL over the marked documents."""
    return _DOCS + "," + sql.removeprefix("WITH").replace("FROM documents", "FROM marked").replace("JOIN documents", "JOIN marked")


def _documents(spark, folder):
    return derived.marked_documents(spark, folder)


def _scored(spark, folder):
    return quality.scored(_documents(spark, folder)).drop("text").withColumns({c: F.col(c).cast("long") for c in [*_COUNTERS, "score"]})


@query(_over_marked(COUNTERS + "SELECT doc_id, characters, " + ", ".join(_COUNTERS) + ", short_line_ratio, score::BIGINT AS score, level FROM q"))
def marked_quality(spark, folder):
    """Counters, score and level of marked-up documents."""
    return _scored(spark, folder).select("doc_id", "characters", *_COUNTERS, "short_line_ratio", "score", "level")


@query(_over_marked(COUNTERS + "SELECT doc_id, score::BIGINT AS score, level, array_to_string(categories, ',') AS categories, focus FROM queue"))
def marked_queue(spark, folder):
    """Marked-up documents that need work, with categories and focus."""
    rows = quality.queue(_scored(spark, folder))
    return rows.select("doc_id", "score", "level", F.array_join("categories", ",").alias("categories"), "focus")


@query(_over_marked(_ELEMENTS + "SELECT doc_id, line_start, line_end, type, chars FROM elements"))
def marked_elements(spark, folder):
    """Blocks of marked-up documents."""
    rows = structure.elements(_documents(spark, folder))
    return rows.select("doc_id", F.col("line_start").cast("long"), F.col("line_end").cast("long"), "type", F.col("chars").cast("long"))


_WALK = """, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS n FROM elements WHERE type <> 'page_break'),
walk AS (SELECT doc_id, n, 1 AS chunk, greatest(chars, 1) AS size FROM e WHERE n = 1 UNION ALL SELECT e.doc_id, e.n, CASE WHEN e.type = 'title' OR walk.size + greatest(e.chars, 1) > 1800 THEN walk.chunk + 1 ELSE walk.chunk END,
  CASE WHEN e.type = 'title' OR walk.size + greatest(e.chars, 1) > 1800 THEN greatest(e.chars, 1) ELSE walk.size + greatest(e.chars, 1) END FROM walk JOIN e ON e.doc_id = walk.doc_id AND e.n = walk.n + 1),
chunks AS (SELECT w.doc_id, w.chunk::BIGINT AS chunk, min(line_start) AS line_start, max(line_end) AS line_end, count(*) AS blocks, sum(greatest(chars, 1))::BIGINT AS chars FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.n = w.n GROUP BY ALL) """


@query(_over_marked(_ELEMENTS + _WALK + "SELECT doc_id, count(*) AS chunks, max(chars)::BIGINT AS most_chars, sum(blocks)::BIGINT AS blocks FROM chunks GROUP BY doc_id").replace("WITH marked", "WITH RECURSIVE marked", 1))
def marked_chunks(spark, folder):
    """Retrieval chunks of marked-up documents, summed up."""
    rows = structure.chunks(structure.elements(_documents(spark, folder)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chars").cast("long").alias("most_chars"), F.sum("blocks").cast("long").alias("blocks"))


@query("WITH RECURSIVE" + (_ELEMENTS + _WALK).removeprefix("WITH") + "SELECT doc_id, count(*) AS chunks, max(chars)::BIGINT AS most_chars, sum(blocks)::BIGINT AS blocks FROM chunks GROUP BY doc_id")
def chunk_summary(spark, folder):
    """Retrieval chunks of documents, summed up."""
    rows = structure.chunks(structure.elements(table(spark, folder, "documents")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chars").cast("long").alias("most_chars"), F.sum("blocks").cast("long").alias("blocks"))


# The oracle walks line by line with the key that last stayed; the operator uses windows only.
_NOISE = r""", flags AS (SELECT k.doc_id, k.pos, l.line, k.t, k.key, k.pos < 160 AND regexp_matches(k.t, '^.{2,90}(?:\.{3,}|…{2,}|·{3,})\s*\d{1,4}\s*$') AND NOT regexp_matches(k.t, '^(?:#|\||<!--)') AS toc,
  regexp_matches(l.k, '^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$') AND coalesce(lag(k.t) OVER w, '') = '' AND coalesce(lead(k.t) OVER w, '') = '' AS num, count(*) OVER (PARTITION BY k.doc_id, k.key) AS same FROM doc_keys k JOIN lines l ON l.doc_id = k.doc_id AND l.pos = k.pos WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.pos)),
firsts AS (SELECT *, CASE WHEN toc AND count(*) FILTER (toc) OVER p >= 3 THEN 'toc_remnant' WHEN num AND count(*) FILTER (num) OVER p >= 3 THEN 'standalone_page_number' WHEN key <> '' AND same >= 4 AND (length(key) <= 20 OR same >= 6) THEN 'repeated_header_footer' END AS kind FROM flags WINDOW p AS (PARTITION BY doc_id)),
walk AS (SELECT doc_id, pos, kind AS found, CASE WHEN kind IS NOT NULL THEN '' ELSE key END AS last FROM firsts WHERE pos = 0
 UNION ALL SELECT f.doc_id, f.pos, CASE WHEN f.kind IS NOT NULL THEN f.kind WHEN f.key <> '' AND f.key = walk.last THEN 'consecutive_duplicate' END, CASE WHEN f.kind IS NOT NULL THEN '' WHEN f.key <> '' AND f.key = walk.last THEN '' WHEN f.key <> '' THEN f.key WHEN f.t = '' OR starts_with(f.t, '<!--') THEN walk.last ELSE '' END
 FROM walk JOIN firsts f ON f.doc_id = walk.doc_id AND f.pos = walk.pos + 1) """
_CLEANED = r"SELECT f.doc_id, string_agg(CASE WHEN w.found IS NOT NULL THEN concat('<!-- removed ', w.found, ': ', trim(replace(f.t, '--', '- -')), ' -->') ELSE f.line END, chr(10) ORDER BY f.pos) AS text FROM firsts f JOIN walk w ON w.doc_id = f.doc_id AND w.pos = f.pos GROUP BY f.doc_id"


@query("WITH RECURSIVE" + (_KEYED + _NOISE).removeprefix("WITH") + _CLEANED)
def cleaned_documents(spark, folder):
    """Documents with noise lines as comments."""
    return structure.cleanup(table(spark, folder, "documents"))


_BOOK = "concat(array_join(transform(sequence(1, 6), i -> concat('Running head\n', i, '\n\n', text, '\nRunning head - ', i)), '\n\n'))"
_BOOKS = (
    "WITH RECURSIVE marked0 AS ("
    + derived.LINES_SQL
    + "SELECT doc_id, text FROM marked), marked AS (SELECT doc_id, array_to_string(list_transform(range(1, 7), lambda i: concat('Running head', chr(10), i, chr(10), chr(10), text, chr(10), 'Running head - ', i)), chr(10) || chr(10)) AS text FROM marked0)"
)


@query(_BOOKS + "," + (_KEYED + _NOISE).removeprefix("WITH").replace("FROM documents", "FROM marked") + _CLEANED)
def cleaned_books(spark, folder):
    """Books of six pages with running heads and page numbers, noise lines as comments."""
    rows = _documents(spark, folder).selectExpr("doc_id", f"{_BOOK} AS text")
    return structure.cleanup(rows)


@query(_BOOKS + "," + (_KEYED + _NOISE).removeprefix("WITH").replace("FROM documents", "FROM marked") + "SELECT found AS kind, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM walk WHERE found IS NOT NULL GROUP BY found")
def noise_kinds(spark, folder):
    """Noise lines of books by kind."""
    rows = structure.noise_kinds(structure.line_table(_documents(spark, folder).selectExpr("doc_id", f"{_BOOK} AS text")))
    return rows.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("documents"))


@query(_BOOKS + ", " + LINES.strip().replace("FROM documents", "FROM marked") + r" SELECT doc_id, count(*) AS page_numbers FROM lines WHERE regexp_matches(k, '^[\-—–_·•]*第?\d{1,4}页?(?:/\d{1,4})?[\-—–_·•]*$') GROUP BY doc_id")
def book_page_numbers(spark, folder):
    """Lines of books that are page numbers."""
    from ..functions.headings import is_page_number

    rows = structure.line_table(_documents(spark, folder).selectExpr("doc_id", f"{_BOOK} AS text"))
    return rows.filter(is_page_number("line")).groupBy("doc_id").agg(F.count("*").alias("page_numbers"))


_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g'))".replace('\\"', '"')
_NAV = r"WITH n AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<nav\b.*?</nav>'), ' ') AS nav FROM pages), t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(nav, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: " + _PLAIN + "), lambda x: x <> '') AS ts FROM n), u AS (SELECT page_id, list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN list_position(ts, ts[i]) = i THEN ts[i] END), lambda x: x IS NOT NULL) AS titles FROM t) "


@query(_NAV + "SELECT page_id, array_to_string(titles, ' | ') AS titles FROM u")
def page_nav_titles(spark, folder):
    """Titles of the pages' navigation."""
    return table(spark, folder, "pages").select("page_id", F.array_join(web.nav_titles(F.col("html")), " | ").alias("titles"))


@query(
    r"""WITH k AS (SELECT conv_id, list(concat(role, ':', lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\p{M}]+', '', 'g'))) ORDER BY turn) AS keys FROM conversations GROUP BY conv_id), p AS (SELECT k.conv_id, coalesce(b.keys, []) AS a, k.keys AS c FROM k LEFT JOIN k b ON b.conv_id = k.conv_id - 1)
SELECT conv_id, coalesce(list_max(list_filter(range(1, 13), lambda n: n <= len(a) AND n <= len(c) AND a[(len(a) - n + 1):len(a)] = c[1:n] AND (n >= 2 OR length(a[len(a)]) >= 12))), 0)::INT AS overlap FROM p"""
)
def chat_overlap(spark, folder):
    """Messages that end one conversation and begin the next."""
    turns = table(spark, folder, "conversations").withColumn("key", message_key(F.col("role"), F.col("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "key"))), lambda x: x["key"])
    convs = turns.groupBy("conv_id").agg(ordered.alias("keys"))
    before = convs.select((F.col("conv_id") + 1).alias("conv_id"), F.col("keys").alias("before"))
    none = F.array().cast("array<string>")
    return convs.join(before, "conv_id", "left").select("conv_id", page_overlap(F.coalesce("before", none), F.col("keys")).alias("overlap"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, concat(role, ':', lower(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g'), '(.).*', '\1'))) AS key FROM conversations), k AS (SELECT conv_id // 2 AS book, conv_id % 2 AS half, list(key ORDER BY turn) AS keys FROM t GROUP BY ALL), p AS (SELECT a.book, a.keys AS a, list_concat(a.keys[(len(a.keys) - 1):len(a.keys)], b.keys) AS c FROM k a JOIN k b ON b.book = a.book AND a.half = 0 AND b.half = 1)
SELECT book, coalesce(list_max(list_filter(range(1, 13), lambda n: n <= len(a) AND n <= len(c) AND a[(len(a) - n + 1):len(a)] = c[1:n] AND (n >= 2 OR length(a[len(a)]) >= 12))), 0)::INT AS overlap FROM p"""
)
def page_overlaps(spark, folder):
    """Messages that two screenshots share, the second beginning with the end of the first."""
    first = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", ""), "(.).*", "$1"))
    turns = table(spark, folder, "conversations").withColumn("key", F.concat("role", F.lit(":"), first))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "key"))), lambda x: x["key"])
    rows = turns.groupBy("conv_id").agg(ordered.alias("keys")).withColumn("book", F.floor(F.col("conv_id") / 2))
    a = rows.filter(F.col("conv_id") % 2 == 0).select("book", F.col("keys").alias("a"))
    b = rows.filter(F.col("conv_id") % 2 == 1).select("book", F.col("keys").alias("b"))
    both = a.join(b, "book").withColumn("c", F.concat(F.slice("a", F.greatest(F.size("a") - 1, F.lit(1)), F.lit(2)), "b"))
    return both.select("book", page_overlap(F.col("a"), F.col("c")).alias("overlap"))
