"""Queries of the cleaning operators, on marked-up lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cleaning as c
from . import derived
from .derived import LINES_SQL
from .registry import query, table

_T = "trim(line, ' ' || chr(9) || chr(13))"
_K = r"regexp_replace(line, '[\s\p{Z}]+', '', 'g')"
_KK = rf"regexp_replace(regexp_replace(regexp_replace({_K}, '^[\-—–_·•]*第?\d{{1,4}}页?(?:/\d{{1,4}})?[\-—–_·•]+', ''), '[\-—–_·•]+第?\d{{1,4}}页?(?:/\d{{1,4}})?[\-—–_·•]*$', ''), '^[\-—–_·•]+|[\-—–_·•]+$', '', 'g')"
_KEY = rf"CASE WHEN {_K} = '' OR {_T} LIKE '#%' OR regexp_matches({_T}, '(?i)^<!--\s*Page\s+\d+\s*-->\s*$') OR regexp_matches({_K}, '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\d+|Part\w+)') OR regexp_matches({_K}, '^\d{{1,4}}$') OR length({_KK}) > 24 OR regexp_matches({_KK}, '[。！？!?；;：:，,、]$') THEN '' ELSE {_KK} END"
#: Lines with page comments where the marked lines have page headings.
_COMMENTED = LINES_SQL + r", pl AS (SELECT doc_id, pos, CASE WHEN starts_with(line, '## Page') THEN concat('<!-- Page ', pos, ' -->') ELSE line END AS line FROM lines) "
_PAGED = r", paged AS (SELECT *, {t} AS t, regexp_matches({t}, '(?i)^<!--\s*Page\s+\d+\s*-->\s*$') AS mark FROM {src}), numbered AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS page FROM paged), bodies AS (SELECT *, page > 0 AND t <> '' AND NOT starts_with(t, '<!--') AS body FROM numbered), edges AS (SELECT *, body AND (row_number() OVER (PARTITION BY doc_id, page, body ORDER BY pos) <= 2 OR row_number() OVER (PARTITION BY doc_id, page, body ORDER BY pos DESC) <= 2) AS edge FROM bodies) "


def _lines(spark, folder):
    return derived.marked_lines(spark, folder).select("doc_id", "pos", "line")


def _commented(spark, folder):
    return _lines(spark, folder).withColumn("line", F.when(F.col("line").startswith("## Page"), F.concat(F.lit("<!-- Page "), "pos", F.lit(" -->"))).otherwise(F.col("line")))


def _books(rows):
    """Twenty documents as one book."""
    return rows.select((F.col("doc_id") % 50).alias("doc_id"), (F.floor(F.col("doc_id") / 50) * 100_000 + F.col("pos")).alias("pos"), "line")


_BOOKS = ", pl2 AS (SELECT doc_id % 50 AS doc_id, doc_id // 50 * 100000 + pos AS pos, line FROM pl) "


@query(
    _COMMENTED
    + _BOOKS
    + _PAGED.format(t=_T, src="pl2")
    + f", keyed AS (SELECT doc_id, {_KEY} AS key FROM edges WHERE edge) SELECT doc_id, key FROM keyed WHERE key <> '' GROUP BY ALL HAVING count(*) >= 4 AND length(key) <= 24"
)
def ocr_edge_keys(spark, folder):
    """Short lines at the edges of a book's pages."""
    return c.edge_keys(_books(_commented(spark, folder)))


@query(
    _COMMENTED
    + _BOOKS
    + _PAGED.format(t=_T, src="pl2")
    + r""", nums AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS pages, regexp_extract(regexp_replace(t, '\s+', '', 'g'), '^[\-—–_·•]*第?(\d{1,4})页?(?:/\d{1,4})?[\-—–_·•]*$', 1) AS num FROM edges)
SELECT doc_id, pos, CASE WHEN edge AND num <> '' AND NOT (length(num) >= 4 AND TRY_CAST(num AS INT) > pages + 20) THEN concat('<!-- removed OCR page number: ', t, ' -->') ELSE line END AS line FROM nums"""
)
def ocr_edge_numbers(spark, folder):
    """Books with printed page numbers at the edges of pages as comments."""
    return c.without_edge_numbers(_books(_commented(spark, folder)))


@query(
    _COMMENTED
    + _BOOKS
    + f""", keyed AS (SELECT *, {_KEY} AS key FROM pl2), counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM keyed)
SELECT doc_id, pos, CASE WHEN key <> '' AND n >= 4 AND (length(key) <= 12 OR n >= 6) THEN concat('<!-- removed repeated OCR header/footer: ', {_T}, ' -->') ELSE line END AS line FROM counted WHERE NOT regexp_matches(line, '[^\\x20-\\x7E一-鿿（）•]')"""
)
def ocr_repeated_lines(spark, folder):
    """Books with repeated headers as comments."""
    return c.without_repeated_ocr(_books(_commented(spark, folder))).filter(~F.col("line").rlike(r"[^\x20-\x7E一-鿿（）•]"))


_SCREEN = r"CASE WHEN length({k}) > 24 OR regexp_matches({k}, '^\d{{1,4}}$') OR regexp_matches({k}, '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\d+|Part\w+)') OR regexp_matches({k}, '[。！？!?；;：:，,、]$') THEN '' ELSE {k} END".format(k=_K)


@query(
    _COMMENTED
    + _BOOKS
    + f""", keyed AS (SELECT *, {_SCREEN} AS key FROM pl2), counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM keyed)
SELECT doc_id, pos, CASE WHEN key <> '' AND n >= 3 AND length(key) <= 18 THEN concat('<!-- repeated screenshot header/footer: ', {_T}, ' -->') ELSE line END AS line FROM counted"""
)
def screen_repeated_lines(spark, folder):
    """Books with lines that repeat from screen to screen as comments."""
    return c.without_repeated_screens(_books(_commented(spark, folder)))


@query(
    LINES_SQL
    + rf""", near AS (SELECT doc_id, pos, line, {_T} AS t, coalesce(lag({_T}) OVER w, '') AS b, coalesce(lead({_T}) OVER w, '') AS n, coalesce(lead({_T}, 2) OVER w, '') AS a FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
flags AS (SELECT *, t <> '' AND NOT starts_with(t, '#') AND regexp_matches(t, '^第[一二三四五六七八九十百零〇\d]+章') AND (b = '' OR n = '' OR length(t) <= 80) AS chapter, n <> '' AND length(n) <= 48 AND a = '' AND NOT regexp_matches(n, '^[->#]') AS short FROM near),
taken AS (SELECT *, coalesce(lag(chapter AND short) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM flags)
SELECT doc_id, pos, CASE WHEN chapter AND short THEN concat('## ', t, '　', n) WHEN chapter THEN concat('## ', t) WHEN (b = '' OR n = '') AND (t IN ('致谢', '结语', '后记') OR (starts_with(t, '附录') AND length(t) <= 80)) THEN concat('## ', t) ELSE line END AS line FROM taken WHERE NOT gone"""
)
def chapter_headings(spark, folder):
    """Plain chapter lines as headings."""
    return c.chapters_promoted(_lines(spark, folder))


_TOC = r"CASE WHEN pos < doc_id % 6 THEN concat('- [', substr(raw, 1, 10), '](#p', pos, ')') WHEN pos = doc_id % 6 AND doc_id % 4 <> 0 THEN concat('# ', substr(raw, 1, 20)) ELSE raw END"
_TRIM = """, sized AS (SELECT *, sum(length(line) + 1) OVER w AS a, sum(CASE WHEN pos >= start THEN length(line) + 1 ELSE 0 END) OVER w AS b, sum((trim(line) <> '')::INT) OVER w AS c, sum(CASE WHEN pos >= start THEN (trim(line) <> '')::INT ELSE 0 END) OVER w AS d FROM {src} WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, pos, line FROM sized WHERE start IS NULL OR NOT (a < 5000 OR (b >= 1000 AND b >= a * 0.2 AND NOT (c >= 200 AND d < 25))) OR pos >= start"""


@query(
    f"WITH {derived.RAW_SQL}, tl AS (SELECT doc_id, pos, replace({_TOC}, ']', ']') AS line FROM (SELECT doc_id, pos, regexp_replace(raw, '[\\[\\]()]', '', 'g') AS raw FROM raws)), "
    + r"firsts AS (SELECT *, min(CASE WHEN trim(line) <> '' AND NOT regexp_matches(trim(line), '^- \[[^\]]+\]\([^)]+\)$') THEN pos END) OVER (PARTITION BY doc_id) AS other FROM tl), starts AS (SELECT *, CASE WHEN sum((trim(line) <> '' AND pos < other)::INT) OVER w >= 3 THEN max(CASE WHEN pos = other AND starts_with(line, '# ') AND pos > 0 THEN pos END) OVER w END AS start FROM firsts WINDOW w AS (PARTITION BY doc_id))"
    + _TRIM.format(src="starts")
)
def leading_contents(spark, folder):
    """Documents without a contents list at their start."""
    rows = derived.raw_lines(spark, folder).withColumn("raw", F.regexp_replace("raw", r"[\[\]()]", "")).selectExpr("doc_id", "pos", f"{_TOC} AS line")
    return c.without_leading_toc(rows)


_FRONT = "CASE WHEN pos % 7 = doc_id % 7 THEN concat('# ', CASE WHEN doc_id % 3 = 0 THEN '版权页' ELSE substr(raw, 1, 20) END) WHEN pos < doc_id % 9 THEN CASE pos % 4 WHEN 0 THEN 'ISBN 123' WHEN 1 THEN 'Copyright' WHEN 2 THEN '定价 3' ELSE '发行' END ELSE concat('q', regexp_replace(raw, '[a-zA-Z]', '')) END"
_FRONT_SQL = _FRONT.replace("'[a-zA-Z]', '')", "'[a-zA-Z]', '', 'g')")


@query(
    f"WITH {derived.RAW_SQL}, fl AS (SELECT doc_id, pos, {_FRONT_SQL} AS line FROM raws), "
    + "hits AS (SELECT *, trim(line) AS t, ("
    + " OR ".join(f"contains(lower(line), '{m}')" for m in c.IMPRINT)
    + """)::INT AS hit FROM fl), nears AS (SELECT *, sum(CASE WHEN t <> '' THEN hit ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS near FROM hits),
chosen AS (SELECT *, min(CASE WHEN starts_with(t, '# ') AND NOT ((trim(t[3:]) IN ('扉页', '版权页', '书名页', '封面') AND near >= 3) OR near >= 5) THEN pos END) OVER (PARTITION BY doc_id) AS ch FROM nears),
starts AS (SELECT *, CASE WHEN ch > 0 AND (sum(CASE WHEN pos < ch AND t <> '' THEN hit ELSE 0 END) OVER w >= 3 OR sum((pos < ch AND t <> '')::INT) OVER w <= 5) THEN ch END AS start FROM chosen WINDOW w AS (PARTITION BY doc_id))"""
    + _TRIM.format(src="starts")
)
def front_matter(spark, folder):
    """Documents without publication pages at their start."""
    return c.without_front_matter(derived.raw_lines(spark, folder).selectExpr("doc_id", "pos", f"{_FRONT} AS line"))


@query(
    f"WITH {derived.RAW_SQL}, sl AS (SELECT doc_id, pos * 2 + k AS pos, CASE WHEN k = 1 THEN substr(regexp_replace(raw, '[^A-Za-z0-9 ]', '', 'g'), 1, 30) WHEN pos % 2 = 0 THEN '' ELSE 'x' END AS line FROM raws, (VALUES (0), (1)) v(k)), "
    + "titles AS (SELECT DISTINCT doc_id, lower(replace(line, ' ', '')) AS key FROM sl WHERE pos % 3 = 0 AND trim(line) <> ''), near AS (SELECT *, trim(line) AS t, coalesce(lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos), '') AS b FROM sl) "
    + "SELECT n.doc_id, n.pos, CASE WHEN k.key IS NOT NULL AND t <> '' AND b = '' THEN concat('## ', t) ELSE line END AS line FROM near n LEFT JOIN titles k ON k.doc_id = n.doc_id AND k.key = lower(replace(n.t, ' ', ''))"
)
def contents_headings(spark, folder):
    """Lines that a contents list names as headings."""
    cut = F.substring(F.regexp_replace("raw", "[^A-Za-z0-9 ]", ""), 1, 30)
    each = F.array(F.struct((F.col("pos") * 2).alias("pos"), F.when(F.col("pos") % 2 == 0, "").otherwise("x").alias("line")), F.struct((F.col("pos") * 2 + 1).alias("pos"), cut.alias("line")))
    rows = derived.raw_lines(spark, folder).select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*")
    titles = rows.filter((F.col("pos") % 3 == 0) & (F.trim("line") != "")).select("doc_id", F.col("line").alias("title"))
    return c.with_toc_headings(rows, titles)


@query(
    LINES_SQL
    + rf""", keyed AS (SELECT *, {_SCREEN} AS key FROM lines), counted AS (SELECT *, CASE WHEN key <> '' AND count(*) OVER (PARTITION BY doc_id, key) >= 3 AND length(key) <= 18 THEN concat('<!-- repeated screenshot header/footer: ', {_T}, ' -->') ELSE line END AS l2 FROM keyed),
near AS (SELECT doc_id, pos, trim(l2, ' ' || chr(9) || chr(13)) AS t, coalesce(lag(trim(l2, ' ' || chr(9) || chr(13))) OVER (PARTITION BY doc_id ORDER BY pos), '') = '' AS blank FROM counted),
levels AS (SELECT *, CASE WHEN regexp_matches(t, '^#{{1,6}}\s+\S+|^>\s+|^(?:\||[-*+]\s+|\d+[.)]\s+)|^</?\w+[^>]*>$') THEN NULL WHEN regexp_matches(t, '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷](?:[^\w一-鿿À-ɏ]|$)|Chapter\s+\d+\b|Part\s+\w+\b)') THEN 2
 WHEN regexp_matches(t, '^(\d+(?:\.\d+){{0,3}})[\s、.．]+') THEN least(2 + length(regexp_extract(t, '^(\d+(?:\.\d+){{0,3}})[\s、.．]+', 1)) - length(replace(regexp_extract(t, '^(\d+(?:\.\d+){{0,3}})[\s、.．]+', 1), '.', '')), 5) WHEN blank AND length(t) BETWEEN 2 AND 28 AND NOT regexp_matches(t, '[。！？.!?，,；;：:]$') THEN 3 END AS level FROM near)
SELECT doc_id, pos, CASE WHEN level IS NULL THEN t ELSE concat(repeat('#', level::INT), ' ', t) END AS line FROM levels WHERE NOT (t = '' AND blank)"""
)
def screen_markdown(spark, folder):
    """Lines of screens as Markdown."""
    return c.screen_markdown(_lines(spark, folder))


@query(
    LINES_SQL
    + rf""", sl AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 1 THEN '| --- | --- |' WHEN pos % 11 = 0 THEN '' ELSE concat('| ', replace(line, '|', ' '), ' |') END AS line FROM lines),
runs AS (SELECT *, contains(line, '|') AS pipe, regexp_matches(line, '\|\s*:?-{{3,}}:?\s*\|') AND coalesce(contains(lag(line) OVER w, '|'), false) AS sep, sum((NOT contains(line, '|'))::INT) OVER w AS run FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT *, min(CASE WHEN sep THEN pos END) OVER (PARTITION BY doc_id, run) AS first FROM runs)
SELECT doc_id, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, count(*) AS rows FROM firsts WHERE pipe AND pos >= first - 1 GROUP BY doc_id, run"""
)
def markdown_tables(spark, folder):
    """Tables of Markdown documents."""
    rows = _lines(spark, folder).withColumn("line", F.when(F.col("pos") % 5 == 1, "| --- | --- |").when(F.col("pos") % 11 == 0, "").otherwise(F.concat(F.lit("| "), F.replace("line", F.lit("|"), F.lit(" ")), F.lit(" |"))))
    return c.markdown_tables(rows)


@query(
    LINES_SQL
    + r""", sl AS (SELECT doc_id, pos, CASE WHEN (pos + doc_id) % 6 < 4 THEN concat('a  b ', pos, '  c', CASE WHEN pos % 2 = 0 THEN '  d' ELSE '' END) ELSE 'plain text' END AS line FROM lines), runs AS (SELECT *, len(regexp_split_to_array(trim(line), '\s{2,}')) AS cells, sum((len(regexp_split_to_array(trim(line), '\s{2,}')) < 3)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM sl)
SELECT doc_id, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, count(*) AS rows, max(cells) AS columns FROM runs WHERE cells >= 3 GROUP BY doc_id, run HAVING count(*) >= 3"""
)
def tabular_islands(spark, folder):
    """Runs of lines in columns."""
    row = F.concat(F.lit("a  b "), "pos", F.lit("  c"), F.when(F.col("pos") % 2 == 0, "  d").otherwise(""))
    return c.tabular_islands(_lines(spark, folder).withColumn("line", F.when((F.col("pos") + F.col("doc_id")) % 6 < 4, row).otherwise("plain text")))


@query(
    r"""SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all(t, '(?s)\$\$(.+?)\$\$', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '[\\_^={}]') OR regexp_matches(x, '[A-Za-z0-9]\s*[+\-*/<>]\s*[A-Za-z0-9]')), lambda x: x) AS isolated,
 list_filter(list_transform(regexp_extract_all(regexp_replace(t, '(?s)\$\$.+?\$\$', ' ', 'g'), '(?s)\$([^$]+?)\$', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '[\\_^={}]') OR regexp_matches(x, '[A-Za-z0-9]\s*[+\-*/<>]\s*[A-Za-z0-9]')) AS embedding
 FROM (SELECT doc_id, concat('$$', substr(r, 1, 20), ' = ', doc_id, '$$ and $', substr(r, 5, 10), '$ then $a + b_', doc_id, '$ $$', substr(r, 1, 9), '$$ ', r) AS t FROM (SELECT doc_id, regexp_replace(text, '[$=_^{}\\+*/<>-]', '', 'g') AS r FROM documents))"""
)
def markdown_formulas(spark, folder):
    """Formulas of documents, displayed and inline."""
    r = F.regexp_replace("text", r"[$=_^{}\\+*/<>-]", "")
    t = F.concat(F.lit("$$"), F.substring(r, 1, 20), F.lit(" = "), "doc_id", F.lit("$$ and $"), F.substring(r, 5, 10), F.lit("$ then $a + b_"), "doc_id", F.lit("$ $$"), F.substring(r, 1, 9), F.lit("$$ "), r)
    rows = table(spark, folder, "documents").select("doc_id", c.formulas(t).alias("f"))
    of = lambda k: F.transform(F.filter("f", lambda x: x["kind"] == k), lambda x: x["latex"])
    return rows.select("doc_id", of("isolated").alias("isolated"), of("embedding").alias("embedding"))


@query(
    r"""WITH turns AS (SELECT conv_id, turn, list_filter(list_transform(string_split(concat(text, chr(10), 'shared ', conv_id), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM conversations),
pairs AS (SELECT conv_id, turn, b, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN list_concat([concat('shared ', conv_id)], b) ELSE b END AS b FROM turns))
SELECT conv_id, turn, CASE WHEN p IS NULL THEN array_to_string(b, chr(10) || chr(10)) ELSE array_to_string(b[(coalesce(list_max(list_filter(range(1, 9), lambda n: n <= len(p) AND n <= len(b) AND p[(len(p) - n + 1):len(p)] = b[1:n])), 0) + 1):], chr(10) || chr(10)) END AS text FROM pairs"""
)
def repeated_starts(spark, folder):
    """Pages without the paragraphs that end the page before."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\nshared "), "conv_id").alias("t"))
    rows = rows.withColumn("t", F.regexp_replace(F.when(F.col("turn") % 2 == 1, F.concat(F.lit("shared "), "conv_id", F.lit("\n"), "t")).otherwise(F.col("t")), "\n", "\n\n"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("b", before)
    return rows.select("conv_id", "turn", F.array_join(c.text_blocks(c.without_repeated_start(F.coalesce("b", F.lit("")), "t")), "\n\n").alias("text"))


@query(
    r"""SELECT conv_id, list_filter(list_distinct(list_transform(string_split(t, chr(10)), lambda x: rtrim(x))), lambda x: x <> '') IS NOT NULL AS known, len(list_distinct(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS blocks FROM (SELECT conv_id, string_agg(concat(text, chr(10), role, ' '), chr(10)) AS t FROM conversations GROUP BY conv_id)"""
)
def unique_blocks(spark, folder):
    """Different blocks of conversations."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(F.concat("text", F.lit("\n"), "role", F.lit(" "))), "\n").alias("t"))
    return rows.select("conv_id", F.lit(True).alias("known"), F.size(c.unique_blocks(F.split("t", "\n"))).alias("blocks"))


@query(
    r"""WITH ls AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations), t AS (SELECT conv_id, turn, i - 1 AS pos, CASE WHEN (i + turn) % 7 = 0 THEN '12:30' WHEN (i + turn) % 7 = 3 THEN concat(conv_id, '拍了拍', turn) ELSE trim(line) END AS text FROM ls), k AS (SELECT *, CASE WHEN text = '12:30' THEN 'timestamp' WHEN contains(text, '拍了拍') THEN 'system' ELSE 'message' END AS kind FROM t WHERE text <> '')
SELECT conv_id, turn, pos, kind, CASE WHEN kind = 'message' THEN 'unknown' ELSE 'system' END AS speaker, CASE WHEN kind = 'message' THEN 'unknown' ELSE 'center' END AS side, CASE WHEN kind = 'message' THEN 0.20 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN kind = 'message' THEN 2 ELSE 0 END AS flags FROM k"""
)
def fallback_messages(spark, folder):
    """Lines of screenshots without coordinates as messages."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    at = (F.col("pos") + 1 + F.col("turn")) % 7
    rows = rows.withColumn("line", F.when(at == 0, "12:30").when(at == 3, F.concat("conv_id", F.lit("拍了拍"), "turn")).otherwise(F.col("raw")))
    out = c.fallback_messages(rows, F.col("text").rlike(r"^\d{1,2}:\d{2}$"))
    return out.select("conv_id", "turn", "pos", "kind", "speaker", "side", "confidence", F.size("review_flags").alias("flags"))


@query(
    r"""WITH p AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id * 7 % 20 END AS n, event_id % 4 AS o, event_id % 5 = 0 AS s, CASE WHEN event_id % 7 <> 0 THEN 1 END AS f, lag(CASE WHEN event_id % 3 <> 0 THEN event_id * 7 % 20 END) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT event_id, CASE WHEN b IS NOT NULL AND n IS NOT NULL THEN CASE WHEN n - b = 1 THEN 'page_number_continuity' WHEN n - b > 1 THEN concat('page_number_gap_', n - b) ELSE 'page_number_conflict' END WHEN o > 0 THEN concat('text_overlap_', o) WHEN s THEN 'starts_new_section' WHEN f IS NOT NULL THEN 'filename_number' ELSE 'fallback_order' END AS reason FROM p"""
)
def order_reasons(spark, folder):
    """Why a page follows another."""
    i = F.col("event_id")
    rows = table(spark, folder, "events").withColumn("n", F.when(i % 3 != 0, i * 7 % 20))
    rows = rows.withColumn("b", F.lag("n").over(Window.partitionBy("user_id").orderBy("event_id")))
    return rows.select("event_id", c.order_reason(F.col("b"), F.col("n"), i % 4, i % 5 == 0, F.when(i % 7 != 0, 1)).alias("reason"))


@query(
    """WITH p AS (SELECT user_id AS book, event_id, CASE WHEN user_id % 4 = 0 AND event_id % 90 = 0 THEN NULL ELSE event_id % 17 END AS split_index, CASE WHEN user_id % 5 = 0 THEN event_id % 2 ELSE 1 END AS split_group FROM events), ok AS (SELECT book FROM p GROUP BY book HAVING count(*) = count(split_index) AND count(DISTINCT split_group) = 1)
SELECT book, event_id, row_number() OVER (PARTITION BY book ORDER BY split_index, event_id) AS order_index FROM p WHERE book IN (SELECT book FROM ok)"""
)
def split_page_order(spark, folder):
    """Order of the pieces of long images."""
    i, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, folder, "events").select(u.alias("book"), "event_id", F.when(~((u % 4 == 0) & (i % 90 == 0)), i % 17).alias("split_index"), F.when(u % 5 == 0, i % 2).otherwise(1).alias("split_group"), i.alias("y_start"), F.lit("a").alias("name"))
    return c.split_order(rows, "book").select("book", "event_id", "order_index")


@query(
    LINES_SQL
    + r"""SELECT doc_id, concat(trim(regexp_replace(regexp_replace(regexp_replace(t, '\[(\d+)\]', '[^\1]', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), E' \n\t'), chr(10)) AS text, regexp_replace(regexp_replace(s, '(?i)<st\b[^>]*>', '', 'g'), '(?i)</st>', '', 'g') AS plain FROM (SELECT doc_id, string_agg(trim(substr(line, 1, 8)) || CASE WHEN pos % 3 = 0 THEN chr(10) || chr(10) || '[' || pos || ']' ELSE '' END, chr(10) ORDER BY pos) AS t, string_agg('<ST c="1">' || line || '</st>', chr(10) ORDER BY pos) AS s FROM lines GROUP BY doc_id)"""
)
def generic_cleaning(spark, folder):
    """The last step of all cleaning, on short lines that are not joined; and texts without st tags."""
    each = F.split("text", "\n")
    t = F.array_join(F.transform(each, lambda x, i: F.concat(F.trim(F.substring(x, 1, 8)), F.when(i % 3 == 0, F.concat(F.lit("\n\n["), i.cast("string"), F.lit("]"))).otherwise(""))), "\n")
    s = F.array_join(F.transform(each, lambda x: F.concat(F.lit('<ST c="1">'), x, F.lit("</st>"))), "\n")
    return derived.marked_documents(spark, folder).select("doc_id", c.generic(t).alias("text"), c.without_st(s).alias("plain"))
