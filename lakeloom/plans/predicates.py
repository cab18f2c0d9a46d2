"""Queries of the line and page tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.text import strip
from ..operators.pages import heading_guess
from . import derived
from .derived import LINES_SQL, RUNS_SQL
from .registry import query

_FILLED = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')"
_TRIMMED = f"list_transform({_FILLED}, lambda x: trim(x, ' ' || chr(9)))"


@query(
    LINES_SQL
    + rf"""SELECT doc_id,
 text <> '' AND (contains(lower(text), '目录') OR contains(lower(text), 'contents') OR len(regexp_extract_all(text, '\.{{3,}}\s*\d{{1,4}}')) >= 3 OR len(regexp_extract_all(lower(text), '(?m)^\s*(?:第.+章|chapter\s+\d+|[一二三四五六七八九十]+[、.])')) >= 5) AS toc_page,
 len(list_filter({_FILLED}, lambda x: contains(x, chr(9)) OR len(regexp_extract_all(x, '\s{{2,}}')) >= 3)) >= 4 OR len(list_filter({_FILLED}, lambda x: len(regexp_extract_all(x, '\d+(?:[.,]\d+)?')) >= 4)) >= 4 AS table_page,
 len({_FILLED}) >= 6 AND len(list_filter({_FILLED}, lambda x: length(trim(regexp_replace(x, '^\s*(?:#{{1,6}}|[-*+]\s+|\d+[.)]\s+)', ''), ' ' || chr(9))) <= 36)) / len({_FILLED})::DOUBLE >= 0.7 AS fragmented,
 len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 AS tabular,
 len({_TRIMMED}) >= 5 AND len(list_filter({_TRIMMED}, lambda x: regexp_matches(x, '(\.{{2,}}|\s{{2,}}|第.+[章节篇部]).{{0,60}}\d{{1,4}}$'))) >= 3 AS contents_lines,
 len({_TRIMMED}) >= 8 AND len(list_filter({_TRIMMED}, lambda x: length(x) <= 12)) / len({_TRIMMED})::DOUBLE > 0.55 AS short_lines,
 length(regexp_replace(text, '\s+', '', 'g')) >= 40 AND len(regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '[□�|]|[A-Za-z]{{1,2}}[^\w\s][A-Za-z]{{1,2}}')) / length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE > 0.03 AS odd_characters
 FROM marked"""
)
def page_predicates(spark, folder):
    """Seven tests of a page's text."""
    rows = derived.marked_documents(spark, folder)
    return rows.select("doc_id", *(f("text").alias(f.__name__) for f in (p.toc_page, p.table_page, p.fragmented, p.tabular, p.contents_lines, p.short_lines, p.odd_characters)))


_NEXT = ", nexts AS (SELECT *, coalesce(first_value(CASE WHEN trim(line) <> '' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS following FROM (SELECT doc_id, pos, trim(line) AS line FROM lines)) "
_NOISE = "(line IN ('高中医', '名老中医走路', '多老中医建露', '老中医', '·老中匠') OR (regexp_matches(line, '^[·•]') AND length(line) <= 12))"


@query(
    LINES_SQL
    + _NEXT
    + rf"""SELECT doc_id, pos, {_NOISE} AS ocr_header,
 NOT (line = '' OR regexp_matches(line, '^(?:#|-|\*|>|\||<!--)') OR length(line) > 24 OR regexp_matches(line, '^[\d\s().（）\-—–]+$') OR regexp_matches(line, '^[A-Za-z]{{1,8}}$') OR {_NOISE} OR line IN ('目', '录', 'MULU')) AND (following = '' OR length(following) >= 18 OR line IN ('目录', '序', '编者的话', '出版者的话')) AS ocr_heading,
 coalesce(TRY_CAST(regexp_extract(regexp_replace(line, '\s+', '', 'g'), '^[\-—–_·•]*第?(\d{{1,4}})页?(?:/\d{{1,4}})?[\-—–_·•]*$', 1) AS INT) >= 0, false) AS ocr_page_number,
 line <> '' AND length(line) <= 120 AND NOT regexp_matches(line, '[。！？!?；;，,]$') AS layout_heading,
 line <> '' AND length(line) <= 80 AND NOT regexp_matches(line, '^[-*>|]') AND NOT regexp_matches(line, '^\d{{1,4}}$') AND NOT regexp_matches(line, '[。！？!?；;，,]$') AS font_heading,
 regexp_matches(line, '^#{{1,6}}\s+\S+|^>\s+|^(?:\||[-*+]\s+|\d+[.)]\s+)|^</?\w+[^>]*>$') AS markdown_line,
 regexp_matches(lower(line), '^traceback|^error|not recognized|exception') AS probe_error,
 regexp_matches(lower(line), '^(?:https?://|data:|file:)') AS external_image,
 CASE WHEN length(regexp_replace(line, '\s+', '', 'g')) > 24 OR regexp_matches(regexp_replace(line, '\s+', '', 'g'), '^\d{{1,4}}$') OR regexp_matches(regexp_replace(line, '\s+', '', 'g'), '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\d+|Part\w+)') OR regexp_matches(regexp_replace(line, '\s+', '', 'g'), '[。！？!?；;：:，,、]$') THEN '' ELSE regexp_replace(line, '\s+', '', 'g') END AS screen_key,
 length(line) >= 2 AND (regexp_matches(line, '[\\_^={{}}∑∫αβγ]') OR regexp_matches(line, '[A-Za-z0-9]\s*[+\-*/<>]\s*[A-Za-z0-9]')) AS latex
 FROM nexts WHERE regexp_matches(line, '^[\x20-\x7E一-鿿（）•·]*$')"""
)
def line_predicates(spark, folder):
    """Ten tests of a line; the next line that is not blank comes from one running pass in reverse order."""
    rows = derived.marked_lines(spark, folder).withColumn("line", F.trim("line"))
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("following", F.coalesce(F.last(F.nullif("line", F.lit("")), ignorenulls=True).over(back), F.lit("")))
    rows = rows.filter(F.col("line").rlike(r"^[\x20-\x7E一-鿿（）•·]*$"))
    tests = {
        "ocr_header": p.ocr_header("line"),
        "ocr_heading": p.ocr_heading("line", "following"),
        "ocr_page_number": p.ocr_page_number("line", F.lit(9000)),
        "layout_heading": p.layout_heading("line"),
        "font_heading": p.font_heading("line"),
        "markdown_line": p.markdown_line("line"),
        "probe_error": p.probe_error("line"),
        "external_image": p.external_image("line"),
        "screen_key": p.screen_key("line"),
        "latex": p.latex("line"),
    }
    return rows.select("doc_id", "pos", *(c.alias(n) for n, c in tests.items()))


@query(
    LINES_SQL
    + r"""SELECT m.doc_id, bool_or(t.guess) AS starts_section FROM marked m JOIN (SELECT doc_id, pos, trim(line) AS x,
 regexp_matches(trim(line), '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷](?:[^\w一-鿿À-ɏ]|$)|Chapter\s+\d+\b|Part\s+\w+\b)') OR regexp_matches(trim(line), '^\d+(?:\.\d+){0,3}[\s、.．]+') OR (length(trim(line)) BETWEEN 2 AND 28 AND NOT regexp_matches(trim(line), '[。！？.!?，,；;：:]$')) AS guess FROM lines WHERE pos < 5) t ON t.doc_id = m.doc_id GROUP BY m.doc_id"""
)
def section_starts(spark, folder):
    """Pages one of whose first five lines looks like a heading."""
    first = F.slice(F.split("text", "\n"), 1, 5)
    return derived.marked_documents(spark, folder).select("doc_id", F.exists(first, lambda x: heading_guess(strip(x), F.lit(True)).isNotNull()).alias("starts_section"))


@query(
    r"""SELECT doc_id, CASE WHEN length(trim(o, E' \n\t')) < 5000 THEN true WHEN length(trim(c, E' \n\t')) < 1000 OR length(trim(c, E' \n\t')) < length(trim(o, E' \n\t')) * 0.2 THEN false
 ELSE NOT (len(list_filter(string_split(o, chr(10)), lambda x: trim(x) <> '')) >= 200 AND len(list_filter(string_split(c, chr(10)), lambda x: trim(x) <> '')) < 25) END AS safe FROM (SELECT doc_id, repeat(text || chr(10), 4) AS o, substr(text, 1, 1 + doc_id::INT % 1500) AS c FROM documents)"""
)
def trim_guards(spark, folder):
    """Whether cutting a text to a prefix keeps enough of it."""
    rows = derived.table(spark, folder, "documents").select("doc_id", F.repeat(F.concat("text", F.lit("\n")), F.lit(4)).alias("o"), F.expr("substr(text, 1, 1 + cast(doc_id % 1500 as int))").alias("c"))
    return rows.select("doc_id", p.safe_trim("o", "c").alias("safe"))


_KEYS = ("api_key", "X-Api-Key", "max_tokens", "my client secret", "token", "user", "db_private_key", "token_count", "Authorization", "secretary", "session.auth.token", "password ")


@query(
    "WITH names AS (SELECT event_id, ["
    + ", ".join(f"'{k}'" for k in _KEYS)
    + r"""][event_id % 12 + 1] AS name, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM events)
SELECT event_id, name, k NOT IN ('max_tokens', 'token_count') AND (k IN ('api_key', 'x_api_key', 'token', 'authorization', 'password') OR regexp_matches(k, '(_access_token|_api_key|_auth_token|_client_secret|_id_token|_private_key|_refresh_token|_secret)$')) AS credential FROM names"""
)
def credential_fields(spark, folder):
    """Field names that hold credentials."""
    names = F.array(*(F.lit(k) for k in _KEYS))
    rows = derived.table(spark, folder, "events").select("event_id", F.get(names, (F.col("event_id") % 12).cast("int")).alias("name"))
    return rows.select("event_id", "name", p.credential_name("name").alias("credential"))


@query(
    RUNS_SQL
    + """SELECT id, coalesce(status, '') IN ('failed', 'timeout', 'unsupported', 'no_job') AS hard_failed,
 CASE WHEN id % 4 <> 0 THEN false WHEN NOT (id % 3 = 0) THEN id % 5 = 0 ELSE id % 5 = 0 OR coalesce(level = 'poor', false) OR headings = 0 END AS calibre,
 CASE WHEN id % 2 = 0 THEN false WHEN id % 5 IN (0, 1, 2) THEN true WHEN id % 5 = 3 THEN id % 7 = 0 ELSE true END AS pdf_tool, id % 3 = 1 AS docling FROM runs"""
)
def fallback_decisions(spark, folder):
    """Whether a failed or poor run is handed to another route."""
    i = F.col("id")
    pick = lambda n, *names: F.get(F.array(*(F.lit(x) for x in names)), (i % n).cast("int"))
    details = F.when(i % 7 == 0, "Max retries exceeded").otherwise("other")
    return derived.runs(spark, folder).select(
        "id",
        p.hard_failed(F.col("status")).alias("hard_failed"),
        F.coalesce(p.calibre_fallback(pick(4, ".epub", ".pdf", ".md", ".txt"), i % 3 == 0, i % 5 == 0, F.coalesce("level", F.lit("")), F.col("headings")), F.lit(False)).alias("calibre"),
        p.pdf_tool_fallback(pick(2, "pymupdf4llm", "mineru"), pick(5, "timeout", "failed", "missing", "process", "other"), details).alias("pdf_tool"),
        p.docling_fallback(pick(3, ".pdf", ".docx", ".epub")).alias("docling"),
    )


_TARGETS = """SELECT id, blocks % 3 AS table_count, chars % 4 AS formula_count, CASE WHEN id % 5 = 0 THEN ['table_candidates'] WHEN id % 5 = 1 THEN ['formula_candidates', 'x'] ELSE ['x'] END AS targets, CASE WHEN id % 7 = 0 THEN ['table_html'] WHEN id % 7 = 1 THEN ['formula_crop'] ELSE ['page'] END AS roles, CASE id % 6 WHEN 0 THEN 'Formula' WHEN 1 THEN 'display_formula' WHEN 2 THEN 'text' WHEN 3 THEN 'Latex' ELSE '' END AS kind FROM runs"""


@query(
    RUNS_SQL
    + f""", targets AS ({_TARGETS}) SELECT id, table_count > 0 OR list_contains(targets, 'table_candidates') OR len(list_filter(roles, lambda r: starts_with(r, 'table_'))) > 0 AS table_evidence,
 formula_count > 0 OR list_contains(targets, 'formula_candidates') OR len(list_filter(roles, lambda r: starts_with(r, 'formula_'))) > 0 AS formula_evidence,
 lower(kind) IN ('formula', 'isolated', 'embedding', 'latex', 'math', 'math_formula') OR id % 13 = 0 OR (contains(lower(kind), 'formula') AND id % 2 = 0) AS formula_item FROM targets"""
)
def evidence_predicates(spark, folder):
    """Pages and items with tables or formulas to look at."""
    rows = derived.runs(spark, folder)
    i = F.col("id")
    targets = F.when(i % 5 == 0, F.array(F.lit("table_candidates"))).when(i % 5 == 1, F.array(F.lit("formula_candidates"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    roles = F.when(i % 7 == 0, F.array(F.lit("table_html"))).when(i % 7 == 1, F.array(F.lit("formula_crop"))).otherwise(F.array(F.lit("page")))
    kind = F.when(i % 6 == 0, "Formula").when(i % 6 == 1, "display_formula").when(i % 6 == 2, "text").when(i % 6 == 3, "Latex").otherwise("")
    return rows.select(
        "id",
        p.table_evidence(F.col("blocks") % 3, targets, roles).alias("table_evidence"),
        p.formula_evidence(F.col("chars") % 4, targets, roles).alias("formula_evidence"),
        p.formula_item(kind, i % 13 == 0, F.when(i % 2 == 0, "t").otherwise(" ")).alias("formula_item"),
    )
