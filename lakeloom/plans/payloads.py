"""Queries of payload normalisers, on JSON and XML texts derived from events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import credential_name
from ..operators import payloads as p
from .registry import query, table

_c = F.col
#: A JSON text of a document model from an event, spelled alike for both engines.
MODEL = """concat('{"texts": [{"label": "', CASE event_id % 3 WHEN 0 THEN 'section_header' WHEN 1 THEN 'paragraph' ELSE 'Title' END, '", "text": " Head ', event_id % 50, ' ", "level": "', CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '2' END, '", "page": ', event_id % 9, ', "bbox": {"l": 1.5, "t": 2, "r": 3, "b": ', event_id % 7, '}}, {"type": "heading", "orig": "',
 event_type, '", "page": 1, "bbox": {"left": 1, "top": 2, "right": 3', CASE WHEN event_id % 2 = 0 THEN ', "bottom": 4' ELSE '' END, '}}, {"label": "text", "text": "body"}]}')"""
PAYLOAD = """concat('{"schema_version": "', CASE event_id % 5 WHEN 0 THEN 'layout-candidates-v1' WHEN 1 THEN 'agent-batch-v1' WHEN 2 THEN 'agent-batch-plan-v1' WHEN 3 THEN 'other' ELSE 'table-candidates-v1' END, '", ', CASE WHEN event_id % 3 = 0 THEN '"backend": "b", ' ELSE '' END, CASE WHEN event_id % 4 = 0 THEN '"pages": [1], ' WHEN event_id % 4 = 1 THEN '"pages": 7, ' ELSE '' END,
 CASE WHEN event_id % 7 = 0 THEN '"summary": {}, "selection": {}, "validation": {}, "manifest": "m", "created_at": "t", ' ELSE '' END, '"contract": {"schema_version": "', CASE WHEN event_id % 2 = 0 THEN 'agent-batch-contract-v1' ELSE 'x' END, '", "payload_schema_version": "agent-batch-v1"}, "api_key": "', event_id % 2, '", "deep": [{"token": "t', event_id, '"}, {"password": ""}]}')"""


def _events(spark, folder, **texts):
    return table(spark, folder, "events").selectExpr("event_id", *(f"{v} AS {k}" for k, v in texts.items()))


_J = "json_extract_string"


@query(
    f"""WITH m AS (SELECT event_id, {MODEL} AS j FROM events), t AS (SELECT event_id, unnest([0, 1, 2]) AS i, j FROM m),
x AS (SELECT event_id, i, lower(coalesce(nullif({_J}(j, '$.texts[' || i || '].label'), ''), {_J}(j, '$.texts[' || i || '].type'), '')) AS label, trim(coalesce({_J}(j, '$.texts[' || i || '].text'), {_J}(j, '$.texts[' || i || '].orig'), '')) AS title, {_J}(j, '$.texts[' || i || '].level') AS lv, {_J}(j, '$.texts[' || i || '].page')::INT AS page,
 CASE WHEN i = 0 THEN true WHEN i = 1 THEN event_id % 2 = 0 ELSE false END AS box FROM t)
SELECT event_id, list(concat(title, '/', coalesce(CASE WHEN regexp_matches(lv, '^\\d+$') THEN lv END, '-'), '/', page, '/', CASE WHEN box THEN 4 ELSE 0 END) ORDER BY i) FILTER (regexp_matches(label, 'section|heading|title') AND title <> '') AS headings, count(*)::INT AS items, count(DISTINCT page)::INT AS pages, count(*) FILTER (box)::INT AS boxes FROM x GROUP BY event_id"""
)
def model_headings(spark, folder):
    """Headings and provenance of document models."""
    rows = _events(spark, folder, j=MODEL).withColumn("texts", F.from_json("j", f"texts array<struct<{p.TEXT_ITEM}>>")["texts"])
    show = F.transform(p.heading_items(_c("texts")), lambda h: F.concat(h["title"], F.lit("/"), F.coalesce(h["level"].cast("string"), F.lit("-")), F.lit("/"), h["page"].cast("string"), F.lit("/"), F.coalesce(F.size(h["bbox"]), F.lit(0)).cast("string")))
    return rows.select("event_id", show.alias("headings"), p.provenance(_c("texts")).alias("n")).select("event_id", "headings", "n.items", "n.pages", "n.boxes")


@query(
    f"""WITH m AS (SELECT event_id, {PAYLOAD} AS j FROM events), k AS (SELECT *, json_keys(j) AS keys, {_J}(j, '$.schema_version') AS s, CASE event_id % 4 WHEN 0 THEN 'layout_candidates_json' WHEN 1 THEN 'table_candidates_json' WHEN 2 THEN 'formula_candidates_json' ELSE 'nothing' END AS kind FROM m),
e AS (SELECT *, CASE kind WHEN 'layout_candidates_json' THEN 'layout-candidates-v1' WHEN 'table_candidates_json' THEN 'table-candidates-v1' WHEN 'formula_candidates_json' THEN 'formula-candidates-v1' END AS want FROM k)
SELECT event_id, CASE WHEN want IS NULL THEN ['unknown_schema'] ELSE list_filter([CASE WHEN NOT list_contains(keys, 'backend') THEN 'missing_backend' END, CASE WHEN NOT list_contains(keys, 'pages') THEN 'missing_pages' END, CASE WHEN s <> want THEN 'wrong_schema_version' END, CASE WHEN event_id % 4 = 1 THEN 'pages_must_be_a_list' END], lambda x: x IS NOT NULL) END AS artifact,
 list_filter([CASE WHEN s NOT LIKE 'agent-batch%' THEN 'unsupported_schema' END, CASE WHEN s = 'agent-batch-v1' THEN concat('missing:', array_to_string(list_filter(['artifact_summary', 'contract', 'created_at', 'manifest', 'next_actions', 'results', 'schema_version', 'selection', 'summary'], lambda f: NOT list_contains(keys, f)), ','))
  WHEN s = 'agent-batch-plan-v1' AND event_id % 7 > 0 THEN concat('missing:', array_to_string(list_filter(['contract', 'created_at', 'manifest', 'schema_version', 'selection', 'summary', 'validation'], lambda f: NOT list_contains(keys, f)), ',')) END, CASE WHEN event_id % 2 = 1 THEN 'contract_version' END, CASE WHEN s <> 'agent-batch-v1' THEN 'contract_payload' END], lambda x: x IS NOT NULL) AS batch,
 CASE s WHEN 'layout-candidates-v1' THEN 'layout_candidates' WHEN 'table-candidates-v1' THEN 'table_candidates' ELSE s END AS kind FROM e"""
)
def payload_problems(spark, folder):
    """What is wrong with artifacts and batches, and which normaliser takes them."""
    i = _c("event_id")
    rows = _events(spark, folder, j=PAYLOAD)
    got = F.from_json("j", "schema_version string, pages string, contract struct<schema_version: string, payload_schema_version: string>")
    kind = F.when(i % 4 == 0, "layout_candidates_json").when(i % 4 == 1, "table_candidates_json").when(i % 4 == 2, "formula_candidates_json").otherwise("nothing")
    rows = rows.withColumns({"g": got, "keys": F.json_object_keys("j"), "kind": kind})
    listed = F.when(F.ltrim(_c("g.pages")).startswith("["), _c("g.pages"))
    return rows.select(
        "event_id",
        p.artifact_errors(_c("kind"), _c("g.schema_version"), _c("keys"), listed).alias("artifact"),
        p.batch_errors(_c("g.schema_version"), _c("keys"), _c("g.contract.schema_version"), _c("g.contract.payload_schema_version")).alias("batch"),
        p.source_kind(_c("j"), _c("g.schema_version")).alias("kind"),
    )


@query(
    """SELECT event_id, ['$.api_key', '$.deep[0].token'] AS paths FROM events"""
)
def credential_paths(spark, folder):
    """Paths of filled credential fields in nested JSON."""
    rows = p.json_fields(_events(spark, folder, j=PAYLOAD), "event_id", "j")
    return rows.filter(credential_name("name") & (_c("value") != "")).groupBy("event_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 2 THEN concat('see ', props, ' there') WHEN 3 THEN concat('see {', event_id) WHEN 4 THEN '' ELSE '[1]' END AS t, props FROM events)
SELECT event_id, CASE WHEN event_id % 6 <= 2 THEN json_extract(props, '$.k')::INT END AS k, event_id % 6 = 0 OR event_id % 6 = 5 AND false AS line FROM t"""
)
def json_objects(spark, folder):
    """JSON objects of answers, and the lines that are one."""
    i = _c("event_id")
    rows = table(spark, folder, "events").withColumn(
        "t", F.when(i % 6 == 0, _c("props")).when(i % 6 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i % 6 == 2, F.concat(F.lit("see "), "props", F.lit(" there"))).when(i % 6 == 3, F.concat(F.lit("see {"), i)).when(i % 6 == 4, "").otherwise("[1]")
    )
    lines = p.json_lines(rows, "t").select("event_id", F.lit(True).alias("line"))
    return rows.select("event_id", F.from_json(p.json_object("t"), "k int")["k"].alias("k")).join(lines, "event_id", "left").withColumn("line", F.coalesce("line", F.lit(False)))


@query(
    """SELECT user_id, event_id % 3 AS ordinal, concat('s', event_id) AS id, event_type AS category FROM events WHERE event_id < 3000"""
)
def manifest_samples(spark, folder):
    """Samples of manifests, bare or in a field."""
    item = F.format_string('{"id": "s%d", "category": "%s"}', "event_id", "event_type")
    rows = table(spark, folder, "events").filter("event_id < 3000")
    rows = rows.select("user_id", "event_id", F.when(_c("event_id") % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"samples": ['), item, F.lit("]}"))).alias("j"))
    out = p.samples(rows, "j", "id: string, category: string", "user_id")
    return out.withColumn("ordinal", F.substring("id", 2, 20).cast("long") % 3).select("user_id", "ordinal", "id", "category")


@query(
    """SELECT event_id, list_transform(range(0, 2 + (event_id % 3)::INT), lambda i: concat(CASE WHEN i < 2 THEN concat(i, '') ELSE '-' END, ':t', i, ':', CASE WHEN i < event_id % 2 + 1 THEN concat(i, '.5') ELSE '-' END)) AS rows,
 CASE event_id % 4 WHEN 0 THEN [1.25, 2.0, 3.0, 4.0] WHEN 1 THEN [1.0, 0.0, 5.0, 2.0] WHEN 2 THEN [0.0, 1.0, 4.0, 3.0] END::DOUBLE[] AS box FROM events"""
)
def ocr_shapes(spark, folder):
    """Parallel OCR values side by side, and boxes of several shapes."""
    i = _c("event_id")
    n = (i % 3 + 1).cast("int")
    texts = F.transform(F.sequence(F.lit(0), n), lambda x: F.concat(F.lit("t"), x.cast("string")))
    boxes, scores = F.array(F.lit(0), F.lit(1)), F.transform(F.sequence(F.lit(0), (i % 2).cast("int")), lambda x: x + 0.5)
    show = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    rows = F.transform(p.parallel_rows(boxes, texts, scores), lambda r: F.concat(show(r["box"]), F.lit(":"), r["text"], F.lit(":"), show(r["score"])))
    corner = F.when(i % 4 == 0, F.struct(F.lit(1.249).alias("x1"), F.lit(2.0).alias("y1"), F.lit(3.0).alias("x2"), F.lit(4.0).alias("y2")))
    numbers = F.when(i % 4 == 1, F.array(F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)))
    points = F.when(i % 4 == 2, F.array(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(1.0))))
    return table(spark, folder, "events").select("event_id", rows.alias("rows"), p.any_box(corner, numbers, points).alias("box"))


@query(
    """WITH pg AS (SELECT conv_id, turn, text, role FROM conversations) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number, turn AS index, text AS markdown, CASE WHEN role = 'system' THEN 'candidate' ELSE role END AS evidence FROM pg"""
)
def result_pages(spark, folder):
    """Pages of nested results."""
    item = F.struct("turn", F.struct(_c("turn").cast("int").alias("index"), _c("text").alias("markdown"), F.when(_c("role") == "system", "").otherwise(_c("role")).alias("status")).alias("p"))
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("pages"))
    return p.result_pages(rows, "pages", "conv_id")


@query(
    """SELECT event_id, concat('Paper ', event_id % 40) AS title, CASE WHEN event_id % 3 = 0 THEN ['Ada', 'Bo'] ELSE ['Ada'] END AS authors, CASE WHEN event_id % 2 = 0 THEN concat('10.1/', event_id) ELSE '' END AS doi, (event_id % 4)::INT AS "references", ['One', 'Two'] AS sections, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS author_count, 2 AS section_count FROM events WHERE event_id < 2000"""
)
def tei_papers(spark, folder):
    """Titles, authors, references and sections of TEI documents."""
    i = _c("event_id")
    author = lambda n: F.lit(f"<author><persName><surname> {n} </surname></persName></author>")
    tei = F.concat(
        F.lit("<TEI><titleStmt><title> Paper  "), i % 40, F.lit("</title>"), author("Ada"), F.when(i % 3 == 0, author("Bo")).otherwise(author("Ada")), F.lit("</titleStmt>"),
        F.when(i % 2 == 0, F.concat(F.lit("<idno type='DOI'>10.1/"), i, F.lit("</idno>"))).otherwise(""), F.lit("<text><body><div><head>One</head></div><div><head>Two</head></div></body></text><listBibl>"),
        F.repeat(F.lit("<biblStruct/>"), (i % 4).cast("int")), F.lit("</listBibl></TEI>"),
    )
    rows = table(spark, folder, "events").filter("event_id < 2000").select("event_id", p.paper(tei).alias("p")).select("event_id", "p.*")
    n = p.paper_summary(_c("title"), _c("authors"), _c("doi"), F.lit(""), _c("sections"))
    return rows.withColumn("n", n).select("event_id", "title", "authors", "doi", "references", "sections", "n.author_count", "n.section_count")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['Part & 1', concat('B', event_id)] ELSE [concat('B', event_id)] END AS ncx, CASE WHEN event_id % 2 = 0 THEN [concat(event_id % 90, ':note x'), '7:b'] ELSE [concat(event_id % 90, ':note x')] END AS notes,
 CASE WHEN event_id % 4 = 0 THEN ['a|b.png', concat(event_id, '.png')] ELSE [concat(event_id, '.png')] END AS sources, CASE WHEN event_id % 5 = 0 THEN [' '] WHEN event_id % 5 = 1 THEN ['a', 'b'] ELSE ['one'] END AS pages, ['1 A', '2 a1', '2 a2', concat('1 ', event_id)] AS outline FROM events"""
)
def book_parts(spark, folder):
    """Contents lists, notes, orders, pages and outlines of books."""
    i = _c("event_id")
    label = lambda c: F.concat(F.lit("<navLabel id='1'><text>"), c, F.lit("</text></navLabel>\n"))
    ncx = F.concat(F.when(i % 3 == 0, label(F.lit("<b>Part</b> &amp; 1"))).otherwise(label(F.lit(" "))), label(F.concat(F.lit("B"), i)))
    note = lambda n, b: F.concat(F.lit('<aside epub:type="rearnote" id="footnote_'), n, F.lit('"><p>'), b, F.lit("</p></aside>\n"))
    raw = F.concat(note(i % 90, F.lit('<a href="#r">[3]</a> <i>note</i>   x ')), F.when(i % 2 == 0, note(F.lit(7), F.lit("b"))).otherwise(note(F.lit(8), F.lit(" "))))
    order = F.concat(F.lit("| # | Source |\n| --- | --- |\n"), F.when(i % 4 == 0, F.lit("| 1 | a\\|b.png |\n")).otherwise(F.lit("text\n")), F.lit("| 2 | "), i, F.lit(".png |"))
    text = F.when(i % 5 == 0, F.lit(" ")).when(i % 5 == 1, F.lit("a\f \fb\f")).otherwise(F.lit("one"))
    outline = F.array(F.struct(F.lit("A").alias("title"), F.array(F.lit("a1"), F.lit("a2")).alias("items")), F.struct(i.cast("string").alias("title"), F.lit(None).cast("array<string>").alias("items")))
    return table(spark, folder, "events").select(
        "event_id",
        p.ncx_titles(ncx).alias("ncx"),
        F.transform(p.rear_notes(raw), lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["body"])).alias("notes"),
        p.order_sources(order).alias("sources"),
        p.form_feed_pages(text).alias("pages"),
        F.transform(p.flat_outline(outline), lambda x: F.concat(x["level"].cast("string"), F.lit(" "), x["title"])).alias("outline"),
    )


@query(
    """SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN concat('original_render=i', event_id) END, CASE WHEN event_id % 3 = 0 THEN 'layout_overlay=o' END, CASE WHEN event_id % 5 = 0 THEN 'markdown=m' END], lambda x: x IS NOT NULL) AS refs,
 list_filter([CASE WHEN event_id % 2 = 0 THEN 'reading_order' END, CASE WHEN event_id % 4 IN (0, 1) THEN 'table_structure' END, CASE WHEN event_id % 4 = 2 THEN 'formula_retention' END, CASE WHEN event_id % 3 = 0 THEN 'source_ref' END], lambda x: x IS NOT NULL) AS hints,
 array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'table_like' END, CASE WHEN event_id % 3 = 0 THEN 'image_heavy' END], lambda x: x IS NOT NULL), ',') AS flags, CASE WHEN event_id % 3 = 0 THEN 0.9 WHEN event_id % 3 = 1 THEN 0.65 ELSE 0.45 END::DOUBLE AS confidence,
 round(CASE WHEN event_id % 3 = 0 THEN 0.9 WHEN event_id % 3 = 1 THEN 0.65 ELSE 0.45 END * 0.08 + greatest(0, 0.04 - event_id % 60 * 0.001), 6)::DOUBLE AS tie, ['Aa b/12.5/F', 'c/0.0/'] AS lines, CASE WHEN event_id % 2 = 0 THEN ['a=1', 'b=x'] ELSE ['b=x'] END AS metadata, 'x y' AS sample FROM events"""
)
def page_details(spark, folder):
    """Files, hints, flags, order confidence, lines and metadata of pages."""
    i = _c("event_id")
    some = lambda n, v: F.when(i % n == 0, v)
    page = F.struct(some(2, F.concat(F.lit("i"), i)).alias("image"), some(3, F.lit("o")).alias("overlay_path"), some(5, F.lit("m")).alias("markdown_path"))
    flags = F.struct((i % 2 == 0).alias("table_like"), (i % 3 == 0).alias("image_heavy"), F.lit(None).cast("boolean").alias("two_column_like"), F.lit(False).alias("header_footer_candidate"))
    span = lambda t, s, f: F.struct(F.lit(t).alias("text"), F.lit(s).cast("double").alias("size"), F.lit(f).cast("string").alias("font"))
    line = lambda *s: F.struct(F.array(*s).alias("spans"))
    blocks = F.array(F.struct(F.lit(0).alias("type"), F.array(line(span("A", 10.0, "F"), span("a  b", 12.5, "G")), line(span(" ", 9.0, "X")), line(span("c", None, None))).alias("lines")), F.struct(F.lit(1).alias("type"), F.array(line(span("no", 1.0, "Q"))).alias("lines")))
    confidence = p.order_confidence(some(3, i), F.when(i % 3 == 1, i))
    kind = F.when(i % 4 == 0, "table").when(i % 4 == 1, "table_cell").when(i % 4 == 2, "formula").otherwise("text")
    metadata = F.when(i % 2 == 0, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("1"))).otherwise(F.create_map(F.lit("b"), F.lit("x")))
    return table(spark, folder, "events").select(
        "event_id",
        p.page_refs(page, ["image", "overlay_path", "markdown_path"]).alias("refs"),
        p.relationship_hints(kind, some(2, F.lit("1")), some(3, F.lit("s"))).alias("hints"),
        p.page_flags(flags).alias("flags"),
        confidence.alias("confidence"),
        F.round(p.tie_breaker(confidence, i % 60), 6).alias("tie"),
        F.transform(p.line_items(blocks), lambda x: F.concat_ws("/", x["text"], x["font_size"].cast("string"), x["font"])).alias("lines"),
        p.sane_metadata(metadata).alias("metadata"),
        p.text_sample(F.lit("  x   yz "), 3).alias("sample"),
    )
