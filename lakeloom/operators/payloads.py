"""Payloads of outside tools and artifacts as rows: JSON of several shapes, TEI and NCX documents, outlines, manifests, contracts.

JSON is read with a declared schema (fields that lack are null), so it stays in Catalyst. Only what must walk any JSON is an Arrow function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, col, fence_free, strip, unescape
from .decisions import named

# Roles of a page's files, required fields of contracts, schemas of candidate artifacts.
PAGE_ROLES = (("image", "original_render"), ("source", "source_page"), ("overlay_path", "layout_overlay"), ("layout_overlay", "layout_overlay"), ("ocr_blocks_path", "ocr_blocks"), ("markdown_path", "markdown"))
BATCH_FIELDS = {
    "agent-batch-v1": ("artifact_summary", "contract", "created_at", "manifest", "next_actions", "results", "schema_version", "selection", "summary"),
    "agent-batch-plan-v1": ("contract", "created_at", "manifest", "schema_version", "selection", "summary", "validation"),
}
CANDIDATE_SCHEMAS = {"layout_candidates_json": "layout-candidates-v1", "table_candidates_json": "table-candidates-v1", "formula_candidates_json": "formula-candidates-v1", "document_vlm_result_json": "document-vlm-result-v1"}


def json_object(text: Column | str) -> Column:
    """The JSON object of a text, as text: without an outer fence, or what stands between its first and last brace; `{}` for none."""
    plain = fence_free(strip(col(text)))
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    whole = F.when(plain.startswith("{") & F.try_parse_json(plain).isNotNull(), plain)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner), F.lit("{}"))


def json_lines(rows: DataFrame, line: str) -> DataFrame:
    """The lines that hold a JSON object; blank, broken and other lines are left out."""
    t = F.trim(line)
    return rows.filter(t.startswith("{") & F.try_parse_json(t).isNotNull())


def samples(manifests: DataFrame, text: str, item: str, key: str) -> DataFrame:
    """Samples (schema `item`) of manifests: of their field samples, or of a bare list."""
    t = F.regexp_replace(col(text), "^﻿", "")
    listed = F.from_json(t, f"array<struct<{item}>>")
    held = F.from_json(t, f"samples array<struct<{item}>>")["samples"]
    rows = manifests.select(key, F.posexplode(F.when(F.ltrim(t).startswith("["), listed).otherwise(held)).alias("ordinal", "s"))
    return rows.select(key, "ordinal", "s.*")


def sane_metadata(metadata: Column, limit: int = 30) -> Column:
    """The first keys of a map in their order, values cut to 500 characters."""
    some = F.slice(F.array_sort(F.map_entries(metadata)), 1, limit)
    return F.transform(some, lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], 1, 500)))


def text_sample(text: Column, limit: int) -> Column:
    return collapse(text, limit) if limit > 0 else F.lit("")


TEXT_ITEM = "label string, type string, text string, orig string, level string, page int, bbox struct<l: double, t: double, r: double, b: double, left: double, top: double, right: double, bottom: double>"


def item_box(box: Column) -> Column:
    """Corners of a box in either spelling, null unless all four are there."""
    short, long = F.array(box["l"], box["t"], box["r"], box["b"]), F.array(box["left"], box["top"], box["right"], box["bottom"])
    whole = lambda a: F.when(F.forall(a, lambda v: v.isNotNull()), a)
    return F.coalesce(whole(short), whole(long))


def heading_items(texts: Column) -> Column:
    """Section headings among a document model's text items: title, level, page, bbox."""
    label = lambda i: F.lower(F.coalesce(F.nullif(i["label"], F.lit("")), i["type"], F.lit("")))
    title = lambda i: F.trim(F.coalesce(F.nullif(i["text"], F.lit("")), i["orig"], F.lit("")))
    found = F.filter(texts, lambda i: label(i).rlike("section|heading|title") & (title(i) != ""))
    return F.transform(found, lambda i: F.struct(title(i).alias("title"), F.when(i["level"].rlike(r"^\d+$"), i["level"]).cast("int").alias("level"), i["page"].alias("page"), item_box(i["bbox"]).alias("bbox")))


def provenance(texts: Column) -> Column:
    """Items, different pages and boxes of a document model's texts."""
    pages = F.array_distinct(F.filter(F.transform(texts, lambda i: i["page"]), lambda p: p.isNotNull()))
    return F.struct(F.size(texts).alias("items"), F.size(pages).alias("pages"), F.size(F.filter(texts, lambda i: item_box(i["bbox"]).isNotNull())).alias("boxes"))


def parallel_rows(boxes: Column, texts: Column, scores: Column) -> Column:
    """Boxes, texts and scores side by side, as many as texts; what lacks is null."""
    return F.transform(texts, lambda t, i: F.struct(F.get(boxes, i).alias("box"), t.alias("text"), F.get(scores, i).alias("score")))


def any_box(corners: Column, numbers: Column, points: Column) -> Column:
    """A box rounded to hundredths from named corners, four numbers or a polygon, whichever is there."""
    r = lambda x: F.round(x, 2)
    from_corners = F.when(corners["x1"].isNotNull() & corners["y1"].isNotNull() & corners["x2"].isNotNull() & corners["y2"].isNotNull(), F.array(*(r(corners[k]) for k in ("x1", "y1", "x2", "y2"))))
    n = lambda k: F.get(numbers, F.lit(k))
    from_numbers = F.when(F.size(numbers) == 4, F.array(r(F.least(n(0), n(2))), r(F.least(n(1), n(3))), r(F.greatest(n(0), n(2))), r(F.greatest(n(1), n(3)))))
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    from_points = F.when(F.size(points) > 0, F.array(r(F.array_min(xs)), r(F.array_min(ys)), r(F.array_max(xs)), r(F.array_max(ys))))
    return F.coalesce(from_corners, from_numbers, from_points)


def result_pages(rows: DataFrame, pages: str, key: str) -> DataFrame:
    """Pages (index, markdown, status) of a nested result as rows: page_number from 1, index, markdown, evidence."""
    each = rows.select(key, F.posexplode(pages).alias("n", "p"))
    return each.select(key, (F.col("n") + 1).alias("page_number"), F.coalesce("p.index", "n").alias("index"), F.coalesce("p.markdown", F.lit("")).alias("markdown"), F.coalesce(F.nullif("p.status", F.lit("")), F.lit("candidate")).alias("evidence"))


def paper(tei: Column) -> Column:
    """Title, authors, DOI, references and section heads of a TEI document without namespaces."""
    first = lambda path: F.nullif(collapse(F.xpath_string(tei, F.lit(path))), F.lit(""))
    plain = F.transform(F.xpath(tei, F.lit("//titleStmt/author/persName/surname/text()")), lambda x: strip(x))
    return F.struct(
        F.coalesce(first("//titleStmt/title"), first("//analytic/title"), F.lit("")).alias("title"),
        F.slice(F.array_distinct(F.filter(plain, lambda x: x != "")), 1, 20).alias("authors"),
        F.coalesce(first("//idno[@type='DOI']"), F.lit("")).alias("doi"),
        F.xpath_int(tei, F.lit("count(//listBibl/biblStruct)")).alias("references"),
        F.xpath(tei, F.lit("//body//head/text()")).alias("sections"),
    )


def paper_summary(title: Column, authors: Column, doi: Column, abstract: Column, sections: Column) -> Column:
    """What a paper's record holds, in numbers."""
    return F.struct(F.coalesce(title, F.lit("")).alias("title"), F.size(F.coalesce(authors, F.array().cast("array<string>"))).alias("author_count"), F.coalesce(doi, F.lit("")).alias("doi"), F.length(F.coalesce(abstract, F.lit(""))).alias("abstract_chars"), F.size(F.coalesce(sections, F.array().cast("array<string>"))).alias("section_count"), F.slice(sections, 1, 12).alias("sections_preview"))


def ncx_titles(raw: Column) -> Column:
    """Titles of an NCX contents list in order."""
    inner = F.regexp_extract_all(raw, F.lit(r"(?is)<navLabel\b[^>]*>.*?<text\b[^>]*>(.*?)</text>.*?</navLabel>"), 1)
    return F.filter(F.transform(inner, lambda x: strip(unescape(F.regexp_replace(x, r"(?s)<[^>]+>", "")))), lambda x: x != "")


def rear_notes(raw: Column) -> Column:
    """Notes at the end of an EPUB part: array of struct(number, body)."""
    pattern = r'(?is)<aside\b[^>]*id="footnote_(\d+)"[^>]*>.*?<p\b[^>]*>(.*?)</p>.*?</aside>'
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(pattern), 1).alias("number"), F.regexp_extract_all(raw, F.lit(pattern), 2).alias("body"))

    def body(x):
        out = F.regexp_replace(F.regexp_replace(x, r"(?i)<a\b[^>]*>\[\d+\]</a>", ""), r"(?i)<br\s*/?>", "\n")
        out = unescape(F.regexp_replace(out, r"(?s)</?[^>]+>", ""))
        return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{2,}", "\n"), r"[ \t]{2,}", " "))

    notes = F.transform(pairs, lambda p: F.struct(p["number"].cast("int").alias("number"), body(p["body"]).alias("body")))
    return F.filter(notes, lambda n: n["body"] != "")


def order_sources(markdown: Column) -> Column:
    """Sources in the order of a Markdown table that people edited."""
    rows = F.filter(F.transform(F.split(markdown, "\n"), strip), lambda x: x.startswith("|") & ~x.contains("Source") & ~x.rlike(r"^\|\s*-+"))
    cell = F.transform(rows, lambda x: strip(F.replace(F.coalesce(F.get(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"(?<!\\)\|"), F.lit(1)), F.lit("")), F.lit("\\|"), F.lit("|"))))
    return F.filter(cell, lambda c: c != "")


def form_feed_pages(text: Column) -> Column:
    """Pages between form feeds that are not blank, or the whole text."""
    pages = F.filter(F.transform(F.split(text, "\f"), strip), lambda p: p != "")
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(text))


def flat_outline(outline: Column, limit: int = 120) -> Column:
    """Titles and levels of an outline of two levels ([{title, items: [title]}]), in order."""
    each = F.transform(outline, lambda o: F.concat(F.array(F.struct(o["title"].alias("title"), F.lit(1).alias("level"))), F.transform(F.coalesce(o["items"], F.array().cast("array<string>")), lambda t: F.struct(t.alias("title"), F.lit(2).alias("level")))))
    return F.slice(F.flatten(each), 1, limit)


def line_items(blocks: Column) -> Column:
    """Lines (text, font size, font) of a page's blocks ([{type, lines: [{spans: [{text, size, font}]}]}])."""
    lines = F.flatten(F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: b["lines"]))
    spans = F.transform(lines, lambda line: F.filter(line["spans"], lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    found = F.transform(spans, lambda s: F.struct(collapse(F.array_join(F.transform(s, lambda x: x["text"]), "")).alias("text"), F.coalesce(F.array_max(F.transform(s, lambda x: x["size"])), F.lit(0.0)).alias("font_size"), F.coalesce(F.get(s, F.lit(0))["font"], F.lit("")).alias("font")))
    return F.filter(found, lambda x: x["text"] != "")


def page_refs(page: Column, fields: list[str]) -> Column:
    """Files that a page names, with their roles."""
    return named(*((F.concat(F.lit(f"{role}="), page[key]), F.coalesce(page[key], F.lit("")) != "") for key, role in PAGE_ROLES if key in fields))


def relationship_hints(kind: Column, reading_order: Column, source: Column) -> Column:
    return named(("reading_order", F.coalesce(reading_order, F.lit("")) != ""), ("table_structure", kind.isin("table", "table_cell")), ("formula_retention", kind == "formula"), ("source_ref", F.coalesce(source, F.lit("")) != ""))


def page_flags(page: Column) -> Column:
    """Flags of a page's diagnostics, joined."""
    return F.array_join(named(*((k, F.coalesce(page[k], F.lit(False))) for k in ("table_like", "image_heavy", "two_column_like", "header_footer_candidate"))), ",")


def source_kind(text: Column, schema: Column) -> Column:
    """Which normaliser takes a payload: a list holds OCR blocks, an object says its schema."""
    known = F.when(schema == "layout-candidates-v1", "layout_candidates").when(schema == "table-candidates-v1", "table_candidates").when(schema == "formula-candidates-v1", "formula_candidates").when(schema == "document-vlm-result-v1", "document_vlm_result").when(schema == "pdf-layout-evidence-v1", "pdf_layout_evidence")
    return F.when(F.ltrim(text).startswith("["), "ocr_blocks").otherwise(F.coalesce(known, F.nullif(schema, F.lit("")), F.lit("unknown")))


def artifact_errors(kind: Column, schema: Column, keys: Column, pages: Column) -> Column:
    """What is wrong with a candidate artifact: unknown kind, another schema, no backend or pages."""
    expected = F.lit(None).cast("string")
    for k, v in CANDIDATE_SCHEMAS.items():
        expected = F.when(kind == k, v).otherwise(expected)
    has = lambda k: F.array_contains(keys, k)
    wrong = named(("missing_schema_version", ~has("schema_version")), ("missing_backend", ~has("backend")), ("missing_pages", ~has("pages")), ("wrong_schema_version", F.coalesce(schema, F.lit("")) != expected), ("pages_must_be_a_list", has("pages") & pages.isNull()))
    return F.when(expected.isNull(), F.array(F.lit("unknown_schema"))).otherwise(wrong)


def batch_errors(schema: Column, keys: Column, contract_schema: Column, declared: Column) -> Column:
    """What is wrong with a batch: an unsupported schema, fields that lack, a contract of another version."""
    out = None
    for name, fields in BATCH_FIELDS.items():
        lacking = F.filter(F.array(*(F.lit(f) for f in fields)), lambda f: ~F.array_contains(keys, f))
        missing = F.when(F.size(lacking) > 0, F.concat(F.lit("missing:"), F.array_join(lacking, ",")))
        out = F.when(schema == name, missing) if out is None else out.when(schema == name, missing)
    unsupported = F.when(~F.coalesce(schema.isin(*BATCH_FIELDS), F.lit(False)), "unsupported_schema")
    return F.array_compact(F.array(unsupported, out, F.when(F.coalesce(contract_schema, F.lit("")) != "agent-batch-contract-v1", "contract_version"), F.when(~F.coalesce(declared == schema, F.lit(False)), "contract_payload")))


def order_confidence(page_number: Column, file_number: Column) -> Column:
    return F.when(page_number.isNotNull(), 0.9).when(file_number.isNotNull(), 0.65).otherwise(0.45)


def tie_breaker(confidence: Column, index: Column) -> Column:
    return confidence * 0.08 + F.greatest(F.lit(0.0), 0.04 - index * 0.001)


def _walk(value, path: str) -> Iterator[tuple[str, str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}.{k}", k, "" if v in (None, "", False, [], {}) else json.dumps(v, ensure_ascii=False)
            yield from _walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}[{i}]")


def json_fields(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, name, value of all fields of JSON texts at any depth; broken texts have none. An Arrow function, as JSON of any shape has no schema."""

    def of_batches(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(k, *f) for f in _walk(json.loads(t or ""), "$")]
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], [key, "path", "name", "value"])

    return rows.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(of_batches, f"`{key}` long, path string, name string, value string")
