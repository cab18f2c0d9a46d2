"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import COVERAGE, GRAM, SLACK, TEMPLATES, WIDTH
from .substring_dedup import WINDOW


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    rows = []
    for name, label, base, text in TEMPLATES:
        words = text.split()
        n = len(words) - GRAM + 1
        rows += [f"({_quoted(name)}, {_quoted(label)}, {str(base).lower()}, {n}, {t}, {_quoted(' '.join(words[t : t + GRAM]))})" for t in range(n)]
    gram = " || ' ' || ".join(f"w[p + {k + 1}]" for k in range(GRAM))
    return rf"""WITH library(name, label, base, n, t, g) AS (VALUES {", ".join(rows)}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w) - {GRAM - 1})) AS p FROM texts),
hits AS (SELECT doc_id, name, label, base, n, t, p - t AS diagonal FROM (SELECT doc_id, p, {gram} AS g FROM places) JOIN library USING (g)),
marks AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER w > {SLACK}, true) THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc_id, name, base, diagonal FROM hits) WINDOW w AS (PARTITION BY doc_id, name ORDER BY diagonal)),
runs AS (SELECT doc_id, name, diagonal, sum(new) OVER (PARTITION BY doc_id, name ORDER BY diagonal) AS span FROM marks),
placed AS (SELECT h.*, diagonal + t AS p, span, count(*) OVER (PARTITION BY doc_id, name, diagonal) = n AS whole FROM hits h JOIN runs USING (doc_id, name, diagonal)),
-- a hit counts if no hit before it (or, read backwards, after it) has as far a template position
counted AS (SELECT a.doc_id, a.name, a.label, a.base, a.n, a.span, a.p, a.whole,
  NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = a.doc_id AND b.name = a.name AND b.span = a.span AND b.t >= a.t AND (b.p < a.p OR (b.p = a.p AND b.t > a.t))) AS l,
  NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = a.doc_id AND b.name = a.name AND b.span = a.span AND b.t <= a.t AND (b.p > a.p OR (b.p = a.p AND b.t < a.t))) AS r FROM placed a),
spans AS (SELECT doc_id, name, label, base, n, span, bool_or(whole) AS whole, count(*) FILTER (l) AS ls, count(*) FILTER (r) AS rs,
  CASE WHEN count(*) FILTER (l) >= count(*) FILTER (r) THEN min(p) FILTER (l) ELSE min(p) FILTER (r) END AS first_word,
  CASE WHEN count(*) FILTER (l) >= count(*) FILTER (r) THEN max(p) FILTER (l) ELSE max(p) FILTER (r) END + {GRAM} AS end_word FROM counted GROUP BY ALL),
judged AS (SELECT *, CASE WHEN end_word - first_word <= (n + {GRAM - 1}) * {WIDTH} THEN greatest(ls, rs)::DOUBLE / n::DOUBLE ELSE 0 END AS coverage FROM spans),
found AS (SELECT doc_id, count(*) FILTER (base AND whole) AS n_base, min(first_word) FILTER (base AND whole) AS first_word, max(first_word) FILTER (base AND whole) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base AND whole))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (CASE WHEN base THEN whole ELSE coverage >= {COVERAGE} END))), ',') AS labels, max(coverage) AS score FROM judged GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id"""


def substring_dedup() -> str:
    return rf"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
bad AS (SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (win) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM texts),
marked AS (SELECT x.doc_id, x.j, x.word, max(b.i) OVER (PARTITION BY x.doc_id ORDER BY x.j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words x LEFT JOIN bad b ON b.doc_id = x.doc_id AND b.i = x.j),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""
