"""Queries over pages, conversations, events, embeddings and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import bigram_coverage, compact, normal_text, slug
from ..operators import chat, compare, events, pages, vectors, web
from ..operators.structure import line_table
from .quality import LINES, _scored
from .quality import COUNTERS as QUALITY
from .registry import query, table

_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'))".replace('\\"', '"')


@query(r"SELECT page_id, " + _PLAIN.format(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)") + " AS title FROM pages")
def page_titles(spark, folder):
    return table(spark, folder, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query(
    r"WITH h AS (SELECT page_id, unnest(hs) AS raw, generate_subscripts(hs, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') AS hs FROM pages)) SELECT page_id, n::INT AS n, regexp_extract(raw, '(?i)^<h([1-6])', 1)::INT AS level, "
    + _PLAIN.format("raw")
    + " AS title FROM h"
)
def page_headings(spark, folder):
    return web.headings(table(spark, folder, "pages"))


@query(
    r"""WITH a AS (SELECT page_id, string_split(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', '', 'gsi'), '<style\b.*?</style\s*>', '', 'gsi'), '<br\s*/?>|</(?:p|div|h[1-6]|li|tr)\s*>', chr(10), 'gi'), '<[^>]*>', '', 'gs'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), chr(10)) AS ls FROM pages)
SELECT page_id, md5(array_to_string(list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), chr(10))) AS text_md5 FROM a"""
)
def page_visible_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(web.visible_text(F.col("html"))).alias("text_md5"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["''][^"'']*["''][^>]*>.*?</a>')) AS raw FROM pages) SELECT page_id, count(*) AS links FROM l GROUP BY page_id""")
def page_links(spark, folder):
    return web.links(table(spark, folder, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def url_parts(spark, folder):
    return table(spark, folder, "pages").select("page_id", web.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def pages_by_host(spark, folder):
    return table(spark, folder, "pages").groupBy(web.url_parts(F.col("url"))["host"].alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


# --- duplicates -------------------------------------------------------------------------------------------------------


@query(r"SELECT md5(lower(regexp_replace(text, '[\s\p{Z}]+', '', 'g'))) AS key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, folder):
    key = F.md5(F.lower(compact("text")))
    return table(spark, folder, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(r"SELECT arg_min(doc_id, [-n_chars, doc_id]) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(lower(regexp_replace(text, '[\s\p{Z}]+', '', 'g')))")
def duplicate_representatives(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.groupBy(F.md5(F.lower(compact("text")))).agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_PAIRS = r"CASE WHEN length({0}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substring({0}, i, 2))) END"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '[\s\p{{Z}}]+', '', 'g')) AS a, lower(regexp_replace(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '[\s\p{{Z}}]+', '', 'g')) AS b FROM conversations),
g AS (SELECT conv_id, turn, {_PAIRS.format("a")} AS x, {_PAIRS.format("b")} AS y FROM t)
SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN round(len(list_intersect(x, y))::DOUBLE / len(x), 6) WHEN len(y) > 0 THEN 1.0 ELSE 0.0 END AS coverage FROM g"""
)
def bigram_coverage_of_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return turns.withColumn("before", before).select("conv_id", "turn", F.round(bigram_coverage("text", "before"), 6).alias("coverage"))


@query(r"WITH n AS (SELECT doc_id, source, lower(source) AS k FROM documents) SELECT doc_id, CASE WHEN r = 1 THEN source ELSE source || '-' || r END AS output FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM n)")
def disambiguated_names(spark, folder):
    return compare.disambiguated(table(spark, folder, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "output")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def stratified_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source").withColumn("cat", F.concat_ws("/", "lang", "source"))
    return compare.stratified(docs, "cat", "doc_id", 3).drop("cat")


# --- titles and layout ------------------------------------------------------------------------------------------------

_SCORE = r"""CASE WHEN regexp_matches(t, '(?i)^(?:第[一二三四五六七八九十百千万\d]+[章节篇部卷]|Chapter\s+\d+|Part\s+\w+)\b') OR regexp_matches(t, '^\d+(?:\.\d+){0,3}[\s、.．]+') OR (b AND length(t) BETWEEN 2 AND 28 AND NOT regexp_matches(t, '[。！？.!?，,；;：:]$')) THEN 0.55 ELSE 0 END
 + CASE WHEN pos <= 6 THEN 0.12 ELSE 0 END + CASE WHEN b THEN 0.08 ELSE 0 END + CASE WHEN a THEN 0.08 ELSE 0 END + CASE WHEN length(t) BETWEEN 2 AND 32 AND NOT regexp_matches(t, '[。！？.!?，,；;：:]$') THEN 0.18 ELSE 0 END
 + CASE WHEN regexp_matches(t, '(?i)^(?:序|前言|目录|后记|附录|致谢|引言|绪论)$') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)^(?:chapter|section|part)\b') THEN 0.18 ELSE 0 END + CASE WHEN regexp_matches(t, '^\d+(?:\.\d+){0,3}\s+.+') THEN 0.20 ELSE 0 END
 - CASE WHEN regexp_matches(t, '^[\-•·*]\s+') THEN 0.35 ELSE 0 END - CASE WHEN length(t) > 48 THEN 0.30 ELSE 0 END - CASE WHEN regexp_matches(t, '[。！？.!?]$') THEN 0.25 ELSE 0 END"""


@query(
    "WITH"
    + LINES
    + f""", n AS (SELECT doc_id, pos, t, coalesce(lag(t) OVER w, '') = '' AS b, coalesce(lead(t) OVER w, '') = '' AS a FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, pos, t, greatest(0, least(1, ({_SCORE})::DECIMAL(6,2)))::DOUBLE AS confidence FROM n WHERE t <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pos) AS rank FROM s WHERE confidence >= 0.42) SELECT doc_id, rank::INT AS rank, t AS title, round(confidence, 3) AS confidence FROM r WHERE rank <= 6"""
)
def title_candidates(spark, folder):
    return pages.title_candidates(line_table(table(spark, folder, "documents")), "doc_id")


# --- conversations ----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS turns, string_agg('**' || role || ':** ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def chat_transcript(spark, folder):
    return chat.transcript(table(spark, folder, "conversations"))


@query(
    """WITH n AS (SELECT *, coalesce((lag(role) OVER w <> role)::INT, 1) AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, first(role) AS role, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run"""
)
def chat_merge_turns(spark, folder):
    return chat.merge_turns(table(spark, folder, "conversations"))


@query("SELECT conv_id, turn, 'msg-' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR, 6, '0') AS message_id FROM conversations")
def chat_message_ids(spark, folder):
    return chat.renumbered(table(spark, folder, "conversations")).select("conv_id", "turn", "message_id")


@query(r"SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, avg(length(text)) AS mean_chars, max(length(text)) AS longest FROM conversations GROUP BY role")
def chat_role_stats(spark, folder):
    return table(spark, folder, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean_chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query(r"SELECT lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}]+', '', 'g')) AS key, count(*) AS times FROM conversations GROUP BY 1 HAVING count(*) > 1")
def chat_repeated_messages(spark, folder):
    return table(spark, folder, "conversations").groupBy(normal_text("text").alias("key")).agg(F.count("*").alias("times")).filter("times > 1")


# --- events -----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS events, arg_max(event_type, [epoch_us(ts), event_id]) AS status, epoch_us(max(ts)) AS updated_us, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def event_job_state(spark, folder):
    rows = events.job_state(table(spark, folder, "events"))
    return rows.select("user_id", "events", "status", F.unix_micros(F.col("updated").cast("timestamp")).alias("updated_us"), F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, age::INT AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 5")
def event_last_n(spark, folder):
    return events.last_n(table(spark, folder, "events"), 5).select("user_id", "event_id", "age")


@query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS status, count(*) AS events FROM events GROUP BY 1")
def event_status_counts(spark, folder):
    from ..functions.text import or_unknown

    return table(spark, folder, "events").groupBy(or_unknown("event_type").alias("status")).agg(F.count("*").alias("events"))


@query("SELECT user_id, count(*) AS total, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*), 3) AS purchase_rate, round(count(*) FILTER (event_type = 'click')::DOUBLE / count(*), 3) AS click_rate, max(value) AS most FROM events GROUP BY user_id")
def event_rates(spark, folder):
    return events.rates(table(spark, folder, "events")).drop("mean_value")


@query(
    """WITH p AS (SELECT *, coalesce((date_diff('second', lag(ts) OVER w, ts) > 86400)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM p)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM s GROUP BY user_id, n"""
)
def event_sessions(spark, folder):
    rows = events.sessions(table(spark, folder, "events"), 86_400)
    return rows.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "events")


@query("SELECT event_type, (props::JSON->>'$.k')::BIGINT AS k, count(*) AS events FROM events GROUP BY ALL")
def event_props_json(spark, folder):
    return events.properties(table(spark, folder, "events")).groupBy("event_type", "k").agg(F.count("*").alias("events"))


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS events, max(value) AS most FROM events GROUP BY ROLLUP (event_type, date_trunc('day', ts)::DATE)")
def provider_metrics_rollup(spark, folder):
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return rows.rollup("event_type", "day").agg(F.count("*").alias("events"), F.max("value").alias("most"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.event_id)")
def resume_antijoin(spark, folder):
    done = table(spark, folder, "documents").select(F.col("doc_id").alias("event_id"))
    return table(spark, folder, "events").select("event_id").join(done, "event_id", "left_anti")


@query("WITH f AS (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, [epoch_us(ts), event_id]) = 'error') SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM f)")
def select_failed_jobs(spark, folder):
    rows = table(spark, folder, "events")
    failed = events.job_state(rows).filter("status = 'error'").select("user_id")
    return rows.join(failed, "user_id", "left_semi").select("event_id", "user_id")


# --- embeddings -------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * q.e[i]::DOUBLE))"


@query(
    f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, {_DOT} AS d, sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings a, q WHERE vec_id <> 7)
SELECT vec_id, round(d / n, 6) AS similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 10"""
)
def embedding_topk(spark, folder):
    return vectors.nearest(table(spark, folder, "embeddings"), 7, 10)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, label FROM embeddings")
def embedding_norms(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), "label")


# --- comparisons ------------------------------------------------------------------------------------------------------


@query(
    QUALITY
    + """, r AS (SELECT d.source, d.doc_id, q.score::DOUBLE AS score, row_number() OVER w AS rank, lead(q.score::DOUBLE) OVER w AS runner_up FROM documents d JOIN q ON q.doc_id = d.doc_id WINDOW w AS (PARTITION BY d.source ORDER BY q.score DESC, d.doc_id))
SELECT source, doc_id AS pipeline, score, runner_up, round(score - runner_up, 3) AS margin, score >= 60 AND coalesce(round(score - runner_up, 3) >= 3, true) AS auto_accept,
 CASE WHEN NOT (score >= 60 AND coalesce(round(score - runner_up, 3) >= 3, true)) THEN 'low' WHEN coalesce(round(score - runner_up, 3) >= 8, true) THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE rank = 1"""
)
def winner_per_source(spark, folder):
    rows = _scored(spark, folder).select("source", F.col("doc_id").alias("pipeline"), F.col("score").cast("double").alias("score"))
    return compare.winner(rows, "source", minimum=60, order=[F.col("pipeline")])


@query(
    QUALITY
    + """, s AS (SELECT CASE WHEN characters = 0 THEN 'failed' ELSE 'ok' END AS status, level FROM q), m AS (SELECT round(count(*) FILTER (status = 'ok')::DOUBLE / count(*), 3) AS success_rate, round(count(*) FILTER (level = 'good')::DOUBLE / count(level), 3) AS good_rate, round(count(*) FILTER (level IN ('review', 'poor'))::DOUBLE / count(level), 3) AS review_poor_rate FROM s)
SELECT 'success_rate' AS name, success_rate AS actual, 0.95::DOUBLE AS threshold, success_rate >= 0.95 AS passed FROM m UNION ALL SELECT 'good_rate', good_rate, 0.5::DOUBLE, good_rate >= 0.5 FROM m UNION ALL SELECT 'review_poor_rate', review_poor_rate, 0.9::DOUBLE, review_poor_rate <= 0.9 FROM m"""
)
def quality_gates(spark, folder):
    rows = _scored(spark, folder).select(F.when(F.col("characters") == 0, "failed").otherwise("ok").alias("status"), "level")
    return compare.gates(rows, {"success_rate": 0.95, "good_rate": 0.5}, {"review_poor_rate": 0.9})


@query(
    """WITH j AS (SELECT coalesce(c_custkey, s_suppkey) AS id, c_custkey IS NULL AS new, s_suppkey IS NULL AS gone, c_nationkey::VARCHAR AS an, s_nationkey::VARCHAR AS bn, c_name AS ac, s_name AS bc FROM customer FULL JOIN supplier ON c_custkey = s_suppkey)
SELECT id, 'record' AS field, an AS before, bn AS after, CASE WHEN gone THEN 'error' ELSE 'warning' END AS severity FROM j WHERE new OR gone UNION ALL SELECT id, 'nation', an, bn, 'info' FROM j WHERE NOT new AND NOT gone AND an <> bn UNION ALL SELECT id, 'version', ac, bc, 'warning' FROM j WHERE NOT new AND NOT gone AND ac <> bc"""
)
def lock_diff(spark, folder):
    before = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("version"))
    after = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("version"))
    return compare.record_diff(before, after, "id", ["nation", "version"])


@query(
    QUALITY
    + """, m AS (SELECT d.lang, q.* FROM q JOIN documents d ON d.doc_id = q.doc_id), b AS (SELECT avg(headings) AS h, avg(characters) AS c, avg(table_like_lines) AS t FROM m WHERE lang = 'en'), a AS (SELECT avg(headings) AS h, avg(characters) AS c, avg(table_like_lines) AS t FROM m WHERE lang = 'de')
SELECT 'avg_headings' AS name, b.h AS baseline, a.h AS candidate, round(a.h - b.h, 3) AS delta FROM a, b UNION ALL SELECT 'avg_characters', b.c, a.c, round(a.c - b.c, 3) FROM a, b UNION ALL SELECT 'table_like_lines', b.t, a.t, round(a.t - b.t, 3) FROM a, b"""
)
def regression_deltas(spark, folder):
    rows = _scored(spark, folder)
    one = lambda lang: rows.filter(F.col("lang") == lang).agg(F.avg("headings").alias("avg_headings"), F.avg("characters").alias("avg_characters"), F.avg("table_like_lines").alias("table_like_lines")).unpivot([], ["avg_headings", "avg_characters", "table_like_lines"], "name", "value")
    return compare.deltas(one("en"), one("de"))


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS present, array_to_string(list_sort(list_filter(['de','en','es','fr','zh'], lambda x: NOT list_contains(list(lang), x))), ',') AS missing FROM documents GROUP BY source")
def artifact_coverage(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    rows = compare.coverage(rows, F.array(*(F.lit(x) for x in ("de", "en", "es", "fr", "zh"))), F.col("langs"))
    return rows.select("source", F.array_join("langs", ",").alias("present"), F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'sample' ELSE s END AS slug FROM (SELECT doc_id, substring(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^\p{L}\p{N}_.-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 80) AS s FROM documents)")
def safe_ids(spark, folder):
    return table(spark, folder, "documents").select("doc_id", slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query(
    QUALITY
    + """, f AS (SELECT d.source, d.lang, q.level, q.score, CASE q.level WHEN 'good' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS rank, d.doc_id FROM q JOIN documents d ON d.doc_id = q.doc_id)
SELECT lang, count(*) AS documents, count(*) FILTER (level = 'good') AS good, count(*) FILTER (level = 'review') AS review, count(*) FILTER (level = 'poor') AS poor, arg_min(doc_id, [rank, -score, doc_id]) AS best FROM f GROUP BY lang"""
)
def format_baseline_matrix(spark, folder):
    rank = F.when(F.col("level") == "good", 0).when(F.col("level") == "review", 1).otherwise(2)
    rows = _scored(spark, folder)
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), *(F.count_if(F.col("level") == x).alias(x) for x in ("good", "review", "poor")), F.min_by("doc_id", F.struct(rank, -F.col("score"), "doc_id")).alias("best"))


@query(
    """SELECT user_id, coalesce(max(CASE WHEN event_id % 5 > 0 THEN event_id % 40 END), 0) AS completed, arg_max(30 + user_id % 12, event_id) FILTER (event_id % 3 = 0) AS total, count(*) AS events,
 coalesce(coalesce(max(CASE WHEN event_id % 5 > 0 THEN event_id % 40 END), 0) >= arg_max(30 + user_id % 12, event_id) FILTER (event_id % 3 = 0), false) AS complete FROM events GROUP BY user_id"""
)
def job_progress(spark, folder):
    """How far jobs have come."""
    i = F.col("event_id")
    rows = table(spark, folder, "events").select("user_id", "event_id", F.when(i % 5 > 0, i % 40).alias("index"), F.when(i % 3 == 0, 30 + F.col("user_id") % 12).alias("total"))
    return events.progress(rows, "user_id")
