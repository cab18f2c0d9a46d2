"""Full-text search over a page table: an inverted index (postings), BM25, containment tiers and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TOKEN = r"(?U)[^\w]+|_"


def tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    """Different lower-cased terms of a query in their order."""
    return list(dict.fromkeys(t.lower() for t in re.split(r"[^\w]+|_", query) if t))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, id, tf, length of each text's terms: the index, to be written partitioned by a hash of the term."""
    words = docs.select(id_col, tokens(text_col).alias("w")).withColumn("length", F.size("w"))
    return words.select(id_col, "length", F.explode("w").alias("term")).groupBy("term", id_col, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hits (different terms), score. Only the query's terms are counted, in rows, so no index is exploded."""
    terms = query_terms(query)
    rows = docs.select(id_col, tokens(text_col).alias("w")).withColumn("length", F.size("w"))
    counts = [F.size(F.filter("w", _equals(t))).alias(f"_t{i}") for i, t in enumerate(terms)]
    rows = rows.select(id_col, "length", *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    rows = rows.filter(" or ".join(f"_t{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = sum(((F.col(f"_t{i}") > 0).cast("int") for i in range(len(terms))), F.lit(0))
    return rows.select(id_col, hits.alias("hits"), score.alias("score"))


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16) -> None:
    """Writes the index of a table in a folder: postings by a hash of the term, in the terms' order, and the corpus numbers.

    A query then reads the buckets of its terms only, whatever the corpus holds, and never the texts.
    """
    index = postings(docs, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    index.repartition("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    lengths = docs.select(F.size(tokens(text_col)).alias("length"))
    lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/numbers")


def bm25_of_index(spark: SparkSession, folder: str, query: str, id_col: str = "doc_id") -> DataFrame:
    """id, hits, score of the texts that hold a term of the query, from an index."""
    terms = query_terms(query)
    numbers = spark.read.parquet(f"{folder}/numbers")
    buckets = numbers.first()["buckets"]
    wanted = spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in terms))).alias("term")) if terms else spark.range(0).select(F.lit("").alias("term"))
    at = [r.b for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # one for each term
    found = spark.read.parquet(f"{folder}/postings").filter(F.col("bucket").isin(at) & F.col("term").isin(terms))
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term
    rows = found.join(F.broadcast(frequency), "term").join(F.broadcast(numbers))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy(id_col).agg(F.count("*").cast("int").alias("hits"), F.sum(part).alias("score"))


def _equals(term: str):
    return lambda x: x == term


def match_quality(text: Column, query: str) -> Column:
    """exact, all_terms, partial_terms or unknown."""
    low, terms = F.lower(text), query_terms(query)
    hits = token_hits(text, query)
    return F.when(low.contains(query.strip().lower()), "exact").when(hits == len(terms), "all_terms").when(hits > 0, "partial_terms").otherwise("unknown")


def token_hits(text: Column, query: str) -> Column:
    low = F.lower(text)
    return sum((low.contains(t).cast("int") for t in query_terms(query)), F.lit(0))


def like(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    return docs.filter(F.lower(text_col).contains(query.strip().lower()))


def all_terms(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    out = docs
    for t in query_terms(query):
        out = out.filter(F.lower(text_col).contains(t))
    return out


def cascade(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """The rows of the strictest tier that finds any: the phrase, all terms, any term; tier 1, 2 or 3. A blank query finds nothing."""
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("tier", F.lit(0)).filter(F.lit(False))
    low = F.lower(text_col)
    every, some = F.lit(True), F.lit(False)
    for t in terms:
        every, some = every & low.contains(t), some | low.contains(t)
    rows = docs.withColumn("tier", F.when(low.contains(query.strip().lower()), 1).when(every, 2).when(some, 3)).filter("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("_best"))), F.col("tier") == F.col("_best")).drop("_best")


def snippet(text: Column, query: str, before: int = 48, after: int = 96) -> Column:
    """The surroundings of the first hit with the hit in brackets, or the beginning of the text."""
    size = len(query)
    at = F.greatest(F.locate(query.lower(), F.lower(text)) - 1, F.lit(0))
    start = F.greatest(at - before, F.lit(0))
    end = F.least(F.length(text), at + size + after)
    cut = F.substring(text, start + 1, end - start)
    hit = F.locate(query.lower(), F.lower(cut))
    marked = F.when(hit > 0, F.concat(F.substring(cut, F.lit(1), hit - 1), F.lit("["), F.substring(cut, hit, F.lit(size)), F.lit("]"), F.substring(cut, hit + size, F.length(cut)))).otherwise(cut)
    return F.concat(F.when(start > 0, "...").otherwise(""), marked, F.when(end < F.length(text), "...").otherwise(""))
