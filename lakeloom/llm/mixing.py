"""Soft-membership mixing of sources to target weights, in DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on a bounded sample of labelled rows, gives each document posteriors over
the domains of the label table. Nonnegative document rates r are then fitted so that the expected domain totals
S_k = sum r * tokens * p_k meet the targets T_k: projected-gradient least squares, in which each round sums S and the
domains' token moments in one distributed aggregation, the small system of the residual is solved, and every rate moves
along p by the solution and is cut off at zero. A rate is thus a function of its own row and the few residuals so far, and no
rate is ever collected. All sums are over all documents.

Evidence is tempered: with n words the summed log-likelihoods are scaled by EVIDENCE / (EVIDENCE + n), so long texts do not
get posteriors of 0 and 1. Targets that no mixture can reach are met as closely as the rounds get.

Defined results: null and empty texts have no tokens, the prior as posteriors, and the starting rate 1 cut like others; every
row returns one row, whatever its id; labels with a null in id or class are ignored, of several labels of an id the
largest class counts; without labels the posteriors are equal; without tokens all rates stay 1; other columns are kept, but a
column of docs named n_tokens, p or rate gives way to the result's; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Domains of the label table, with the share of the token budget each is to have.
DOMAINS = ("plain", "good", "toxic")
TARGETS = {"plain": 0.30, "good": 0.69, "toxic": 0.01}
BUCKETS = 4096
#: Labelled rows that the classifier is fitted on, at most: those whose hashed id is smallest.
SAMPLE = 20_000
EVIDENCE = 200.0
ROUNDS = 25
#: Residual, as a share of all tokens, at which the rounds end.
CLOSE = 1e-7


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def domain(quality: Column, toxic: Column) -> Column:
    """Number of a label's domain."""
    return F.when(toxic > 0, 2).when(quality > 0, 1).otherwise(0)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Log priors and, for each domain, the log-likelihoods of the buckets: len(DOMAINS) * BUCKETS numbers at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), domain(F.col("quality"), F.col("toxic")).alias("k"), "quality", "toxic").dropna()
    known = known.groupBy("label_id").agg(F.max("k").alias("k")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    counts = texts.select("k", F.explode(buckets(F.col("text"))).alias("b")).groupBy("b").agg(*(F.count_if(F.col("k") == k).alias(f"c{k}") for k in range(len(DOMAINS)))).collect()
    rows = {r["k"]: r["count"] for r in texts.groupBy("k").count().collect()}
    total = sum(rows.values())
    prior = [math.log((rows.get(k, 0) + 1) / (total + len(DOMAINS))) for k in range(len(DOMAINS))]
    likely = []
    for k in range(len(DOMAINS)):
        c = np.full(BUCKETS, 0.5)
        for r in counts:
            c[r["b"]] += r[f"c{k}"]
        likely.append(np.log(c / c.sum()).round(6).tolist())
    if not total:
        prior = [-math.log(len(DOMAINS))] * len(DOMAINS)
    return prior, likely


def _summed(spots: Column, table: Column) -> Column:
    return F.aggregate(spots, F.lit(0.0), lambda s, b: s + F.get(table, b))


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], text_col: str = "text") -> DataFrame:
    """docs with n_tokens and p (array of posteriors); no shuffle."""
    prior, likely = model
    table = lambda k: F.expr("array(" + ",".join(f"{x!r}D" for x in likely[k]) + ")")
    spots, sums, parts = "__loom_spots", "__loom_sums", "__loom_parts"
    rows = docs.drop("n_tokens", "p", "rate").withColumn(spots, buckets(F.col(text_col)))
    n = F.size(spots).cast("long")
    each = [F.lit(prior[k]) + _summed(F.col(spots), table(k)) * (EVIDENCE / (EVIDENCE + n)) for k in range(len(DOMAINS))]
    rows = rows.withColumns({"n_tokens": n, sums: F.array(*each)})
    rows = rows.withColumn(parts, F.transform(sums, lambda x: F.exp(x - F.array_max(sums))))
    whole = sum((F.get(parts, F.lit(k)) for k in range(1, len(DOMAINS))), F.get(parts, F.lit(0)))
    rows = rows.withColumn("p", F.transform(parts, lambda x: x / whole))
    return rows.drop(spots, sums, parts)


def rate(moves: list[list[float]]) -> Column:
    """The rate of a row after the moves so far, from its posteriors p."""
    r = F.lit(1.0)
    for c in moves:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(x) * F.get("p", F.lit(k)) for k, x in enumerate(c)), F.lit(0.0)))
    return r


def fit_rates(rows: DataFrame, targets: dict[str, float], rounds: int = ROUNDS) -> list[list[float]]:
    """The moves of the projected-gradient rounds over rows (n_tokens, p)."""
    size = len(DOMAINS)
    n, p = F.col("n_tokens"), lambda k: F.get("p", F.lit(k))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return []
    want = np.array([targets.get(d, 0.0) for d in DOMAINS])
    want = want / want.sum()
    moves: list[list[float]] = []
    best, best_moves = math.inf, 0
    for _ in range(rounds):
        now = rows.withColumn("r", rate(moves))
        live = F.when(F.col("r") > 0, 1.0).otherwise(0.0)
        sums = [F.sum(F.col("r") * n * p(k)) for k in range(size)]
        pairs = [F.sum(live * n * p(i) * p(j)) for i in range(size) for j in range(i + 1)]
        got = now.agg(*(c.alias(f"x{i}") for i, c in enumerate(sums + pairs))).first()
        residual = np.array(got[:size]) / total - want
        off = float(np.abs(residual).sum())
        if off < best:
            best, best_moves = off, len(moves)
        if off < CLOSE:
            break
        moment = np.zeros((size, size))
        for (i, j), x in zip(((i, j) for i in range(size) for j in range(i + 1)), got[size:], strict=True):
            moment[i, j] = moment[j, i] = x / total
        moves.append(np.linalg.solve(moment + 1e-9 * np.eye(size), residual).tolist())
    return moves[:best_moves]


def mix(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those of `keep`) with n_tokens, p (posteriors in the order of DOMAINS) and rate."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "p", "rate")]
    # written once, so that the texts are cut into words once
    rows = scratch.write(posteriors(docs, model, text_col).select(*kept, "n_tokens", "p"), "posteriors", "snappy")
    return rows.withColumn("rate", rate(fit_rates(rows, targets or TARGETS, rounds)))
