"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are hashed words and word beginnings (A-Z lower-cased); a feature's value in a text is log(1 + its count). From
a bounded sample of labelled rows, class counts of the features are summed in Spark, the features most telling by
their log-odds z-score are kept, and one weight vector with ordered thresholds is fitted:
P(grade > j) = sigmoid(w.x - theta_j). Grade 0 is a row labelled clean; the grades of rows labelled toxic are the
ranges that TOXIC_CUTS cut from their number of telling toxic features. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no feature and so the severity of the intercept; every row returns one row,
repeated rows and null ids included; labels with a null id or class are ignored, of several labels of an id the most severe
counts, of several texts of a labelled id the model sees the smallest; without labels of both classes every severity is 0 and no row is toxic; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM_WORDS, BYTE_VALUES, prefix_sums, span_hashes, text_slices, words_of
from .shared import Scratch, map_arrow

FEATURE_BITS = 18
#: Bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Labelled rows that the model is fitted on, at most: of each class, those whose hashed id is smallest.
TOXIC_ROWS, CLEAN_ROWS = 6_000, 14_000
#: Features kept by their z-score, and the least z-score.
KEPT, LEAST_Z = 4096, 4.0
#: Shares of the toxic rows at which their grades part.
TOXIC_CUTS = (1 / 3, 2 / 3)
L2 = 2e-5
STEPS = 1000


@dataclass
class Model:
    index: np.ndarray  # feature -> position in weights, -1 if not kept
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, logit: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(logit[:, None] - self.thresholds, -40, 40)))


def features(column: pa.Array):
    """For slices of a text column: first row, end row, row of each occurrence, feature of each occurrence."""
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    for lo, hi, buf, off in text_slices(column):
        mapped, starts, ends, first = words_of(buf, off, ALNUM_WORDS)
        sums = prefix_sums(BYTE_VALUES[mapped])
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        rows, feats = [row], [span_hashes(sums, starts, ends) & mask]
        for size in BEGINNINGS:
            longer = ends - starts > size
            at = starts[longer]
            rows.append(row[longer])
            feats.append((span_hashes(sums, at, at + size) ^ np.uint64(0x5851F42D4C957F2D)) & mask)
        yield lo, hi, np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def counted(column: pa.Array, index: np.ndarray | None):
    """For slices: first row, end row, and row, feature, count of the kept features of each row."""
    for lo, hi, row, feat in features(column):
        if index is not None:
            at = index[feat]
            row, feat = row[at >= 0], at[at >= 0]
        pair, count = np.unique((row << FEATURE_BITS) | feat, return_counts=True)
        yield lo, hi, pair >> FEATURE_BITS, pair & ((1 << FEATURE_BITS) - 1), count


def fit(rows: np.ndarray, feats: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the cumulative-link likelihood of the grades, by full-batch Adam."""
    n, levels = len(grades), int(grades.max())
    w, theta0, gaps = np.zeros(width), 0.0, np.zeros(levels - 1)
    moments = [np.zeros(width + levels) for _ in range(2)]
    for step in range(1, steps + 1):
        theta = theta0 + np.r_[0.0, np.cumsum(np.exp(gaps))]
        f = np.bincount(rows, w[feats] * values, n)
        s = 1 / (1 + np.exp(-np.clip(f[:, None] - theta, -40, 40)))  # P(grade > j)
        wide = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(wide[at, grades] - wide[at, grades + 1], 1e-12)
        up, down = slope[at, grades] / p, slope[at, grades + 1] / p
        grad_f = -(up - down) / n
        grad_theta = np.zeros(levels + 2)
        np.add.at(grad_theta, grades, up / n)
        np.add.at(grad_theta, grades + 1, -down / n)
        grad_theta = grad_theta[1:-1]
        grad = np.r_[np.bincount(feats, grad_f[rows] * values, width) + l2 * w, grad_theta.sum(), [grad_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(levels - 1)]]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, theta0, gaps = w - move[:width], theta0 - move[width], gaps - move[width + 1 :]
    return w, theta0 + np.r_[0.0, np.cumsum(np.exp(gaps))]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """The model, or None without labelled rows of both classes."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(cond).orderBy(F.xxhash64("label_id"), "label_id").limit(rows) for cond, rows in (("toxic > 0", toxic_rows), ("toxic <= 0", clean_rows))]
    sample = F.broadcast(picked[0].union(picked[1]))  # toxic_rows + clean_rows rows at most
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("label_id"))
    # one row for each id, so that an id that is repeated does not outgrow the sample; null texts come last
    texts = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = scratch.write(texts.select("toxic", "text"), "sample")

    def class_counts(batch: pa.RecordBatch):
        toxic = np.asarray(batch.column(0)) > 0
        for lo, _, row, feat, _ in counted(batch.column(1), None):
            bad = toxic[lo + row]
            both = [np.bincount(feat[pick], minlength=1 << FEATURE_BITS) for pick in (bad, ~bad)]
            at = np.flatnonzero(both[0] + both[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], ["f", "bad", "good"])

    sizes = texts.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not sizes[0] or not sizes[1]:
        return None
    got = map_arrow(texts, class_counts, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    f, bad, good = (np.asarray(got.column(i)).astype(np.float64) for i in range(3))
    odds = np.log((bad + 0.5) / (sizes[0] - bad + 0.5)) - np.log((good + 0.5) / (sizes[1] - good + 0.5))
    z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    order = np.lexsort((f, -np.abs(z)))
    order = order[np.abs(z[order]) >= LEAST_Z][:KEPT]
    if not len(order):
        return None
    index = np.full(1 << FEATURE_BITS, -1, np.int32)
    index[f[order].astype(np.int64)] = np.arange(len(order))
    telling = (z[order] > 0) & (odds[order] > 2)

    def kept(batch: pa.RecordBatch):
        for lo, hi, row, feat, count in counted(batch.column(1), index):
            per = np.bincount(row, minlength=hi - lo)
            offsets = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (feat, count))], ["toxic", "f", "c"])

    got = map_arrow(texts, kept, "toxic int, f array<int>, c array<int>").toArrow().combine_chunks()  # as many rows as the sample
    toxic = np.asarray(got.column("toxic")) > 0
    lists = got.column("f").combine_chunks()
    per = np.diff(np.asarray(lists.offsets))
    rows = np.repeat(np.arange(len(toxic)), per)
    feats, counts = np.asarray(lists.flatten()), np.asarray(got.column("c").combine_chunks().flatten())
    marks = np.bincount(rows, counts * telling[feats], len(toxic))
    cuts = np.quantile(marks[toxic], TOXIC_CUTS)
    grades = np.where(toxic, 1 + np.searchsorted(cuts, marks, "right"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # no grade without a row
    w, theta = fit(rows, feats, np.log1p(counts), grades, len(order))
    return Model(index, w, theta)


def _exceeding(model: Model, texts: pa.Array) -> np.ndarray:
    logits = [np.bincount(row, model.weights[feat] * np.log1p(count), hi - lo) for lo, hi, row, feat, count in counted(texts, model.index)]
    return model.exceed(np.concatenate(logits))


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (thresholds likelier exceeded than not), p_toxic, toxic (p_toxic of a half or more) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("toxic"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**FEATURE_BITS + KEPT numbers

    def of_batch(batch: pa.RecordBatch):
        over = _exceeding(held.value, batch.column(1))
        more = [pa.array(over.sum(axis=1)), pa.array((over >= 0.5).sum(axis=1).astype(np.int32)), pa.array(over[:, 0]), pa.array((over[:, 0] >= 0.5).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *more], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return map_arrow(rows, of_batch, "doc_id long, severity double, grade int, p_toxic double, toxic int")


def clean(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs without the rows that score() calls toxic."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def of_batch(batch: pa.RecordBatch):
        yield batch.filter(pa.array(_exceeding(held.value, batch.column(at))[:, 0] < 0.5))

    return map_arrow(docs, of_batch, docs.schema)
