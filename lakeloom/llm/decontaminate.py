"""Benchmark decontamination: n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

Word n-grams of the test items are seeds. Documents are scanned once; a fixed-size bit filter of the seeds picks the places
worth sending on, and the words around them go along as passages, so no text is shuffled. An equi-join with the seeds names the items.
Every seed counts, however many documents it stands in: an edited leak may have kept none but common ones. What spreads is bounded
by collapsing instead: passages of the same words are one, aligned once with each item and scored for all their documents.
Each (passage, item) found is aligned over words with match +2, mismatch and gap -1; the score is the best local alignment over
that of a verbatim copy, so edits lower it gradually.

Defined results: null and empty texts match nothing; items of fewer words than a seed have none and match nothing; items with
a null id are left out, those that repeat an id count as that id's variants; rows that repeat id and text share their
matches; every row returns one row; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM_WORDS, as_signed, gram_starts, list_array, rolling_hashes, text_slices, word_hashes, words_of
from .repeats import digest, prepared
from .shared import NO_ID, Scratch, key_filter, load_filter, map_arrow, passes, without

SEED_WORDS = 4
#: Alignment score from which a document counts as holding the item.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of a row of alignments that are made at once.
CELLS = 1 << 16
#: Seeds up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST_SEEDS = 500_000


def alignments(item: np.ndarray, passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of a sequence of word hashes with each of several, row by row of all of them."""
    sizes = np.array([len(p) for p in passages], np.int64)
    out, order = np.zeros(len(passages), np.int64), np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        # passages of rising length fill CELLS, one at least
        ahead = sizes[order[lo:]]
        take = order[lo : lo + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), CELLS, "right")))]
        lo += len(take)
        n = int(sizes[take].max())
        words, inside = np.zeros((len(take), n), item.dtype), np.arange(n) < sizes[take][:, None]
        words[inside] = np.concatenate([passages[i] for i in take])
        down = np.arange(n + 1, dtype=np.int32) * -GAP
        last, best = np.zeros((len(take), n + 1), np.int32), np.zeros((len(take), n + 1), np.int32)
        for w in item:
            row = np.zeros_like(last)
            np.maximum(last[:, :-1] + np.where((words == w) & inside, np.int32(MATCH), np.int32(MISMATCH)), 0, out=row[:, 1:])
            np.maximum(row, last + np.int32(GAP), out=row)
            row = np.maximum.accumulate(row + down, axis=1) - down  # gaps along the row
            np.maximum(best, row, out=best)
            last = row
        out[take] = best.max(axis=1)
    return out


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment score of two sequences of word hashes."""
    return int(alignments(item, [passage])[0])


def items_of(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """item_id, words (hashes), seeds (hashes of n-grams) of the items."""

    def of_batch(batch: pa.RecordBatch):
        for lo, hi, buf, off in text_slices(batch.column(1)):
            mapped, starts, ends, first = words_of(buf, off, ALNUM_WORDS)
            hashes = word_hashes(mapped, starts, ends)
            counts = np.diff(first)
            at = gram_starts(first, n)
            grams = rolling_hashes(hashes, n)[at] if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), list_array(as_signed(hashes), counts, pa.int64()), list_array(as_signed(grams), np.maximum(counts - n + 1, 0), pa.int64())], ["item_id", "words", "seeds"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null")
    return map_arrow(rows, of_batch, "item_id long, words array<long>, seeds array<long>").filter(F.size("seeds") > 0).distinct()


def _passages(rows: DataFrame, held, margin: int, n: int) -> DataFrame:
    """did, th, pk (digest of the words), words, seeds: stretches of words around seed hits, `margin` words on either side, joined where they meet."""

    def of_batch(batch: pa.RecordBatch):
        table = load_filter(held)
        for lo, _, buf, off in text_slices(batch.column(2)):
            mapped, starts, ends, first = words_of(buf, off, ALNUM_WORDS)
            at = gram_starts(first, n)
            if not len(at):
                continue
            hashes = word_hashes(mapped, starts, ends)
            grams = rolling_hashes(hashes, n)[at]
            hit = passes(grams, table)
            at, grams = at[hit], grams[hit]
            if not len(at):
                continue
            row = np.searchsorted(first, at, "right") - 1
            p0, p1 = np.maximum(at - margin, first[row]), np.minimum(at + n + margin, first[row + 1])
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (p0[1:] > p1[:-1])])
            last = np.r_[new[1:], len(at)] - 1
            runs = [hashes[a:b] for a, b in zip(p0[new], p1[last], strict=True)]
            take = pa.array(lo + row[new])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([digest(r) for r in runs], pa.binary()), list_array(as_signed(np.concatenate(runs)), p1[last] - p0[new], pa.int64()), list_array(as_signed(grams), np.diff(np.r_[new, len(at)]), pa.int64())],
                ["did", "th", "pk", "words", "seeds"],
            )

    return map_arrow(rows.select("did", "th", "text"), of_batch, "did long, th long, pk binary, words array<long>, seeds array<long>")


def _align(batch: pa.RecordBatch):
    items, words = batch.column(2), batch.column(3)
    at: dict[tuple[int, bytes], list[int]] = {}
    for r, i in enumerate(batch.column(1).to_pylist()):
        at.setdefault((i, np.asarray(items[r].values).tobytes()), []).append(r)  # an id may have several texts
    scores = np.zeros(batch.num_rows)
    for (_, data), rows in at.items():
        item = np.frombuffer(data, np.int64)
        scores[rows] = alignments(item, [np.asarray(words[r].values) for r in rows]) / (MATCH * len(item))
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["pk", "item_id", "score"])


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SEED_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """did, th, item_id, score: the best alignment of each document with each item that a seed found in it."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    items = scratch.write(items_of(benchmark, item_col, item_text_col, n), "items")
    seeds = scratch.write(items.select("item_id", F.explode("seeds").alias("h")).distinct(), "seeds")
    shape = items.agg(F.max(F.size("words")), F.sum(F.size("seeds"))).first()
    held = key_filter(seeds, "h")
    found = scratch.write(_passages(prepared(docs, id_col, text_col), held, shape[0] or 0, n), "passages")
    small = (shape[1] or 0) <= BROADCAST_SEEDS
    bounded = F.broadcast if small else lambda df: df
    # the words of a passage name its seeds, too
    passages = scratch.write(found.select("pk", "words", "seeds").dropDuplicates(["pk"]), "distinct")
    wanted = passages.select("pk", F.explode(F.array_distinct("seeds")).alias("h")).join(bounded(seeds), "h").select("pk", "item_id").distinct()
    pairs = wanted.join(passages.select("pk", "words"), "pk")
    pairs = pairs.join(bounded(items.select("item_id", F.col("words").alias("item"))), "item_id")
    aligned = map_arrow(pairs.select("pk", "item_id", "item", "words"), _align, "pk binary, item_id long, score double")
    best = scratch.write(aligned.groupBy("pk", "item_id").agg(F.max("score").alias("score")), "aligned")
    scored = found.select("did", "th", "pk").distinct().join(best, "pk")
    return scratch.write(scored.groupBy("did", "th", "item_id").agg(F.max("score").alias("score")), "scores")


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = SEED_WORDS) -> DataFrame:
    """One row per document row: doc_id, contaminated, n_items, item_ids (scoring the threshold or more, ascending), best_score (of any item, 0 without)."""
    scored = matches(docs, benchmark, id_col=id_col, text_col=text_col, n=n)
    over = F.col("score") >= threshold
    per_doc = scored.groupBy("did", "th").agg(F.max("score").alias("best_score"), F.array_sort(F.collect_list(F.when(over, F.col("item_id")))).alias("item_ids"))
    rows = prepared(docs, id_col, text_col).select("did", "th").join(per_doc, ["did", "th"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return rows.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"),
        (F.size(ids) > 0).cast("int").alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = SEED_WORDS) -> DataFrame:
    """docs without the rows that hold a test item."""
    scored = matches(docs, benchmark, id_col=id_col, text_col=text_col, n=n)
    return without(docs, scored.filter(F.col("score") >= threshold).select("did", "th"), id_col, text_col)
