"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Of all suffixes only those at anchors are sorted (a sparse suffix array, see repeats.py), and of these only those whose
anchor's hash stands elsewhere, too: a suffix with a unique start cannot repeat, as in prefix-doubling string sorting.
Stretches with equal content count as one string. Each task sorts its suffixes, front-codes them into a run for
each range of anchors and exchanges the runs; the receiving task merges them with a loser tree that never compares a known
prefix again, and the merge's prefix lengths delimit the groups of strings whose windows can be equal. In a group, two windows
at one distance from their anchors are equal if the suffixes share enough to the right and the texts to the left.

A group with more different strings than GROUP would be one task's work; its windows are counted by their digests
instead, with partial sums, so no group is ever gathered. Both ways are exact.

Defined results: a null text is empty; ids play no part, so rows with null or repeated ids count like others, and a row that
repeats another is a copy of it; every row returns one row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lcp_merge import LoserTree, common_prefix, pack_run, unpack_run
from .repeats import Units, anchor_counts, contents, finish, placements, prepared, shared_runs, window_digests
from .shared import Scratch

WINDOW = 400
GRAM = 120
#: Different strings of an anchor up to which one task compares them.
GROUP = 2048
#: Bytes of strings that a task sorts into one set of runs, and that a merging task gets on average.
RUN_BYTES = 8 << 20
MERGE_BYTES = 16 << 20
#: Words of a passage that a window of bytes may be too long for, and of the runs by which such passages are found.
PASSAGE, PASSAGE_GRAM = 51, 40
#: Strings up to which a group is compared pair by pair.
_PAIRS = 12


def equal_windows(rights: list[bytes], lefts: list[bytes], lcps: list[int], window: int) -> list[tuple[int, int, int]]:
    """(string, o0, o1): windows that begin o0 <= o < o1 bytes before the anchor of the string stand in another one, too.

    rights: the strings from their anchors on, in order; lcps: what each shares with the one before; lefts: what stands before.
    """
    g, out = len(rights), []
    if g <= _PAIRS:
        for i in range(g):
            right = 1 << 60
            for j in range(i + 1, g):
                right = min(right, lcps[j])
                a, b = lefts[i][::-1], lefts[j][::-1]
                left = common_prefix(a, b)
                if left + right >= window:
                    lo, hi = max(0, window - right), left + 1
                    if lo < hi:
                        out += [(i, lo, hi), (j, lo, hi)]
        return out
    back = [x[::-1] for x in lefts]
    order = sorted(range(g), key=back.__getitem__)
    shared = np.array([0] + [common_prefix(back[order[k - 1]], back[order[k]]) for k in range(1, g)])
    most = max(len(x) for x in lefts)
    offs = np.arange(most + 1)
    right_class = np.cumsum(np.r_[0, lcps[1:]][None, :] < (window - offs)[:, None], axis=1)
    left_class = np.empty((most + 1, g), np.int64)
    left_class[:, order] = np.cumsum(shared[None, :] < offs[:, None], axis=1)
    key = right_class * (g + 2) + left_class
    room = (np.array([len(x) for x in rights])[None, :] >= (window - offs)[:, None]) & (np.array([len(x) for x in lefts])[None, :] >= offs[:, None])
    key[~room] = -1 - np.broadcast_to(np.arange(g), key.shape)[~room]  # no window: equal to nothing
    by = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, by, axis=1)
    same = ranked[:, 1:] == ranked[:, :-1]
    twice = np.zeros(key.shape, bool)
    twice[:, 1:] |= same
    twice[:, :-1] |= same
    hit = np.zeros(key.shape, bool)
    np.put_along_axis(hit, by, twice, axis=1)
    edge = np.diff(np.pad(hit.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    up, down = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return list(zip(up[0].tolist(), up[1].tolist(), down[1].tolist(), strict=True))


def _runs(parts: int):
    """Content rows -> sorted front-coded runs, one for each part and about RUN_BYTES of content."""

    def flush(held):
        for part, items in sorted(held.items()):
            yield part, pack_run(items)

    def run(batches):
        held, size = {}, 0
        for b in batches:
            cols = [b.column(b.schema.names.index(c)).to_pylist() for c in ("fp", "content", "a", "n", "c", "did", "th", "s")]
            for fp, content, a, n, c, did, th, s in zip(*cols, strict=True):
                held.setdefault((fp * 0x9E3779B97F4A7C15 % (1 << 64) >> 20) % parts, []).append((content[a:], (content[:a], n, c, did, th, s)))
                size += len(content)
            if size >= RUN_BYTES:
                out = list(flush(held))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.binary())], ["part", "run"])
                held, size = {}, 0
        if held:
            out = list(flush(held))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.binary())], ["part", "run"])

    return run


def _merge(window: int, gram: int):
    def groups(runs):
        rights, payloads, lcps = [], [], []
        for h, string, payload in LoserTree([unpack_run(r) for r in runs]):
            if rights and h < gram:
                yield rights, payloads, lcps
                rights, payloads, lcps = [], [], []
            rights.append(string)
            payloads.append(payload)
            lcps.append(h)
        if rights:
            yield rights, payloads, lcps

    def of_part(table: pa.Table) -> pa.Table:
        out = {"did": [], "th": [], "b0": [], "b1": []}
        for rights, payloads, lcps in groups(table.column("run").to_pylist()):
            if len(rights) < 2:
                continue
            for i, o0, o1 in equal_windows(rights, [p[0] for p in payloads], lcps, window):
                left, n, c, did, th, s = payloads[i]
                if c > 1:
                    continue  # stands elsewhere as a whole
                x0, x1 = max(0, len(left) - (o1 - 1)), min(n, len(left) - o0 + 1)
                if x0 < x1:
                    for name, v in (("did", did), ("th", th), ("b0", s + x0), ("b1", s + x1 - 1 + window)):
                        out[name].append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return of_part


def repeated_spans(rows: DataFrame, units: Units, group: int, scratch: Scratch) -> DataFrame:
    """Spans (did, th, b0, b1) of the bytes covered by windows that start anywhere else, too."""
    counts = anchor_counts(rows, units, with_id=False).groupBy("fp").agg(F.sum("c").alias("c")).filter("c > 1")
    placed = placements(rows, scratch.write(counts.select("fp"), "shared"), units, scratch)
    kinds = placed.groupBy("fp", "sw").agg(F.count("*").alias("c"), F.min(F.struct("did", "th", "s", "n", "a")).alias("rep"))
    per_anchor = kinds.groupBy("fp").agg(F.count("*").alias("kinds"))
    kinds = scratch.write(kinds.join(per_anchor, "fp"), "kinds")
    whole = kinds.filter("c > 1").select("fp", "sw")
    decided = placed.join(whole, ["fp", "sw"]).select("did", "th", F.col("s").alias("b0"), (F.col("s") + F.col("n") - 1 + units.window).alias("b1"))
    reps = kinds.filter("kinds > 1").select("rep.*", "fp", "c", (F.col("kinds") > group).alias("large"))
    table = contents(rows, reps, units, scratch)
    size = table.filter("not large").agg(F.sum(F.length("content"))).first()[0] or 0
    parts = max(1, -(-size // MERGE_BYTES))
    runs = table.filter("not large").mapInArrow(_runs(max(parts, 12)), "part int, run binary")
    sorted_spans = runs.groupBy("part").applyInArrow(_merge(units.window, units.gram), "did long, th long, b0 long, b1 long")
    each = window_digests(table.filter("large"), units, ["did", "th", "s", "c"])
    counted = each.groupBy("wh").agg(F.count("*").alias("times")).filter("times > 1")
    large_spans = each.filter("c = 1").join(counted, "wh").select("did", "th", (F.col("s") + F.col("x")).alias("b0"), (F.col("s") + F.col("x") + units.window).alias("b1"))
    return scratch.write(decided.union(sorted_spans).union(large_spans), "spans")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, texts_too: bool = False, passages: bool = False) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept_sha256, n_elsewhere (and kept) of each row.

    With `passages`, n_elsewhere counts the runs of PASSAGE_GRAM words that another document has, too (see repeats.shared_runs); else it is 0.
    """
    units = Units(window, gram, False)
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = prepared(docs, id_col, text_col)
    elsewhere = shared_runs(rows, scratch, PASSAGE, PASSAGE_GRAM) if passages else None
    return finish(rows, repeated_spans(rows, units, group, scratch), units, scratch, texts_too, elsewhere)
