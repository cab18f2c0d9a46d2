"""Windows that repeat: what the substring and the suffix-array dedup share.

A window is W consecutive units (bytes, or words) of one document. Every window has an anchor: the gram of M units in it
whose hash is smallest, the leftmost of equals. Equal windows have equal grams and so the same anchor at the same
place, so windows can only be equal if the hashes of their anchors are. Consecutive windows with one anchor
form a stretch; about 2/(W-M+2) of the positions are anchors, so what is exchanged first is a small part of the
windows. Only stretches whose anchor stands elsewhere, too, are looked at further, by digests of their whole content.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE_VALUES, SPACED_WORDS, as_signed, rolling_hashes, sliding_min, text_slices, word_hashes, words_of
from .shared import NO_ID, Scratch, key_filter, load_filter, map_arrow, passes, split_rows

#: Units hashed at once; a longer document is taken in parts that overlap by a window.
PART = 1 << 20


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    window: int
    gram: int
    words: bool

    def views(self, column: pa.Array):
        """For slices of a text column: first row, bytes, first byte and end byte of each unit, first unit of each row, hashes."""
        for lo, hi, buf, off in text_slices(column):
            if self.words:
                raw = buf.tobytes()
                rows = [b" ".join(raw[a:b].split()) for a, b in zip(off[:-1], off[1:], strict=True)]
                off = np.r_[0, np.cumsum([len(r) for r in rows])]
                buf = np.frombuffer(b"".join(rows), np.uint8)
                mapped, starts, ends, first = words_of(buf, off, SPACED_WORDS)
                yield lo, hi, buf, starts, ends, first, word_hashes(mapped, starts, ends)
            else:
                at = np.arange(len(buf) + 1)
                yield lo, hi, buf, at[:-1], at[1:], off, None


def stretches(buf: np.ndarray, first: np.ndarray, hashes: np.ndarray | None, units: Units):
    """Stretches of a slice: row, first window (unit within the slice), windows, anchor's distance from it, anchor's hash."""
    w, m = units.window, units.gram
    total = int(first[-1])
    found = []
    for p0 in range(0, max(total - w + 1, 0), PART):
        p1 = min(p0 + PART + w - 1, total)
        grams = rolling_hashes(hashes[p0:p1] if hashes is not None else BYTE_VALUES[buf[p0:p1]], m)
        order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        lowest = (sliding_min(order, w - m + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.arange(p0, p0 + len(lowest))
        row = np.searchsorted(first, at, "right") - 1 if len(first) > 2 else np.zeros(len(at), np.int64)
        whole = at + w <= first[row + 1]
        at, row, lowest = at[whole], row[whole], lowest[whole]
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, (lowest[1:] != lowest[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
        found.append((row[new], at[new], np.diff(np.r_[new, len(at)]), lowest[new] + p0 - at[new], grams[lowest[new]]))
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e, e, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did (id, NO_ID for null), th (hash of the text), text: together they name a row and its exact repetitions."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def anchor_counts(rows: DataFrame, units: Units, with_id: bool) -> DataFrame:
    """fp, c (stretches) of the anchors of each batch, still to be summed up; with_id: fp, did, once for each document of a batch."""

    def of_batch(batch: pa.RecordBatch):
        did = np.asarray(batch.column(0))
        for lo, _, buf, _, _, first, hashes in units.views(batch.column(1)):
            row, _, _, _, fp = stretches(buf, first, hashes, units)
            if not len(fp):
                continue
            ids = did[lo + row] if with_id else np.zeros(len(fp), np.int64)
            order = np.lexsort((ids, fp)) if with_id else np.argsort(fp)
            fp, ids = fp[order], ids[order]
            new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (ids[1:] != ids[:-1])])
            second = ids[new] if with_id else np.diff(np.r_[new, len(fp)])
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(fp[new])), pa.array(second, pa.int64())], ["fp", "did" if with_id else "c"])

    return map_arrow(rows.select("did", "text"), of_batch, "fp long, did long" if with_id else "fp long, c long")


def placements(rows: DataFrame, shared: DataFrame, units: Units, scratch: Scratch) -> DataFrame:
    """Stretches whose anchor is in `shared` (fp): fp, sw (digest of the content), did, th, s, n, a."""
    held = key_filter(shared, "fp")

    def of_batch(batch: pa.RecordBatch):
        table = load_filter(held)
        for lo, _, buf, starts, ends, first, hashes in units.views(batch.column(2)):
            row, at, n, a, fp = stretches(buf, first, hashes, units)
            if not len(fp):
                continue
            keep = passes(fp, table)
            row, at, n, a, fp = row[keep], at[keep], n[keep], a[keep], fp[keep]
            view = memoryview(buf)
            sw = [digest(view[x:y]) for x, y in zip(starts[at].tolist(), ends[at + n - 2 + units.window].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(fp)), pa.array(sw, pa.binary()), batch.column(0).take(pa.array(lo + row)), batch.column(1).take(pa.array(lo + row)), pa.array((at - first[row]).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(a.astype(np.int32))],
                ["fp", "sw", "did", "th", "s", "n", "a"],
            )

    found = map_arrow(rows.select("did", "th", "text"), of_batch, "fp long, sw binary, did long, th long, s long, n int, a int")
    return scratch.write(found.join(shared, "fp", "left_semi"), "placed")


def shared_runs(rows: DataFrame, scratch: Scratch, words: int, gram: int) -> DataFrame:
    """did, th, n_elsewhere: runs of `gram` words in a document that stand in another one, too, counted at the anchors of windows of `words`.

    A document that shares `words` words in a row with another one has one at least; one that shares fewer than `gram` has none.
    """
    units = Units(words, gram, True)

    def of_batch(batch: pa.RecordBatch):
        for lo, _, buf, _, _, first, hashes in units.views(batch.column(2)):
            row, _, _, _, fp = stretches(buf, first, hashes, units)
            if len(fp):
                order = np.lexsort((fp, row))
                row, fp = row[order], fp[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (fp[1:] != fp[:-1])]
                at = pa.array(lo + row[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(as_signed(fp[new]))], ["did", "th", "fp"])

    anchors = scratch.write(map_arrow(rows.select("did", "th", "text"), of_batch, "did long, th long, fp long"), "anchors")
    key = F.xxhash64("did", "th")
    shared = anchors.groupBy("fp").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("x <> y").select("fp")
    shared = scratch.write(shared, "elsewhere")
    held = key_filter(shared, "fp")

    def hot(batch: pa.RecordBatch):
        yield batch.filter(pa.array(passes(np.asarray(batch.column(2)), load_filter(held))))

    found = map_arrow(anchors, hot, "did long, th long, fp long").distinct().join(shared, "fp", "left_semi")
    return found.groupBy("did", "th").agg(F.count("*").alias("n_elsewhere"))


def contents(rows: DataFrame, reps: DataFrame, units: Units, scratch: Scratch) -> DataFrame:
    """reps (did, th, s, n, and more) with column content: the bytes of the stretch, and cuts: the first byte of each of its units."""
    more = [c for c in reps.columns if c not in ("did", "th")]
    per_doc = reps.groupBy("did", "th").agg(F.collect_list(F.struct(*more)).alias("items"))
    texts, _ = split_rows(rows, ("did", "th"), reps.select("did", "th"))
    texts = texts.dropDuplicates(["did", "th"])

    def of_batch(batch: pa.RecordBatch):
        lists = batch.column(3)
        sizes = np.diff(np.asarray(lists.offsets))
        offsets = np.r_[0, np.cumsum(sizes)]
        flat = lists.flatten()
        s_all, n_all = np.asarray(flat.field("s")), np.asarray(flat.field("n"))
        content, cuts = [], []
        for lo, hi, buf, starts, ends, first, _ in units.views(batch.column(2)):
            for r in range(hi - lo):
                for i in range(offsets[lo + r], offsets[lo + r + 1]):
                    u0 = int(first[r] + s_all[i])
                    u1 = int(u0 + n_all[i] - 1 + units.window)
                    content.append(buf[starts[u0] : ends[u1 - 1]].tobytes())
                    cuts.append((starts[u0:u1] - starts[u0]).astype(np.int32).tobytes() if units.words else b"")
        at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), *(flat.field(c) for c in more), pa.array(content, pa.binary()), pa.array(cuts, pa.binary())],
            ["did", "th", *more, "content", "cuts"],
        )

    types = {f.name: f.dataType.simpleString() for f in reps.schema.fields}
    joined = texts.join(per_doc, ["did", "th"]).select("did", "th", "text", "items")
    schema = "did long, th long, " + ", ".join(f"{c} {types[c]}" for c in more) + ", content binary, cuts binary"
    return scratch.write(map_arrow(joined, of_batch, schema), "contents")


def window_digests(table: DataFrame, units: Units, keep: list[str]) -> DataFrame:
    """A row for each window of the contents: wh (digest), x (which window of the stretch) and the columns to keep."""

    def of_batch(batch: pa.RecordBatch):
        names = batch.schema.names
        content, cuts, n = (batch.column(names.index(c)) for c in ("content", "cuts", "n"))
        wh, row, xs = [], [], []
        for r in range(batch.num_rows):
            data, k = memoryview(content[r].as_py()), n[r].as_py()
            if units.words:
                at = np.frombuffer(cuts[r].as_py(), np.int32).tolist()
                ends = [*(x - 1 for x in at[units.window :]), len(data)]
                wh += [digest(data[at[x] : ends[x]]) for x in range(k)]
            else:
                wh += [digest(data[x : x + units.window]) for x in range(k)]
            row += [r] * k
            xs += range(k)
            if len(wh) >= 50_000:
                yield out(batch, wh, row, xs)
                wh, row, xs = [], [], []
        if wh:
            yield out(batch, wh, row, xs)

    def out(batch, wh, row, xs):
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(wh, pa.binary()), pa.array(xs, pa.int32()), *(batch.column(c).take(at) for c in keep)], ["wh", "x", *keep])

    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return map_arrow(table, of_batch, "wh binary, x int, " + ", ".join(f"{c} {types[c]}" for c in keep))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal spans."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return lo[new], hi[np.r_[new[1:], len(lo)] - 1]


def finish(rows: DataFrame, spans: DataFrame, units: Units, scratch: Scratch, texts_too: bool = False, elsewhere: DataFrame | None = None) -> DataFrame:
    """Rows with their spans (did, th, b0, b1 in units) removed: doc_id, n_units, n_removed, n_spans, kept_sha256, n_elsewhere (and kept).

    Rows without spans never leave their task. Exact repetitions of a row share its spans. elsewhere: n_elsewhere by did, th; else it is 0.
    """
    # rows that share a key (a null id and a text) have the same spans
    per_doc = spans.groupBy("did", "th").agg(F.collect_set(F.struct("b0", "b1")).alias("spans"))
    if elsewhere is not None:
        per_doc = per_doc.join(elsewhere, ["did", "th"], "full_outer")
    else:
        per_doc = per_doc.withColumn("n_elsewhere", F.lit(None).cast("long"))
    per_doc = scratch.write(per_doc, "spans_of")

    def of_batch(batch: pa.RecordBatch):
        lists = batch.column(3) if batch.num_columns > 3 else None
        more = batch.column(4).to_pylist() if batch.num_columns > 4 else None
        out = {"n_units": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "n_elsewhere": [], "kept": []}
        for lo, hi, buf, starts, ends, first, _ in units.views(batch.column(2)):
            raw = buf.tobytes()
            for r in range(hi - lo):
                u0, u1 = int(first[r]), int(first[r + 1])
                got = lists[lo + r].as_py() if lists is not None else None
                a, b = merged(np.array([s["b0"] for s in got], np.int64), np.array([s["b1"] for s in got], np.int64)) if got else ((), ())
                keep, at = [], 0
                for x, y in zip(a, b, strict=True):
                    keep.append((at, int(x)))
                    at = int(y)
                keep.append((at, u1 - u0))
                parts = [raw[starts[u0 + x] : ends[u0 + y - 1]] for x, y in keep if y > x]
                kept = (b" " if units.words else b"").join(parts)
                out["n_units"].append(u1 - u0)
                out["n_removed"].append(int(sum(b) - sum(a)) if got else 0)
                out["n_spans"].append(len(a))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["n_elsewhere"].append(more[lo + r] or 0 if more else 0)
                out["kept"].append(kept if texts_too else None)
        did = batch.column(0)
        ids = pa.array([None if x == NO_ID else x for x in did.to_pylist()], pa.int64())
        columns = [ids, *(pa.array(out[c], pa.int64()) for c in ("n_units", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["n_elsewhere"], pa.int64()), pa.array(out["kept"], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "n_elsewhere", "kept"])

    schema = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, n_elsewhere long, kept binary"
    some, done = split_rows(rows, ("did", "th"), per_doc.select("did", "th"), of_batch, schema)
    joined = some.join(per_doc.hint("shuffle_hash"), ["did", "th"], "left").select("did", "th", "text", "spans", "n_elsewhere")  # no sort of texts
    done = map_arrow(joined, of_batch, schema).union(done)
    return done if texts_too else done.drop("kept")
