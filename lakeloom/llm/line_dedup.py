"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, distributed union-find.

A line is compared in its normal form: A-Z lower-cased, ASCII white space as single spaces, none at the ends. Blank lines are always
kept. Of each line the MinHash signature over its character shingles is cut into bands; lines that agree on a whole band are
candidates. Recall of a pair of similarity s is 1 - (1 - s^ROWS)^BANDS: 0.986 at 0.8, 0.9998 at 0.9, 1 for equal lines.
Bands shared by different lines are found first, from keys alone; only lines in them bring their text. Candidates are
verified by the exact Jaccard similarity of their shingle sets (64-bit hashes of the shingles), buckets of any size in tiles of bounded size that yield a spanning forest,
never all pairs. Components then keep the line that stands first by document id and position.

Defined results: a null text has one blank line; null ids come before others; rows that repeat both id and text
keep the same lines; every row returns one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED_LOWER_WORDS, as_signed, list_array, mix64, rolling_hashes, text_slices, words_of
from .repeats import prepared
from .shared import KEY, NO_ID, Scratch, components, key_filter, keyed, load_filter, map_arrow, passes, split_rows

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 8, 4
#: Lines of a bucket that one task compares with as many others.
TILE = 2048
#: Bytes whose shingles are hashed at once.
PART = 1 << 16
#: Shingles of a line whose minimum is taken at once.
STEP = 16
#: Bits of the sketch that tells most unlike lines apart before their shingles are compared.
SKETCH = 2048

_FACTORS = (mix64(np.arange(1, 129, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _grams(data: np.ndarray, lengths: np.ndarray, q: int):
    """(first line, end line, hashes of the shingles, shingles of each line) of groups of lines of about PART bytes.

    data: the UTF-8 bytes of the lines one after another. A line of fewer characters than a shingle is padded to one.
    """
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        from_byte = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, from_byte + PART, "right")))
        part = data[from_byte : ends[j - 1]]
        sizes = lengths[i:j]
        points = part.astype(np.uint64)
        if len(part) and part.max() > 127:
            sizes = np.add.reduceat((part & 0xC0) != 0x80, ends[i:j] - sizes - from_byte)
            points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        if (sizes < q).any():
            wide = np.maximum(sizes, q)
            spots = np.arange(len(points)) + np.repeat(np.cumsum(wide) - wide - (np.cumsum(sizes) - sizes), sizes)
            padded = np.zeros(int(wide.sum()), np.uint64)
            padded[spots] = points
            points, sizes = padded, wide
        grams = rolling_hashes((points + np.uint64(77)) * np.uint64(0xD6E8FEB86659FD93), q)
        keep = np.ones(len(grams), bool)
        cuts = np.cumsum(sizes)[:-1]
        for k in range(1, q):  # shingles across two lines
            keep[cuts - k] = False
        yield i, j, grams[keep], sizes - q + 1
        i = j


class Shingles:
    """The different shingles of a line as sorted 64-bit hashes, and a sketch: SKETCH bits, those set that a shingle falls on."""

    __slots__ = ("found", "size", "sketch")

    def __init__(self, grams: np.ndarray, sketch: int):
        grams = np.sort(grams)
        new = np.ones(len(grams), bool)
        np.not_equal(grams[1:], grams[:-1], out=new[1:])
        self.found = grams[new]
        self.size, self.sketch = len(self.found), sketch

    def similar(self, other: Shingles, similarity: float) -> bool:
        """Jaccard similarity of at least that much. A bit that only one sketch has stands for a shingle that only one line has."""
        need = similarity * (self.size + other.size) - 1e-9
        if (self.size - (self.sketch & ~other.sketch).bit_count()) * (1 + similarity) < need:
            return False
        at = other.found.searchsorted(self.found)
        return int((other.found.take(at, mode="clip") == self.found).sum()) * (1 + similarity) >= need


def shingles(lines: list[bytes], q: int = SHINGLE) -> list[Shingles]:
    out = []
    for _, _, grams, sizes in _grams(np.frombuffer(b"".join(lines), np.uint8), np.array([len(x) for x in lines], np.int64), q):
        bits = np.zeros((len(sizes), SKETCH), bool)
        bits[np.repeat(np.arange(len(sizes)), sizes), (grams & np.uint64(SKETCH - 1)).astype(np.int64)] = True
        sketches, ends = np.packbits(bits, axis=1), np.cumsum(sizes).tolist()
        out += [Shingles(grams[a:b], int.from_bytes(sketches[k].tobytes())) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
    return out


def signatures(data: np.ndarray, lengths: np.ndarray, q: int, count: int) -> np.ndarray:
    """MinHash signatures of the lines, one row for each."""
    out = np.empty((len(lengths), count), np.uint32)
    for i, j, grams, sizes in _grams(data, lengths, q):
        grams = (grams >> np.uint64(32)).astype(np.uint32)
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        # blocks of STEP shingles of one line side by side (the last one repeated), so that minima are taken across rows
        blocks = -(-sizes // STEP)
        first = np.r_[0, np.cumsum(blocks)[:-1]]
        nth = (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * STEP
        most = np.repeat(sizes - 1, blocks)
        spots = np.minimum(nth[None, :] + np.arange(STEP)[:, None], most[None, :]) + np.repeat(begins, blocks)[None, :]
        table = grams[spots]
        work = np.empty_like(table)
        for k in range(count):
            np.multiply(table, _FACTORS[k], out=work)
            out[i:j, k] = np.minimum.reduceat(np.minimum.reduce(work, axis=0), first)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the bands, one row for each line; keys of different bands differ."""
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key ^ (sig[:, b * rows + r].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        keys[:, b] = key
    return keys


#: Bytes of normal forms: A-Z lower-cased, white space as a space.
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] += 32
_FORM[9:14] = 32


def lines_of(column: pa.Array):
    """For slices of a text column: the bytes of all normal forms, and for each line that is not blank its row, position, first and end byte."""
    for lo, _, buf, off in text_slices(column):
        mapped, starts, ends, first = words_of(buf, off, SPACED_LOWER_WORDS)
        if not len(starts):
            continue
        keep = mapped != 0
        keep[1:] |= keep[:-1].copy()  # and the white space that ends a word
        at = np.cumsum(keep, dtype=np.int32) - 1
        breaks = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(buf == 10, dtype=np.int32, out=breaks[1:])
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        pos = breaks[starts] - breaks[off[:-1]][row]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])])
        last = np.r_[new[1:], len(starts)] - 1
        yield _FORM[buf[keep]], lo + row[new], pos[new], at[starts[new]].astype(np.int64), at[ends[last] - 1].astype(np.int64) + 1


def _key(form) -> bytes:
    return xxhash.xxh3_128_digest(form)


def _spans(forms: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and their lengths."""
    sizes = end - begin
    return forms[np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)], sizes


def _occurrences(rows: DataFrame, q: int, bands: int, band_rows: int) -> DataFrame:
    """did, th, pos, lk (digest of the normal form) of each line, and bands where a batch meets the line first."""

    def of_batch(batch: pa.RecordBatch):
        seen: set[bytes] = set()
        for forms, row, pos, begin, end in lines_of(batch.column(2)):
            view = memoryview(forms)
            keys = [_key(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            new = []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            at = pa.array(row)
            per = np.zeros(len(row), np.int64)
            per[new] = bands
            found = band_keys(signatures(*_spans(forms, begin[new], end[new]), q, bands * band_rows), bands, band_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos.astype(np.int32)), pa.array(keys, pa.binary()), list_array(as_signed(found.ravel()), per, pa.int64())], ["did", "th", "pos", "lk", "bands"])

    return map_arrow(rows.select("did", "th", "text"), of_batch, "did long, th long, pos int, lk binary, bands array<long>")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """lk, form: the normal forms (UTF-8) of the wanted lines (lk), among few others."""
    held = key_filter(wanted.select(F.xxhash64("lk").alias("k")), "k")

    def of_batch(batch: pa.RecordBatch):
        table = load_filter(held)
        seen: set[bytes] = set()
        for forms, _, _, begin, end in lines_of(batch.column(0)):
            view = memoryview(forms)
            keys, spots = [], []
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                key = _key(view[a:b])
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    spots.append(i)
            if keys:
                at = np.flatnonzero(passes(np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64), table)).tolist()
                found = [view[begin[spots[j]] : end[spots[j]]] for j in at]
                yield pa.RecordBatch.from_arrays([pa.array([keys[j] for j in at], pa.binary()), pa.array([bytes(x) for x in found], pa.binary())], ["lk", "form"])

    return map_arrow(rows.select("text"), of_batch, "lk binary, form binary").dropDuplicates(["lk"])


def forest(keys: list[bytes], sets: list[Shingles], sides: list[int], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that connect the similar lines of a tile pair, across the sides if there are two; a spanning forest.

    Lines come by rising size; each is compared with a component only until one member of it is similar.
    """
    across = len(set(sides)) > 1
    out: list[tuple[bytes, bytes]] = []
    parts: list[list[int]] = []  # components, their members by rising size
    for i in sorted(range(len(keys)), key=lambda i: (sets[i].size, keys[i], sides[i])):
        mine, least, side = sets[i], similarity * sets[i].size - 1e-9, sides[i]
        apart, joined = [], []
        for part in parts:
            if sets[part[-1]].size < least:
                continue  # no member is large enough for this line or a later one
            for j in reversed(part):
                if sets[j].size < least:
                    apart.append(part)
                    break
                same = keys[i] == keys[j]  # a line that stands on both sides
                if across and sides[j] == side and not same:
                    continue
                if same or mine.similar(sets[j], similarity):
                    if not same:
                        out.append((keys[i], keys[j]))
                    joined = sorted(joined + part, key=lambda x: sets[x].size) if joined else part
                    break
            else:
                apart.append(part)
        joined.append(i)
        parts = [*apart, joined]
    return out


def _verify(q: int, similarity: float):
    """Rows (band, t0, t1, lk, side, form) in the order of the first three -> links (a, b), pair of tiles by pair."""

    def run(batches):
        held, last = [[], [], []], None
        out: list[tuple[bytes, bytes]] = []

        def flushed():
            pairs, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

        for batch in batches:
            groups = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1), True]).tolist()
            keys, sides, forms = (batch.column(i).to_pylist() for i in (3, 4, 5))
            different = dict(zip(keys, forms, strict=True))
            made = dict(zip(different, shingles(list(different.values()), q), strict=True))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group = tuple(groups[a])
                if group != last:
                    if len(held[0]) > 1:
                        out += forest(*held, similarity)
                    held, last = [[], [], []], group
                held[0] += keys[a:b]
                held[1] += [made[k] for k in keys[a:b]]
                held[2] += sides[a:b]
            if len(out) > 10_000:
                yield flushed()
        if len(held[0]) > 1:
            out += forest(*held, similarity)
        if out:
            yield flushed()

    return run


def links(lines: DataFrame, rows: DataFrame, scratch: Scratch, *, q: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Verified links (a, b) between lines (lk, bands)."""
    signed = lines.filter(F.size("bands") > 0).select("lk", "bands")
    pairs = signed.select("lk", F.explode("bands").alias("band"))
    short = F.xxhash64("lk")
    shared = pairs.groupBy("band").agg(F.min(short).alias("x"), F.max(short).alias("y")).filter("x <> y").select("band")
    shared = scratch.write(shared, "bands")
    held = key_filter(shared, "band")

    def hot(batch: pa.RecordBatch):
        band = np.asarray(batch.column(1).flatten())
        at = np.flatnonzero(passes(band, load_filter(held)))
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(1).offsets)))[at]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(band[at])], ["lk", "band"])

    members = scratch.write(map_arrow(signed, hot, "lk binary, band long").distinct(), "members")
    # buckets with the same members need one verification; those of one member only passed the filter
    marks = members.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("lk"), 32)).alias("mark"), F.bit_xor(F.xxhash64(F.lit(1), "lk")).alias("mark2")).filter("n > 1")
    buckets = marks.groupBy("n", "mark", "mark2").agg(F.min("band").alias("band")).select("band", "n")
    members = members.join(buckets, "band")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(2), "lk"), tiles).cast("int")
    dealt = members.select("lk", "band", mine.alias("t"), tiles.alias("tiles")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lk", "band", F.least("t", "o").alias("t0"), F.greatest("t", "o").alias("t1"), F.when(F.col("t") <= F.col("o"), 0).otherwise(1).alias("side"))
    texts = _texts(rows, scratch.write(members.select("lk").distinct(), "wanted"))
    rows = dealt.hint("shuffle_hash").join(texts, "lk").select("band", "t0", "t1", "lk", "side", "form").repartition("band", "t0", "t1").sortWithinPartitions("band", "t0", "t1")
    return rows.mapInArrow(_verify(q, similarity), "a binary, b binary").distinct()


def removals(rows: DataFrame, scratch: Scratch, *, q: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """did, th, gone (positions of lines that another line of their component precedes)."""
    lines = scratch.write(_occurrences(rows, q, bands, band_rows), "lines", "snappy")  # digests and keys hardly shrink
    roots = components(scratch.write(links(lines, rows, scratch, q=q, similarity=similarity, tile=tile), "links"), scratch)
    place = F.struct("did", "th", "pos")
    met = lines.groupBy("lk").agg(F.count("*").alias("n"))
    named = met.join(roots.withColumnRenamed("node", "lk"), "lk", "left").filter("root is not null or n > 1").select("lk", F.coalesce("root", "lk").alias("root"))
    # only lines that stand several times, or that another one is like, are placed
    placed = scratch.write(lines.select("did", "th", "pos", "lk").join(scratch.write(named, "named"), "lk").select("did", "th", "pos", "root"), "placed")
    firsts = scratch.write(placed.groupBy("root").agg(F.min(place).alias("first")), "firsts")
    gone = placed.join(firsts, "root").filter(place != F.col("first"))
    return scratch.write(gone.groupBy("did", "th").agg(F.collect_set("pos").alias("gone")), "gone")


def _without(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each row."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = prepared(docs, id_col, text_col)
    gone = removals(rows, scratch, **options)

    def of_batch(batch: pa.RecordBatch):
        cut = batch.column(3) if batch.num_columns > 3 else None
        out = {"doc_id": [], "n_lines": [], "n_removed": [], "kept_sha256": []}
        for r in range(batch.num_rows):
            text, did = batch.column(2)[r].as_py(), batch.column(0)[r].as_py()
            bad = set(cut[r].as_py() or ()) if cut is not None else set()
            out["doc_id"].append(None if did == NO_ID else did)
            out["n_lines"].append(text.count("\n") + 1)
            out["n_removed"].append(len(bad))
            out["kept_sha256"].append(hashlib.sha256(_without(text, bad).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()], list(out))

    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string"
    some, done = split_rows(rows, ("did", "th"), gone.select("did", "th"), of_batch, schema)
    joined = some.join(gone.hint("shuffle_hash"), ["did", "th"], "left").select("did", "th", "text", "gone")  # no sort of texts
    return map_arrow(joined, of_batch, schema).union(done)


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """docs with the texts that stay (a null text stays null), and with their lengths in chars_col if named."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removals(prepared(docs, id_col, text_col), scratch, **options)
    some, none = split_rows(keyed(docs, id_col, text_col), KEY, gone.select("did", "th"))
    gone = gone.select(F.col("did").alias(KEY[0]), F.col("th").alias(KEY[1]), F.col("gone").alias("__loom_gone"))
    joined = some.join(gone.hint("shuffle_hash"), list(KEY), "left").select(*docs.columns, "__loom_gone")  # no sort of texts
    at = docs.columns.index(text_col)

    def of_batch(batch: pa.RecordBatch):
        texts = [t if t is None or not g else _without(t, set(g)) for t, g in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)], batch.schema.names[:-1])

    done = map_arrow(joined, of_batch, docs.schema).union(none.select(*docs.columns))
    return done.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else done
