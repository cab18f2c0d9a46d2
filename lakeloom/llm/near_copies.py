"""Links between documents whose sets of word shingles have a Jaccard similarity of at least a limit; no such link is lost.

Two sets that similar share a shingle among the first n - ceil(limit * n) + 1 of each (n: its size), whatever order all shingles
are in (prefix filter). The order puts those that many sampled documents hold last, so that common phrasing seldom makes
candidates; the sample bears on speed only. Documents are scanned once for these prefixes; only those that share a
shingle of it with another, and whose prefixes have enough in common for the limit, are scanned for whole sets, which are
compared exactly, in tiles that yield a spanning forest.

Shingles are 64-bit hashes of runs of words with A-Z lower-cased; a text of fewer words is one shingle, one without words none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED_LOWER_WORDS, as_signed, gram_starts, list_array, rolling_hashes, text_slices, word_hashes, words_of
from .repeats import digest
from .shared import Scratch, key_filter, load_filter, map_arrow, passes

WORDS = 5
SIMILARITY = 0.8
#: Documents on a side of a tile.
TILE = 512
#: Documents sampled for the order of the shingles, and most shingles that it puts last.
SAMPLE, COMMON = 20_000, 100_000


def sets(column: pa.Array, words: int):
    """(row, sorted different shingles) of the texts that have words."""
    for lo, hi, buf, off in text_slices(column):
        mapped, starts, ends, first = words_of(buf, off, SPACED_LOWER_WORDS)
        hashes = word_hashes(mapped, starts, ends)
        at = gram_starts(first, words)
        grams = rolling_hashes(hashes, words)[at] if len(at) else np.empty(0, np.uint64)
        cuts = np.searchsorted(at, first)
        for r in range(hi - lo):
            count = int(first[r + 1] - first[r])
            if count >= words:
                yield lo + r, np.unique(grams[cuts[r] : cuts[r + 1]])
            elif count:
                yield lo + r, rolling_hashes(hashes[first[r] : first[r + 1]], count)


def prefix(grams: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a similar set shares one; those of `common` (sorted) come last, by their ranks."""
    n = len(grams) - math.ceil(similarity * len(grams) - 1e-9) + 1
    if not len(common):
        return grams[:n]
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    return grams[np.lexsort((grams, np.where(common[at] == grams, ranks[at], 0)))[:n]]


def _common(rows: DataFrame, words: int) -> DataFrame:
    """g, c: shingles that stand in several of the sampled documents, the most common COMMON of them."""

    def of_batch(batch: pa.RecordBatch):
        found = [g for _, g in sets(batch.column(0), words)]
        if found:
            g, c = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(g)), pa.array(c)], ["g", "c"])

    share = SAMPLE / max(rows.count(), SAMPLE)
    some = rows if share == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(3), "did", "th"), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = map_arrow(some.select("text"), of_batch, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    return counts.filter("c > 2").orderBy(F.desc("c"), "g").limit(COMMON)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b) - 1e-9:
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def forest(keys: list[bytes], found: list[np.ndarray], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that connect the similar sets, a spanning forest: a set is compared with a component until one member is similar."""
    parts: list[list[int]] = []
    out, seen = [], set()
    for i in sorted(range(len(keys)), key=lambda i: (len(found[i]), keys[i])):
        if keys[i] in seen:
            continue
        seen.add(keys[i])
        apart, mine = [], [i]
        for part in parts:
            for j in reversed(part):
                if len(found[j]) < similarity * len(found[i]) - 1e-9:
                    apart.append(part)  # the others are no larger
                    break
                if similar(found[j], found[i], similarity):
                    out.append((keys[i], keys[j]))
                    mine = part + mine
                    break
            else:
                apart.append(part)
        mine.sort(key=lambda x: (len(found[x]), keys[x]))
        parts = [p for p in apart if len(found[p[-1]]) >= similarity * len(found[i]) - 1e-9] + [mine]
    return out


def plausible(sizes: list[int], found: list[np.ndarray], similarity: float) -> list[int]:
    """Which sets may have a similar one among the others, by their sizes and (sorted) prefixes.

    What two sets have in common stands in both prefixes, or behind that prefix which ends first in the order of the shingles.
    """
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    behind = [n - len(f) for n, f in zip(sizes, found, strict=True)]
    keep = set()
    for at, i in enumerate(order):
        for j in reversed(order[:at]):
            if sizes[j] < similarity * sizes[i] - 1e-9:
                break  # the others are no larger
            if i in keep and j in keep:
                continue
            a, b = found[j], found[i]
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if (common + max(behind[i], behind[j])) * (1 + similarity) >= similarity * (sizes[i] + sizes[j]) - 1e-9:
                keep |= {i, j}
    return sorted(keep)


def _sift(similarity: float):
    """Rows (g, t0, t1, lk, n, prefix) in the order of the first three -> those (g, t0, t1, lk) that may have a similar one beside them."""

    def run(batches):
        rows, sizes, found, last, out = [], [], [], None, []
        for batch in batches:
            names = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for r, (*at, lk, n) in enumerate(names):
                if at != last:
                    out += [rows[i] for i in plausible(sizes, found, similarity)]
                    rows, sizes, found, last = [], [], [], at
                rows.append((*at, lk))
                sizes.append(n)
                found.append(np.sort(np.asarray(batch.column(5)[r].values).view(np.uint64)))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out + [rows[i] for i in plausible(sizes, found, similarity)])

    def batch_of(rows):
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["g", "t0", "t1", "lk"])

    return run


def _verify(similarity: float):
    """Rows (g, t0, t1, lk, grams) in the order of the first three -> links (a, b), pair of tiles by pair."""

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

    def run(batches):
        keys, found, last, out = [], [], None, []
        for batch in batches:
            names = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for r, (*at, lk) in enumerate(names):
                if at != last:
                    out += forest(keys, found, similarity)
                    keys, found, last = [], [], at
                keys.append(lk)
                found.append(np.array(batch.column(4)[r].values).view(np.uint64))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out + forest(keys, found, similarity))

    return run


def _once(members: DataFrame, bucket: list[str]) -> DataFrame:
    """Members (lk and the columns that name a bucket) of one of the buckets that have the same members, and n, their number."""
    marks = members.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("lk"), 32)).alias("mark"), F.bit_xor(F.xxhash64(F.lit(1), "lk")).alias("mark2"))
    one = marks.groupBy("n", "mark", "mark2").agg(F.min(F.struct(*bucket)).alias("b")).select("b.*", "n")
    return members.join(one, bucket)


def links(rows: DataFrame, scratch: Scratch, *, words: int = WORDS, similarity: float = SIMILARITY, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """For rows did, th, text: did, th, lk (digest of the set) of each, and links (a, b) that connect all similar sets."""
    order = _common(rows, words).toArrow()
    by = np.argsort(np.asarray(order.column("g")).view(np.uint64))
    ranks = rows.sparkSession.sparkContext.broadcast((np.asarray(order.column("g")).view(np.uint64)[by], np.asarray(order.column("c"))[by]))

    def prefixes(batch: pa.RecordBatch):
        row, sizes, keys, found = [], [], [], []
        for r, grams in sets(batch.column(2), words):
            row.append(r)
            sizes.append(len(grams))
            keys.append(digest(grams.tobytes()))
            found.append(prefix(grams, similarity, *ranks.value))
        if row:
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), list_array(as_signed(np.concatenate(found)), np.array([len(f) for f in found]), pa.int64())], ["did", "th", "lk", "n", "prefix"])

    placed = scratch.write(map_arrow(rows.select("did", "th", "text"), prefixes, "did long, th long, lk binary, n int, prefix array<long>"), "prefixes")
    pairs = placed.select("lk", F.explode("prefix").alias("g"))
    short = F.xxhash64("lk")
    shared = scratch.write(pairs.groupBy("g").agg(F.min(short).alias("x"), F.max(short).alias("y")).filter("x <> y").select("g"), "shared")
    held = key_filter(shared, "g")

    def hot(batch: pa.RecordBatch):
        yield batch.filter(pa.array(passes(np.asarray(batch.column(1)), load_filter(held))))

    members = scratch.write(map_arrow(pairs, hot, "lk binary, g long").join(shared, "g", "left_semi").distinct(), "members")
    members = scratch.write(_once(members, ["g"]), "buckets")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(2), "lk"), tiles).cast("int")
    dealt = members.select("lk", "g", mine.alias("t"), tiles.alias("tiles")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lk", "g", F.least("t", "o").alias("t0"), F.greatest("t", "o").alias("t1"))
    known = placed.join(members.select("lk").distinct(), "lk", "left_semi").select("lk", F.col("n").alias("size"), "prefix").dropDuplicates(["lk"])
    tiled = dealt.join(known, "lk").select("g", "t0", "t1", "lk", "size", "prefix").repartition("g", "t0", "t1").sortWithinPartitions("g", "t0", "t1")
    dealt = scratch.write(tiled.mapInArrow(_sift(similarity), "g long, t0 int, t1 int, lk binary"), "sifted")
    dealt = scratch.write(_once(dealt, ["g", "t0", "t1"]).drop("n"), "dealt")

    wanted = placed.select("did", "th", "lk").join(dealt.select("lk").distinct(), "lk", "left_semi").groupBy("lk").agg(F.min(F.struct("did", "th")).alias("r"))
    wanted = scratch.write(wanted, "wanted")
    read = key_filter(wanted.select(F.xxhash64("r.did", "r.th").alias("k")), "k")

    def wholes(batch: pa.RecordBatch):
        hit = batch.filter(pa.array(passes(np.asarray(batch.column(1)), load_filter(read))))
        found = [g for _, g in sets(hit.column(0), words)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([digest(g.tobytes()) for g in found], pa.binary()), list_array(as_signed(np.concatenate(found)), np.array([len(g) for g in found]), pa.int64())], ["lk", "grams"])

    whole = map_arrow(rows.select("text", F.xxhash64("did", "th").alias("k")), wholes, "lk binary, grams array<long>").dropDuplicates(["lk"])
    tiled = dealt.join(whole, "lk").select("g", "t0", "t1", "lk", "grams").repartition("g", "t0", "t1").sortWithinPartitions("g", "t0", "t1")
    found = scratch.write(tiled.mapInArrow(_verify(similarity), "a binary, b binary").distinct(), "alike")
    return placed.select("did", "th", "lk"), found
