"""SimHash near-dedup: fingerprints of word shingles, tiled exact comparison, components.

Two fingerprints within `radius` bits agree on at least two of four 16-bit blocks (for a radius of 2), so each distinct
fingerprint is dealt to the six tables keyed by a pair of blocks. Within a key the fingerprints, in order of their
population count, are compared tile by tile with numpy exclusive-or and bit counts; a tile pair whose population counts
lie further apart than the radius is skipped, as the counts of linked fingerprints differ by at most the radius. Tiles of a key that very many
share go to tasks of their own, pair by pair. This is exact: no link is lost. A tile group yields the links of a spanning forest, never all pairs, and equal fingerprints are compared once.

Defined results: a null or blank text has fingerprint zero and is linked like any other; every row returns one row;
rows with a null id take part and have the component of their fingerprint, an id of null only if no member has one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .kernel import as_signed
from .repeats import prepared
from .shared import KEY, NO_ID, Scratch, components, keyed, map_arrow, split_rows

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints on a side of a tile, and fingerprints of a key from which on its tiles are dealt to many tasks.
TILE, HOT = 1024, 16_384
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PART = 1 << 15


def fingerprint(data: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    parts = data.translate(_LOWER).split() if data else []
    if not parts:
        return 0
    norm = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(norm, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(norm)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(norm[a:b], SEED) for a, b in zip(starts[:n], ends[words - 1 :], strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, n, _PART):
        part = np.array(hashes[i : i + _PART], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """did (NO_ID for a null id), th (hash of the text) and fp (bigint holding the 64 bits) of each row."""

    def of_batch(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2).cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(as_signed(fps))], ["did", "th", "fp"])

    return map_arrow(prepared(docs, id_col, text_col), of_batch, "did long, th long, fp long")


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the groups of linked items one label, the smallest, in place; labels point to items with smaller or their own."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def tile_forest(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """For fingerprints in order of their population count: the index of the smallest one reachable within the group."""
    n = len(fps)
    pops = np.bitwise_count(fps)
    labels = np.arange(n)
    for i in range(0, n, tile):
        for j in range(i, n, tile):
            if int(pops[j]) - int(pops[min(i + tile, n) - 1]) > radius:
                break
            near = np.bitwise_count(fps[i : i + tile, None] ^ fps[None, j : j + tile]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                _hook(labels, a, b)
    return labels


def _compare(radius: int):
    """Over rows (group, pop, fp) sorted by these: links (a, b) that connect the groups' fingerprints."""

    def links(group: np.ndarray):
        roots = tile_forest(group, radius)
        far = np.flatnonzero(roots != np.arange(len(group)))
        return group[far], group[roots[far]]

    def run(batches: Iterator[pa.RecordBatch]):
        key, carried = None, []  # the last group so far, which the next batch may continue
        for batch in batches:
            keys, fps = np.asarray(batch.column(0)), np.asarray(batch.column(2)).view(np.uint64)
            if not len(keys):
                continue
            out = []
            if carried:
                other = np.flatnonzero(keys != key)
                more = int(other[0]) if len(other) else len(keys)
                carried.append(fps[:more])
                keys, fps = keys[more:], fps[more:]
                if not len(keys):
                    continue
                out.append(links(np.concatenate(carried)))
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            out += [links(fps[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(np.diff(cuts[:-1]) > 1)]
            key, carried = keys[-1], [fps[cuts[-2] :]]
            yield from batch_of(out)
        if carried:
            yield from batch_of([links(np.concatenate(carried))])

    def batch_of(pairs):
        if any(len(a) for a, _ in pairs):
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(np.concatenate([p[i] for p in pairs]))) for i in range(2)], ["a", "b"])

    return run


def block_tables(radius: int) -> list[list[tuple[int, int]]]:
    """(shift, bits) of the blocks that key each table: radius+2 blocks, of which two at least agree."""
    count = radius + 2
    cuts = [round(64 * i / count) for i in range(count + 1)]
    blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(count)]
    return [list(pair) for pair in combinations(blocks, 2)]


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp that connect all within the radius.

    The fingerprints of one key are one task's group. A key of more than `hot` is dealt out as pairs of tiles instead, each of one
    population count, and only of counts that differ by the radius at most.
    """
    keys = []
    for blocks in block_tables(radius):
        key, at = F.lit(0).cast("long"), 0
        for shift, bits in blocks:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1), at))
            at += bits
        keys.append(key)
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*keys)).alias("tab", "key"))
    counts = rows.groupBy("tab", "key", "pop").agg(F.count("*").alias("n")).groupBy("tab", "key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / TILE).cast("int")))).alias("tiles"))
    large = scratch.write(counts.filter(F.col("all") > hot).drop("all"), "hot")
    group = F.xxhash64("tab", "key")
    if large.isEmpty():
        dealt = rows.select(group.alias("group"), "pop", "fp")
    else:
        mine = rows.join(large, ["tab", "key"])
        size = lambda p: F.coalesce(F.try_element_at("tiles", p), F.lit(0))
        own = F.struct(F.col("pop"), F.pmod(F.xxhash64("fp"), size(F.col("pop"))).cast("int").alias("tile"))
        near = F.flatten(F.transform(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(size(p) - 1, F.lit(0))), lambda t: t < size(p)), lambda t: F.struct(p.alias("pop"), t.alias("tile")))))
        pairs = F.transform(near, lambda o: F.xxhash64("tab", "key", F.least(own, o), F.greatest(own, o)))
        dealt = rows.join(large, ["tab", "key"], "left_anti").select(group.alias("group"), "pop", "fp").union(mine.select(F.explode(pairs).alias("group"), "pop", "fp"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "pop", "fp")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def groups(fps: DataFrame, radius: int, scratch: Scratch, more: DataFrame | None = None) -> DataFrame:
    """fp, root (smallest fingerprint of its component), component_id (smallest id of it) of the different fingerprints.

    `more`: links (a, b) between fingerprints besides those within the radius.
    """
    named = F.when(F.col("did") != NO_ID, F.col("did"))
    distinct = scratch.write(fps.groupBy("fp").agg(F.min(named).alias("first_id")), "distinct")
    near = links(distinct, scratch, radius)
    roots = components(near if more is None else near.union(more), scratch).select(F.col("node").alias("fp"), "root")
    known = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return scratch.write(known.join(ids, "root").select("fp", "root", "component_id"), "named")


def cluster(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest reachable doc_id) of each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fps")
    return fps.join(groups(fps, radius, scratch), "fp").select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "fp", "component_id")


def alike(docs: DataFrame, fps: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Links (a, b) between fingerprints of documents whose five-word shingles are at least that similar."""
    placed, found = near_copies.links(prepared(docs, id_col, text_col), scratch, similarity=similarity)
    named = scratch.write(placed.join(fps, ["did", "th"]).select("lk", "fp").distinct(), "sets")
    low = named.groupBy("lk").agg(F.min("fp").alias("low"))
    same = named.join(low, "lk").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    a, b = low.select(F.col("lk").alias("a"), F.col("low").alias("x")), low.select(F.col("lk").alias("b"), F.col("low").alias("y"))
    return same.union(found.join(a, "a").join(b, "b").select("x", "y")).filter("a <> b").distinct()


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the smallest id that is not null, of several the smallest text hash.

    With a similarity, documents whose five-word shingles have at least that Jaccard similarity are linked, too.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fps")
    more = alike(docs, fps, scratch, id_col=id_col, text_col=text_col, similarity=similarity) if similarity is not None else None
    found = groups(fps, radius, scratch, more).select("fp", "root")
    member = scratch.write(fps.groupBy("did", "th").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).join(found, "fp"), "members")
    order = F.struct((F.col("did") == NO_ID).alias("unnamed"), "did", "th")
    first = scratch.write(member.groupBy("root").agg(F.min(order).alias("first")), "first")  # a table of its own, so that a join with a large group can be split
    state = member.join(first, "root").select("did", "th", "n", (order == F.col("first")).alias("stays"))
    touched = scratch.write(state.filter("not stays or n > 1").select(F.col("did").alias(KEY[0]), F.col("th").alias(KEY[1]), F.col("stays").alias("__loom_stays")), "touched")
    some, none = split_rows(keyed(docs, id_col, text_col), KEY, touched)
    kept = some.join(touched, list(KEY), "left").filter(F.coalesce("__loom_stays", F.lit(True))).dropDuplicates(list(KEY))
    return kept.select(*docs.columns).union(none.select(*docs.columns))
