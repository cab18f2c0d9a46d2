"""Scratch tables, size-bounded filters and components that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import as_signed, mix64


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one is made if all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext.getCheckpointDir()
        if not set_dir:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
            set_dir = spark.sparkContext.getCheckpointDir()
        root = set_dir
    return root.rstrip("/")


class Scratch:
    """Tables of one run, written in the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/lakeloom-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        small_batches(spark)

    def write(self, df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, count: int) -> None:
        """Deletes the table that write() made as the count-th."""
        self.delete(f"{self.root}/{name}-{count}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def delete(self, path: str) -> None:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: Least and most bits of a prefilter, and bits for each key in between: what is broadcast has a bound. A filter that is too
#: small for its keys lets more rows through to the exact join behind it and loses none.
LEAST_BITS, MOST_BITS, KEY_BITS = 1 << 18, 1 << 28, 16


def filter_bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each 64-bit key."""
    h = mix64(keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def key_filter(df: DataFrame, column: str, most: int = MOST_BITS):
    """A broadcast bitmap in which every key of the column (bigint) has its two bits set. df is counted, so it should be a written table."""
    spark = df.sparkSession
    bits = min(most, max(LEAST_BITS, 1 << (KEY_BITS * max(1, df.count()) - 1).bit_length()))

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = filter_bits(np.asarray(b.column(0).drop_null()), bits)
            at = np.unique(np.concatenate([a, c]))
            if len(at):
                word, where = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), where)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(as_signed(value))], ["w", "v"])

    rows = df.select(F.col(column).cast("long")).mapInArrow(to_words, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    table = np.zeros(bits >> 6, np.uint64)
    got = rows.toArrow()
    table[np.asarray(got.column("w"))] = np.asarray(got.column("v")).view(np.uint64)
    return spark.sparkContext.broadcast(table.tobytes())


def passes(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    a, c = filter_bits(keys, len(table) << 6)
    one = np.uint64(1)
    return ((table[a >> 6] >> (a & 63).astype(np.uint64)) & (table[c >> 6] >> (c & 63).astype(np.uint64)) & one) > 0


def load_filter(broadcast) -> np.ndarray:
    return np.frombuffer(broadcast.value, np.uint64)


#: Names of the key columns beside a table's own columns.
KEY = ("__loom_did", "__loom_th")
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with KEY: the id (NO_ID for null) and a hash of the text, which name a row and its exact repetitions."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({KEY[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), KEY[1]: F.xxhash64(text)})


def split_rows(df: DataFrame, columns: tuple[str, str], wanted: DataFrame, then=None, schema=None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among those of `wanted` (two columns), and those whose key is surely not, all columns kept.

    The filter has a bounded size, and only rows that a join is to change are shuffled by it. `then` maps the batches of the
    second kind to `schema` in the same pass. `wanted` should be a written table.
    """
    held = key_filter(wanted.select(F.xxhash64(*wanted.columns[:2]).alias("k")), "k")
    marked = df.withColumn("__loom_k", F.xxhash64(*columns))

    def side(want: bool):
        def of_batch(batch: pa.RecordBatch):
            hit = passes(np.asarray(batch.column(batch.num_columns - 1)), load_filter(held))
            kept = batch.filter(pa.array(hit == want)).select(list(range(batch.num_columns - 1)))
            if want or then is None:
                yield kept
            elif kept.num_rows:
                yield from then(kept)

        return map_arrow(marked, of_batch, df.schema if want or then is None else schema)

    return side(True), side(False)


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose key is in bad (did, th)."""
    rows = keyed(docs, id_col, text_col)
    some, none = split_rows(rows, KEY, bad)
    bad = bad.select(F.col(bad.columns[0]).alias(KEY[0]), F.col(bad.columns[1]).alias(KEY[1])).distinct()
    return some.join(bad, list(KEY), "left_anti").select(none.columns).union(none).drop(*KEY)


#: Edges that a task contracts at once.
CONTRACT = 200_000


def _contracted():
    """Edges (u, v) -> for each CONTRACT of them, edges from their nodes to the smallest one that they reach through these."""

    def stars(root: dict, types):
        for x in list(root):
            r = x
            while root[r] != r:
                r = root[r]
            while root[x] != r:
                root[x], x = r, root[x]
        pairs = [(x, r) for x, r in root.items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], types[0]), pa.array([r for _, r in pairs], types[1])], ["u", "v"])

    def run(batches):
        root, n, types = {}, 0, None
        for batch in batches:
            types = (batch.schema.field(0).type, batch.schema.field(1).type)
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for z in (x, y):
                    root.setdefault(z, z)
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x < y:
                    root[y] = x
                elif y < x:
                    root[x] = y
            n += batch.num_rows
            if n >= CONTRACT:
                yield stars(root, types)
                root, n = {}, 0
        if root:
            yield stars(root, types)

    return run


def _settled(e: DataFrame) -> bool:
    """Whether the edges (u, v), v the smaller, are stars: no node has two edges to smaller ones, or one and edges to larger ones."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b) of bigint, string or binary: (node, root), root the smallest reachable node.

    Distributed union-find: tasks first contract the edges that they hold, then large-star and small-star steps alternate until the
    edges are stars, about as many rounds as the logarithm of the largest component's diameter. Each round is two aggregations with
    partial sums and two equi-joins, which adaptive execution splits where a node has very many neighbours. Nodes without an edge to
    another node are absent. The edges of each round are a written table, so lineage stays short; older ones are deleted.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    e, was = scratch.write(pairs.repartition("v").mapInArrow(_contracted(), pairs.schema), "edges"), scratch.count
    while not _settled(e):
        # large-star: each larger neighbour links to the smallest of the closed neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: the smaller neighbours and the node itself link to the smallest
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        e, old, was = scratch.write(small.filter("u <> v").distinct(), "edges"), was, scratch.count
        scratch.drop("edges", old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct()


#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults: texts are long rows, and a worker, its JVM
#: buffers and the copies in between each hold a batch or two.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def small_batches(spark: SparkSession) -> None:
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def map_arrow(df: DataFrame, func: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from func(b)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
