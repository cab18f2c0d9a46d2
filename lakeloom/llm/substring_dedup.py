"""Substring dedup with a log-structured fingerprint index.

The index holds the window fingerprints (anchors, see repeats.py) of all history in immutable runs, each hash-partitioned and sorted
by fingerprint, one file a bucket, so that runs meet in merge joins without being exchanged or sorted again. A new batch of documents
becomes a run of its own; before it is added it is merge-joined with the older runs to find the fingerprints it shares with them. Runs
of one level are compacted into one of the next. Candidates are then verified by digests of whole windows, and a word goes if a
window over it starts in a document with a smaller id, too.

An index in a folder lasts: a manifest names its runs and the documents behind them, a later call opens it and judges its documents
against all that came before. Of history only the documents that share a fingerprint are read again.

Defined results: a null text has no words; a document with a null id neither loses words nor makes others lose some;
rows that repeat an id are one document to others and none loses words to the other; every row returns one row;
an empty table gives an empty result; other columns are ignored. With an index, documents of earlier calls are not judged anew, and
ids that come again belong to the document that they came with first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import NO_ID, Units, anchor_counts, contents, finish, placements, prepared, window_digests
from .shared import Scratch

WINDOW = 50
GRAM = 16
#: Batches into which a whole table is cut, by document id.
BATCHES = 3
#: Runs of a level that are compacted into one of the next.
FANOUT = 2


class FingerprintIndex:
    """Sorted immutable runs (fp, did) in a folder, newest last, and the documents (did, th, text) behind them."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        self.runs: list[tuple[int, str, int]] = []  # level, path, buckets
        self.documents: list[str] = []
        self.named: set[str] = set()  # paths in a manifest
        self.made = 0
        self._open()

    def _files(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def _open(self) -> None:
        """Reads the newest manifest that was written whole."""
        known = self._files("manifest-*/_SUCCESS")
        if known:
            self.made = int(known[-1].rsplit("-", 1)[1])
            for r in self.spark.read.parquet(known[-1]).orderBy("ordinal").collect():  # a row for each run and batch
                self.named.add(r.path)
                if r.kind == "run":
                    self.runs.append((r.level, r.path, r.buckets))
                else:
                    self.documents.append(r.path)

    def commit(self, documents: DataFrame) -> None:
        """Adds the documents of the batches since the last commit and writes the manifest that makes all of it part of the index."""
        path = f"{self.folder}/documents-{uuid.uuid4().hex[:12]}"
        documents.select("did", "th", "text").repartitionByRange("did").sortWithinPartitions("did").write.option("compression", "zstd").parquet(path)
        self.documents.append(path)
        self.made += 1
        rows = [(i, "run", level, path, buckets) for i, (level, path, buckets) in enumerate(self.runs)] + [(len(self.runs) + i, "documents", 0, path, 0) for i, path in enumerate(self.documents)]
        table = self.spark.createDataFrame(rows, "ordinal int, kind string, level int, path string, buckets int")
        table.coalesce(1).write.parquet(f"{self.folder}/manifest-{self.made:06d}")
        self.named |= {r[3] for r in rows}

    def _write(self, pairs: DataFrame, level: int) -> tuple[int, str, int]:
        path, name = f"{self.folder}/run-{level}-{uuid.uuid4().hex[:12]}", f"lakeloom_run_{uuid.uuid4().hex[:12]}"
        # the same hash as the buckets', so each is one sorted file
        dealt = pairs.repartition(self.buckets, "fp")
        dealt.write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name, format="parquet")
        self.tables[path] = name
        run = (level, path, self.buckets)
        self.runs.append(run)
        return run

    def read(self, run: tuple[int, str, int]) -> DataFrame:
        """A run as a bucketed table."""
        _, path, buckets = run
        if path not in self.tables:
            name = f"lakeloom_run_{uuid.uuid4().hex[:12]}"
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, did BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def add(self, pairs: DataFrame) -> DataFrame:
        """Adds a batch (fp, did, may repeat); returns the fingerprints that it shares with history or within itself."""
        older = list(self.runs)
        run = self.read(self._write(pairs.distinct(), 0))
        ends = lambda df: df.groupBy("fp").agg(F.min("did").alias("lo"), F.max("did").alias("hi"))
        mine = ends(run)
        shared = mine.filter("lo < hi").select("fp")
        for past in older:
            both = mine.hint("merge").join(ends(self.read(past)).select("fp", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "fp")
            shared = shared.union(both.filter(F.least("lo", "lo2") < F.greatest("hi", "hi2")).select("fp"))
        return shared.distinct()

    def holders(self, shared: DataFrame, runs: list[tuple[int, str, int]]) -> DataFrame:
        """Documents (did) of the runs that have one of the fingerprints."""
        rows = None
        for run in runs:
            found = self.read(run).join(shared, "fp", "left_semi").select("did")
            rows = found if rows is None else rows.union(found)
        return rows.distinct()

    def compact(self) -> None:
        """Merges the runs of each level that has `fanout` of them, and deletes the old ones that no manifest names."""
        level = 0
        while any(lv >= level for lv, *_ in self.runs):
            old = [r for r in self.runs if r[0] == level]
            if len(old) >= self.fanout:
                rows = self.read(old[0])
                for r in old[1:]:
                    rows = rows.union(self.read(r))
                self.runs = [r for r in self.runs if r[0] != level]
                self._write(rows.distinct(), level + 1)
                for _, path, _ in old:
                    if path not in self.named:
                        self._drop(path)
            level += 1

    def _drop(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path, 'lakeloom_none')}")
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)

    def close(self) -> None:
        """Forgets the tables of this session; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def repeated_spans(rows: DataFrame, units: Units, batches: int, scratch: Scratch, index: FingerprintIndex) -> DataFrame:
    """Spans (did, th, b0, b1) of the words covered by windows that start in a document with a smaller id, too."""
    spark = rows.sparkSession
    before, stored = list(index.runs), list(index.documents)
    named = rows.filter(F.col("did") != NO_ID)
    cuts = named.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    shared = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = named
        batch = batch if low is None else batch.filter(F.col("did") > low)
        batch = batch if high is None else batch.filter(F.col("did") <= high)
        found = scratch.write(index.add(anchors(batch, units)), "shared")
        shared = found if shared is None else shared.union(found)
        index.compact()
    shared = scratch.write(shared.distinct(), "shared")
    if stored:
        wanted = scratch.write(index.holders(shared, before), "holders")
        past = spark.read.parquet(*stored).join(wanted, "did", "left_semi").join(named.select("did").distinct(), "did", "left_anti")
        named = named.union(past.select("did", "th", "text"))
    placed = placements(named, shared, units, scratch)
    rep = F.min(F.struct("did", "th", "s", "n")).alias("rep")
    kinds = placed.groupBy("fp", "sw").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), rep)
    per_anchor = kinds.groupBy("fp").agg(F.min("lo").alias("first"), F.count("*").alias("kinds"))
    kinds = scratch.write(kinds.join(per_anchor, "fp"), "kinds")
    # whole stretches that stand in a smaller document
    known = kinds.filter("lo < hi").select("fp", "sw", "lo")
    decided = placed.join(known, ["fp", "sw"]).filter("did > lo").select("did", "th", F.col("s").alias("b0"), (F.col("s") + F.col("n") - 1 + units.window).alias("b1"))
    # single windows of stretches that share only their anchor with others
    reps = kinds.filter("kinds > 1").select("rep.*", "sw", "lo", (F.col("lo") > F.col("first")).alias("asks"))
    table = contents(named, reps, units, scratch)
    each = scratch.write(window_digests(table, units, ["sw", "lo", "asks"]), "windows")
    least = each.groupBy("wh").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most")
    late = each.filter("asks").join(least, "wh").filter("least < lo").groupBy("sw", "lo").agg(F.collect_set("x").alias("xs"))
    placed_late = placed.join(late.withColumnRenamed("lo", "did"), ["sw", "did"])
    single = placed_late.select("did", "th", "s", F.explode("xs").alias("x")).select("did", "th", (F.col("s") + F.col("x")).alias("b0"), (F.col("s") + F.col("x") + units.window).alias("b1"))
    return scratch.write(decided.union(single), "spans")


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    """fp, did of the anchors of documents; may repeat."""
    return anchor_counts(rows, units, with_id=True)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, texts_too: bool = False, index: str | None = None) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept_sha256, n_elsewhere (0) (and kept) of each row.

    index: a folder that all executors share, in which the index of earlier calls is and to which these documents are added.
    """
    units = Units(window, gram, True)
    scratch = Scratch(docs.sparkSession, "substring")
    rows = prepared(docs, id_col, text_col)
    held = FingerprintIndex(docs.sparkSession, index or scratch.path("index"))
    spans = repeated_spans(rows, units, batches, scratch, held)
    if index:
        held.commit(rows.filter(F.col("did") != NO_ID))
    held.close()
    return finish(rows, spans, units, scratch, texts_too)
