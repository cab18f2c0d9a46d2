"""Structured Streaming: incremental scoring of arriving documents, job states, windowed rates, resume by content."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def score_arriving(spark: SparkSession, inbox: str, outbox: str, checkpoint: str):
    """Scores the Parquet documents that arrive in a folder into another; the checkpoint makes it resume exactly there."""
    docs = spark.readStream.schema(DOCUMENT).parquet(inbox)
    scored = quality.scored(docs).select("doc_id", "characters", "headings", "score", "level")
    return scored.writeStream.format("parquet").option("path", outbox).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_documents(docs: DataFrame, seen_for: str = "1 day", time: str = "arrived") -> DataFrame:
    """Streamed documents whose text has not come within the watermark; its state is bounded by the watermark."""
    return docs.withColumn("sha256", F.sha2(F.col("text"), 256)).withWatermark(time, seen_for).dropDuplicatesWithinWatermark(["sha256"])


def rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Windowed counts and failure shares of streamed events; later events than the watermark are dropped."""
    timed = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return timed.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return timed.agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def job_states(spark: SparkSession, inbox: str, table: str, checkpoint: str):
    """Keeps the latest state of each job in a folder: `states(spark, table)` reads it.

    Each micro-batch is summed up by job, merged with the version before and written as the version of its number, so a batch that is
    run again writes the same; nothing is gathered in the driver. The two newest versions stay.
    """
    events = spark.readStream.schema(EVENT).parquet(inbox)

    def upsert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        mine = batch.groupBy("user_id").agg(F.count("*").alias("events"), F.max(F.struct("ts", "event_id", F.col("event_type").alias("status"))).alias("last"))
        known = _versions(session, table, number)
        rows = mine if not known else mine.unionByName(session.read.parquet(known[-1]))
        merged = rows.groupBy("user_id").agg(F.sum("events").alias("events"), F.max("last").alias("last"))
        merged.write.mode("overwrite").parquet(f"{table}/version-{number:09d}")
        for old in known[:-1]:
            _delete(session, old)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, table: str, before: int | None = None) -> list[str]:
    """Whole versions of a state table in their order, those before a number if given."""
    path, fs = _path(spark, f"{table}/version-*/_SUCCESS")
    names = sorted(x.getPath().getParent().toString() for x in fs.globStatus(path) or [])
    return [n for n in names if before is None or int(n.rsplit("-", 1)[1]) < before]


def _delete(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def states(spark: SparkSession, table: str) -> DataFrame:
    """user_id, events, status, updated of each job."""
    return spark.read.parquet(_versions(spark, table)[-1]).select("user_id", "events", F.col("last.status").alias("status"), F.col("last.ts").alias("updated"))


def timed(convert: Callable[[str, bytes], str], seconds: float) -> Callable[[str, bytes], tuple[str, str, str]]:
    """A converter with its status: ok, failed or timeout, and a message. A late one is left behind in a thread of its own."""

    def run(path: str, content: bytes) -> tuple[str, str, str]:
        box: list[tuple[str, str, str]] = []

        def work():
            try:
                box.append(("ok", convert(path, content), ""))
            except Exception as e:  # a converter may fail in any way; the row says how
                box.append(("failed", "", f"{type(e).__name__}: {e}"))

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(seconds)
        return box[0] if box else ("timeout", "", f"no result in {seconds:g} s")

    return run


def convert_arriving(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, convert: Callable[[str, bytes], str], *, seconds: float = 120.0, glob: str = "*"):
    """A conversion job: the files that arrive in a folder, converted one by one, with status and message; it resumes where it ended."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(inbox)
    run = timed(convert, seconds)

    def of_batches(batches):
        for b in batches:
            found = [run(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], ["source", "status", "text", "message"])

    rows = files.select("path", "content").mapInArrow(of_batches, "source string, status string, text string, message string")
    return rows.writeStream.format("parquet").option("path", outbox).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
