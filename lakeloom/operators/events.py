"""Job and provider events: states, last-N rings, rates, sessions, JSON properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio

RING = 200


def job_state(events: DataFrame, job: str = "user_id") -> DataFrame:
    """Latest event of each job with its counts; ties by the larger event id."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy(job).agg(F.count("*").alias("events"), last.alias("status"), F.max("ts").alias("updated"), F.sum("value").alias("total"))


def progress(events: DataFrame, job: str) -> DataFrame:
    """Events (event_id, index, total) of jobs: how far each has come, its last total, whether it is complete."""
    rows = events.groupBy(job).agg(F.coalesce(F.max("index"), F.lit(0)).alias("completed"), F.max_by("total", F.when(F.col("total").isNotNull(), F.col("event_id"))).alias("total"), F.count("*").alias("events"))
    return rows.withColumn("complete", F.coalesce(F.col("completed") >= F.col("total"), F.lit(False)))


def last_n(events: DataFrame, n: int = RING, job: str = "user_id") -> DataFrame:
    """The last n events of each job with their age rank (1 the newest)."""
    w = Window.partitionBy(job).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def rates(events: DataFrame, by: str = "user_id") -> DataFrame:
    n = F.count("*")
    return events.groupBy(by).agg(n.alias("total"), ratio(F.count_if(F.col("event_type") == "purchase"), n).alias("purchase_rate"), ratio(F.count_if(F.col("event_type") == "click"), n).alias("click_rate"), F.round(F.avg("value"), 3).alias("mean_value"), F.max("value").alias("most"))


def sessions(events: DataFrame, gap_seconds: int, job: str = "user_id") -> DataFrame:
    """Runs of events of a job with no pause over the gap: start, end, events. A pause counts the seconds of the clock that begin in it, not whole ones that passed."""
    w = Window.partitionBy(job).orderBy("ts", "event_id")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    pause = second - F.lag(second).over(w)
    rows = events.withColumn("_s", F.sum(F.coalesce((pause > gap_seconds).cast("int"), F.lit(1))).over(w))
    return rows.groupBy(job, "_s").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events")).drop("_s")


def properties(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
