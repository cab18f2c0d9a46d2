"""Review of converted documents: manual records, checklist, dispositions and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dispositions in the order in which they are to be worked on.
ORDER = ("failed_retry", "rerun_or_manual_review", "manual_review", "review_before_accept", "accept_manual", "accept")


def merge_manual(entries: DataFrame, manual: DataFrame, key: str, order: str) -> DataFrame:
    """entries with the last manual record of their key: human_status, human_score; a left join on the key."""
    last = manual.groupBy(key).agg(F.max_by(F.struct("human_status", "human_score"), order).alias("m"))
    return entries.join(last.select(key, "m.human_status", "m.human_score"), key, "left")


def on_checklist(entries: DataFrame) -> DataFrame:
    """Entries that a person is to look at: not accepted, and failed, of low level, or scanned."""
    c = F.col
    due = (c("status") == "failed") | c("level").isin("review", "poor") | F.coalesce(c("scanned_likely"), F.lit(False))
    return entries.filter((F.coalesce(c("human_status"), F.lit("")) != "accepted") & F.coalesce(due, F.lit(False)))


def disposition(entries: DataFrame, listed: str = "listed") -> DataFrame:
    """entries (with a flag whether they are on the checklist) and their disposition and its rank."""
    c = F.col
    human = F.coalesce(c("human_status"), F.lit(""))
    out = (
        F.when(human == "accepted", "accept_manual")
        .when(human == "review", "manual_review")
        .when(c("status") == "failed", "failed_retry")
        .when(c("level") == "poor", "rerun_or_manual_review")
        .when(c(listed) & F.coalesce(c("scanned_likely"), F.lit(False)), "manual_review")
        .when(c(listed), "review_before_accept")
        .otherwise("accept")
    )
    rank = F.array_position(F.array(*(F.lit(x) for x in ORDER)), F.col("decision")) - 1
    return entries.withColumn("decision", out).withColumn("decision_rank", rank.cast("int"))
