"""Conversations: speakers from geometry, merged messages, overlaps between pages, transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_text

OVERLAP = 12


def speaker(box: Column, width: Column, height: Column, text: Column) -> Column:
    """kind, speaker and side of an OCR block (box x1, y1, x2, y2) on a screenshot."""
    x1, x2 = box[0] / F.greatest(width, box[2], F.lit(1.0)), box[2] / F.greatest(width, box[2], F.lit(1.0))
    centre = (x1 + x2) / 2
    tall = F.greatest(height, box[3], F.lit(1.0))
    stamp = text.rlike(r"^(?:(?:上午|下午|凌晨|晚上)?\s*\d{1,2}[:：]\d{2}|昨天\s*\d{1,2}[:：]\d{2}|\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?(?:\s+\d{1,2}[:：]\d{2})?|星期[一二三四五六日天](?:\s*\d{1,2}[:：]\d{2})?)$")
    kind = F.when(box[3] <= tall * 0.08, "chrome").when(box[1] >= tall * 0.90, "chrome").when(stamp, "timestamp").otherwise("message")
    side = F.when(kind != "message", "center").when((centre <= 0.46) | ((x1 <= 0.18) & (x2 < 0.72)), "left").when((centre >= 0.54) | ((x1 > 0.28) & (x2 >= 0.82)), "right").otherwise("unknown")
    who = F.when(kind != "message", "system").when(side == "left", "other").when(side == "right", "me").otherwise("unknown")
    return F.struct(kind.alias("kind"), who.alias("speaker"), side.alias("side"))


def side_confidence(centre: Column, score: Column) -> Column:
    return F.least(F.lit(0.98), 0.68 + 1.1 * F.abs(centre - 0.5), F.coalesce(score, F.lit(1.0)))


def merge_blocks(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Blocks (page, x1, y1, x2, y2, width, text, kind, speaker) of one speaker that follow closely, as one message each.

    Nearness is tested against the message so far, so this is a fold over a page's blocks.
    """

    def of_page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y1", "x1"], kind="stable")
        tall = max(8.0, float((pdf.y2 - pdf.y1).median())) if len(pdf) else 8.0
        out: list[dict] = []
        for b in pdf.to_dict("records"):
            last = out[-1] if out else None
            near = (
                last is not None
                and last["kind"] == b["kind"] == "message"
                and last["speaker"] == b["speaker"] != "unknown"
                and -0.25 * tall <= b["y1"] - last["y2"] <= 0.80 * tall
                and abs(b["x1"] - last["x1"]) <= max(24.0, 0.08 * b["width"])
            )
            if near:
                last |= {"text": f"{last['text']}\n{b['text']}", "n_blocks": last["n_blocks"] + 1, "x1": min(last["x1"], b["x1"]), "y1": min(last["y1"], b["y1"]), "x2": max(last["x2"], b["x2"]), "y2": max(last["y2"], b["y2"])}
            else:
                out.append({k: b[k] for k in (page, "kind", "speaker", "text", "x1", "y1", "x2", "y2")} | {"n_blocks": 1})
        for i, m in enumerate(out):
            m["sequence"] = i + 1
        return pd.DataFrame(out, columns=[page, "sequence", "kind", "speaker", "text", "n_blocks", "x1", "y1", "x2", "y2"])

    kind = dict(blocks.dtypes)[page]
    return blocks.groupBy(page).applyInPandas(of_page, f"{page} {kind}, sequence int, kind string, speaker string, text string, n_blocks int, x1 double, y1 double, x2 double, y2 double")


def merge_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Neighbouring turns of one role as one: conv, first and last turn, role, text."""
    w = Window.partitionBy(conv).orderBy(order)
    new = F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True))
    rows = turns.withColumn("_run", F.sum(new.cast("int")).over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return rows.groupBy(conv, "_run").agg(F.min(order).alias("first_turn"), F.max(order).alias("last_turn"), F.first("role").alias("role"), F.array_join(texts, "\n").alias("text")).drop("_run")


def renumbered(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    number = F.row_number().over(Window.partitionBy(conv).orderBy(order))
    return turns.withColumn("message_id", F.format_string("msg-%06d", number))


def transcript(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    line = F.concat(F.lit("**"), F.col("role"), F.lit(":** "), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    return turns.groupBy(conv).agg(F.count("*").alias("turns"), F.array_join(ordered, "\n\n").alias("transcript"))


def page_overlap(previous: Column, current: Column, limit: int = OVERLAP) -> Column:
    """Longest end of one list of message keys that begins the next list, up to a limit; a single key counts from 12 characters."""
    sizes = F.sequence(F.least(F.lit(limit), F.size(previous), F.size(current)), F.lit(1), F.lit(-1))
    last = F.try_element_at(previous, F.lit(-1))
    equal = lambda n: (F.slice(previous, F.size(previous) - n + 1, n) == F.slice(current, F.lit(1), n)) & ((n >= 2) | (F.length(last) >= 12))
    found = F.try_element_at(F.filter(sizes, equal), F.lit(1))
    return F.when((F.size(previous) > 0) & (F.size(current) > 0), F.coalesce(found, F.lit(0))).otherwise(0)


def message_key(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), normal_text(F.coalesce(text, F.lit(""))))
