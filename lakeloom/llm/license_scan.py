"""License scan by diagonal voting.

All rolling word k-grams of every document are hashed and Spark-joined to the positions of license templates. A hit of
word position p on template position t votes for the diagonal p - t: a template standing in a text without edits puts
all its votes on one diagonal, an edited one on neighbouring diagonals. Votes are aggregated by diagonal and
diagonals a few words apart are merged. A span is then verified: its hits are read from the left and from the right, and a hit
counts only if its template position lies beyond all that came before, so each position counts once and only in the template's
order; a span wider than WIDTH templates does not count. Enough of the template's k-grams must count. A hit is a
hit only if the words are equal, not just the hashes.

Defined results: a null text is empty (no words, no labels, score 0); every input row returns one row, repeated rows
and null ids included; columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import ALNUM_WORDS, as_signed, gram_starts, list_array, rolling_hashes, text_slices, word_hashes, words_of
from .shared import map_arrow

#: Words of a hashed k-gram: the length of the shortest template.
GRAM = 3
#: Diagonals at most this many words apart are one span.
SLACK = 6
#: Part of a template's k-grams that a span must hold.
COVERAGE = 0.6
#: Widest span, as a multiple of the template's words.
WIDTH = 2.0
#: Template rows up to which they are broadcast; the library is a parameter, not data.
BROADCAST_ROWS = 200_000

# Fixed values: (name, label, whether it is a base phrase, words).
TEMPLATES = [
    ("base-mit", "mit", True, "under the mit license"),
    ("base-apache-2", "apache-2", True, "apache license version 2"),
    ("base-cc-by-nc", "cc-by-nc", True, "cc by nc"),
    ("mit-released", "mit", False, "released under the mit license"),
    ("mit-grant", "mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2-notice", "apache-2", False, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3-short", "gpl-3", False, "licensed under the gnu general public license version 3"),
    ("gpl-notice", "gpl", False, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-notice", "lgpl", False, "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-notice", "agpl", False, "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd-redistribution", "bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-grant", "isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2-notice", "mpl-2", False, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unlicense", False, "this is free and unencumbered software released into the public domain"),
    ("cc-by-4", "cc-by-4", False, "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4", "cc-by-sa-4", False, "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0", False, "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights"),
]


def _template_rows(templates, k: int):
    rows = []
    for name, label, base, text in templates:
        column = pa.array([text])
        for _, _, buf, off in text_slices(column):
            mapped, starts, ends, _ = words_of(buf, off, ALNUM_WORDS)
            words = text.split()
            assert len(words) == len(starts) >= k, f"template {name} is shorter than {k} words"
            hashes = as_signed(rolling_hashes(word_hashes(mapped, starts, ends), k))
            n = len(hashes)
            rows += [(int(h), name, label, base, n, i, " ".join(words[i : i + k])) for i, h in enumerate(hashes)]
    return rows


def _grams(k: int):
    def of_batch(batch: pa.RecordBatch):
        ids = batch.column(0)
        for lo, hi, buf, off in text_slices(batch.column(1)):
            mapped, starts, ends, first = words_of(buf, off, ALNUM_WORDS)
            hashes = word_hashes(mapped, starts, ends)
            at = gram_starts(first, k)
            grams = rolling_hashes(hashes, k)[at] if len(at) else np.empty(0, np.uint64)
            counts = np.diff(first)
            row = np.repeat(np.arange(hi - lo), counts)
            base = off[:-1][row] if len(row) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(counts, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(mapped.tobytes())]),
                    list_array((starts - base).astype(np.int32), counts, pa.int32()),
                    list_array((ends - starts).astype(np.int32), counts, pa.int32()),
                    list_array(as_signed(grams), np.maximum(counts - k + 1, 0), pa.int64()),
                ],
                ["doc_id", "n_words", "body", "starts", "sizes", "grams"],
            )

    return of_batch


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=None, k: int = GRAM, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """One row per span: row_id, doc_id, n_words, name, label, base, first_word, end_word, coverage, whole.

    Rows without a span have null from name on. `whole` says that all words stand in order on one diagonal.
    """
    spark = docs.sparkSession
    rows = _template_rows(templates or TEMPLATES, k)
    library = spark.createDataFrame(rows, "h long, name string, label string, base boolean, n_grams int, t int, words string")
    if len(rows) <= BROADCAST_ROWS:
        library = F.broadcast(library)
    grams = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _grams(k), "doc_id long, n_words long, body binary, starts array<int>, sizes array<int>, grams array<long>")
    grams = grams.withColumn("row_id", F.monotonically_increasing_id())
    each = grams.select("row_id", "doc_id", "n_words", "body", "starts", "sizes", F.posexplode_outer("grams").alias("p", "gram"))
    hits = each.join(library, F.col("gram") == F.col("h"), "left")
    word = lambda i: F.expr(f"cast(substring(body, starts[p + {i}] + 1, sizes[p + {i}]) as string)")
    same = F.when(F.col("h").isNotNull(), F.concat_ws(" ", *(word(i) for i in range(k))) == F.col("words"))
    hits = hits.withColumn("same", F.coalesce(same, F.lit(False)))
    voted = lambda c: F.when(F.col("same"), F.col(c))
    keys = ["row_id", "doc_id", "n_words"]
    template = ["name", "label", "base", "n_grams"]
    votes = hits.select(*keys, *(voted(c).alias(c) for c in (*template, "t")), F.when(F.col("same"), F.col("p") - F.col("t")).alias("diagonal")).distinct()
    near = Window.partitionBy("row_id", "name").orderBy("diagonal", "t")
    step = F.col("diagonal") - F.lag("diagonal").over(near)
    # a base phrase is looked up as it stands, so its diagonals stay apart
    votes = votes.withColumn("new", F.when(step.isNull() | (step > slack) | (F.col("base") & (step > 0)), 1).otherwise(0))
    full = F.count("t").over(Window.partitionBy("row_id", "name", "diagonal")) == F.col("n_grams")
    placed = votes.withColumns({"span": F.sum("new").over(near), "full": full, "p": F.col("diagonal") + F.col("t")})
    own = Window.partitionBy("row_id", "name", "span")
    ahead, back = (own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("p", F.desc("t")), (F.desc("p"), "t")))
    above, below = F.max("t").over(ahead), F.min("t").over(back)
    placed = placed.withColumns({"l": above.isNull() | (F.col("t") > above), "r": below.isNull() | (F.col("t") < below)})
    at = lambda f, side: f(F.when(F.col(side), F.col("p")))
    spans = placed.groupBy(*keys, *template, "span").agg(
        F.count_if(F.col("l") & F.col("t").isNotNull()).alias("left"),
        F.count_if(F.col("r") & F.col("t").isNotNull()).alias("right"),
        *(at(f, side).alias(f"{side}_{name}") for side in "lr" for name, f in (("first", F.min), ("last", F.max))),
        F.max("full").alias("whole"),
    )
    side = lambda name: F.when(F.col("left") >= F.col("right"), F.col(f"l_{name}")).otherwise(F.col(f"r_{name}"))
    spans = spans.withColumns({"first_word": side("first"), "end_word": side("last") + k})
    fits = F.col("end_word") - F.col("first_word") <= (F.col("n_grams") + k - 1) * WIDTH
    spans = spans.withColumn("coverage", F.when(fits, F.greatest("left", "right") / F.col("n_grams")).otherwise(0.0))
    kept = F.when(F.col("base"), F.col("whole")).otherwise(F.col("coverage") >= coverage)
    out = [F.when(kept, F.col(c)).alias(c) for c in ("name", "label", "base", "first_word", "end_word", "whole")]
    return spans.select(*keys, *out, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def summary(spans: DataFrame) -> DataFrame:
    """One row per document row from the spans of scan()."""
    base = F.col("base") & F.col("whole")
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("row_id", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
            text(F.when(base, F.col("label"))).alias("base_labels"),
            text("label").alias("labels"),
            F.max("coverage").cast("double").alias("score"),
        )
        .drop("row_id")
    )
