"""Embedding arithmetic in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(vectors: DataFrame, vec_id: int, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar vectors of one, of several rows with that id the smallest vector; the query is one row, the top k a bounded heap."""
    one = F.broadcast(vectors.filter(F.col(id_col) == vec_id).agg(F.min(vector).alias("_q")))
    rows = vectors.filter(F.col(id_col) != vec_id).join(one)
    return rows.select(id_col, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)
