"""Vector functions on array columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pooled(df: DataFrame, key: str, vector: str = "vector", how: str = "mean") -> DataFrame:
    """(key, pos, value): mean or max by coordinate over a key's vectors, divided by the pooled vector's length.

    Long form: a partial aggregate runs before the shuffle, so a key with many vectors sends few rows.
    """
    each = df.select(key, F.posexplode(vector).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    value = (F.avg if how == "mean" else F.max)(F.col("x").cast("double")).alias("value")
    flat = each.groupBy(key, "pos").agg(value)
    length = flat.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    return flat.join(length, key).select(key, "pos", F.when(F.col("length") == 0, F.col("value")).otherwise(F.col("value") / F.col("length")).alias("value"))


def pooled_arrays(df: DataFrame, key: str, vector: str = "vector", how: str = "mean") -> DataFrame:
    """(key, vector) of pooled()."""
    flat = pooled(df, key, vector, how)
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vector"))
