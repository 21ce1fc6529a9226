"""Agreement and relevance metrics over ranked tables (query_id, item, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard_at_k(a: Column, b: Column, k: int) -> Column:
    """Overlap of two arrays' first k items; 1.0 if both are empty."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def kendall_tau(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, tau) over the items that both rankings have; null below two of them.

    Rankings are short lists, so the pairs of one query's common items are few.
    """
    common = a.select("query_id", "item", F.col("rank").alias("ra")).join(b.select("query_id", "item", F.col("rank").alias("rb")), ["query_id", "item"])
    lists = common.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("x"))
    n = F.size("x")
    signs = F.transform(F.col("x"), lambda p, i: F.aggregate(F.slice(F.col("x"), i + 2, F.size("x")), F.lit(0).cast("long"), lambda s, q: s + F.signum((q["rb"] - p["rb"]).cast("double")).cast("long")))
    total = F.aggregate(signs, F.lit(0).cast("long"), lambda s, x: s + x)
    return lists.select("query_id", F.when(n >= 2, total / (n * (n - 1) / 2)).alias("tau"))


def rank_biased_overlap(a: DataFrame, b: DataFrame, p: float = 0.9) -> DataFrame:
    """(query_id, rbo), extrapolated for lists of uneven length; both empty cannot occur, one empty gives 0.0."""
    lengths = a.groupBy("query_id").agg(F.max("rank").cast("int").alias("la")).join(b.groupBy("query_id").agg(F.max("rank").cast("int").alias("lb")), "query_id", "full")
    hits = a.select("query_id", "item", F.col("rank").alias("ra")).join(b.select("query_id", "item", F.col("rank").alias("rb")), ["query_id", "item"])
    depths = hits.groupBy("query_id").agg(F.collect_list(F.greatest("ra", "rb").cast("int")).alias("at"))
    r = lengths.join(depths, "query_id", "left").withColumns({"at": F.coalesce("at", F.array().cast("array<int>")), "s": F.least("la", "lb"), "l": F.greatest("la", "lb")})
    x = lambda d: F.size(F.filter("at", lambda q: q <= d)).cast("double")
    s, l = F.col("s"), F.col("l")
    power = lambda d: F.pow(F.lit(p), d.cast("double"))
    first = F.aggregate(F.sequence(F.lit(1), l), F.lit(0.0), lambda acc, d: acc + x(d) / d * power(d))
    uneven = F.when(l > s, F.aggregate(F.sequence(s + 1, F.greatest(l, s + 1)), F.lit(0.0), lambda acc, d: acc + x(s) * (d - s) / (s * d) * power(d))).otherwise(0.0)
    tail = ((x(l) - x(s)) / l + x(s) / s) * power(l)
    return r.select("query_id", F.when(F.col("la").isNull() | F.col("lb").isNull(), 0.0).otherwise((1 - p) / p * (first + uneven) + tail).alias("rbo"))


def relevance(ranks: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg, rr, recall at k: ranks (query_id, item, rank) against (query_id, item); null ndcg and recall without relevant items."""
    n_rel = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranks.join(relevant, ["query_id", "item"], "left_semi")
    per = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("found"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    q = ranks.select("query_id").distinct().join(n_rel, "query_id", "left").join(per, "query_id", "left")
    return q.select(
        "query_id",
        F.round(F.when(F.col("n_rel") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(F.col("n_rel") > 0, F.coalesce("found", F.lit(0)) / F.col("n_rel")), 6).alias("recall"),
    )
