"""Offline evaluation of the query log: golden queries, scores of logged runs, differences between two arms.

Runs are (query_id, ts, kind, query_text, params (JSON), active_model, reranker_model, final_page_ids, final_page_ranks,
pool): pages as they were shown with their ranks, and those of the pool before reranking in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import query_norm


def log_rows(runs: DataFrame, *, since: str | None = None, kind: str | None = None, model: str | None = None) -> DataFrame:
    """The runs that are asked for."""
    out = runs
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out if model is None else out.where(F.col("active_model") == model)


def golden_queries(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(norm, query_text, relevant, sources): queries of one normal form with all their positive pages, the first text and the runs' ids in order.

    labels: the last (query_id, page_id, relevant) of each pair. Queries without a positive are left out.
    """
    with_norm = runs.select("query_id", "ts", "query_text", query_norm(F.col("query_text")).alias("norm"))
    labelled = with_norm.join(labels.select("query_id").distinct(), "query_id", "left_semi")
    texts = labelled.groupBy("norm").agg(F.min_by("query_text", F.struct("ts", "query_id")).alias("query_text"), F.array_sort(F.collect_list(F.struct("ts", "query_id"))).alias("x"))
    good = labelled.join(labels.where("relevant").select("query_id", "page_id"), "query_id").groupBy("norm").agg(F.array_sort(F.collect_set("page_id")).alias("relevant"))
    return texts.join(good, "norm").select("norm", "query_text", "relevant", F.transform("x", lambda r: r["query_id"]).alias("sources"))


def _dcg(ids: Column, ranks: Column, relevant: Column, k: Column) -> Column:
    hit = F.transform(F.arrays_zip(ids.alias("i"), ranks.alias("r")), lambda x: F.when(F.array_contains(relevant, x["i"]) & (x["r"] <= k), 1 / F.log2(x["r"] + 1.0)).otherwise(0.0))
    return F.aggregate(hit, F.lit(0.0), lambda s, v: s + v)


def ndcg(ids: Column, ranks: Column, relevant: Column, k: Column) -> Column:
    """Binary gains at their ranks over the best order's; null without relevant pages, 0 for no depth."""
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(relevant), k), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return F.when(F.size(relevant) > 0, F.when(k <= 0, 0.0).otherwise(_dcg(ids, ranks, relevant, k) / best))


def recall(ids: Column, ranks: Column, relevant: Column, k: Column) -> Column:
    """The share of relevant pages up to a rank; null without any."""
    found = F.array_distinct(F.transform(F.filter(F.arrays_zip(ids.alias("i"), ranks.alias("r")), lambda x: x["r"] <= k), lambda x: x["i"]))
    return F.when(F.size(relevant) > 0, F.size(F.array_intersect(relevant, found)) / F.size(relevant))


def reciprocal_rank(ids: Column, ranks: Column, relevant: Column) -> Column:
    first = F.array_min(F.transform(F.filter(F.arrays_zip(ids.alias("i"), ranks.alias("r")), lambda x: F.array_contains(relevant, x["i"])), lambda x: x["r"]))
    return F.coalesce(1 / first, F.lit(0.0))


def scored_runs(runs: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, model, labeled, scored, ndcg, rr, recall, pool_recall, lift) of every run; scores are null where a run has no positive page.

    lift: nDCG of what was shown less that of the pool, for runs with a reranker, the max rollup, no exact match, no
    offset, and no recency decay (its parameter there and null, or an arm of a comparison).
    """
    own = labels.groupBy("query_id").agg(F.collect_set(F.when(F.col("relevant"), F.col("page_id"))).alias("relevant"))
    r = runs.join(own, "query_id", "left")
    kk, relevant = F.lit(k), F.col("relevant")
    pool_ranks = F.when(F.size("pool") > 0, F.sequence(F.lit(1), F.size("pool"))).otherwise(F.array().cast("array<int>"))
    param = lambda name: F.get_json_object("params", f"$.{name}")
    # the key is there with a null, which a look-up alone can't tell from its absence
    has_key = F.array_contains(F.json_object_keys("params"), "recency_half_life_days")
    plain = (F.col("kind") == "compare_arm") | (has_key & param("recency_half_life_days").isNull())
    eligible = F.col("reranker_model").isNotNull() & (F.coalesce(param("rollup"), F.lit("max")) == "max") & (F.coalesce(param("exact_match"), F.lit("false")) != "true") & (F.coalesce(param("offset"), F.lit("0")).cast("int") == 0) & F.coalesce(plain, F.lit(False))
    shown = ndcg(F.col("final_page_ids"), F.col("final_page_ranks"), relevant, kk)
    scored = relevant.isNotNull() & (F.size("relevant") > 0)
    where = lambda c: F.when(scored, c)
    return r.select(
        "query_id",
        F.col("active_model").alias("model"),
        relevant.isNotNull().alias("labeled"),
        F.coalesce(scored, F.lit(False)).alias("scored"),
        where(shown).alias("ndcg"),
        where(reciprocal_rank(F.col("final_page_ids"), F.col("final_page_ranks"), relevant)).alias("rr"),
        where(recall(F.col("final_page_ids"), F.col("final_page_ranks"), relevant, kk)).alias("recall"),
        where(recall(F.col("pool"), pool_ranks, relevant, F.size("pool"))).alias("pool_recall"),
        F.when(scored & eligible, shown - ndcg(F.col("pool"), pool_ranks, relevant, kk)).alias("lift"),
    )


def model_reports(scores: DataFrame) -> DataFrame:
    """(model, logged, labeled, skipped, queries, and means): each model's runs; means leave out runs without a score."""
    means = [F.avg(c).alias(c) for c in ("ndcg", "rr", "recall", "pool_recall", "lift")]
    return scores.groupBy("model").agg(F.count("*").alias("logged"), F.count_if("labeled").alias("labeled"), F.count_if(F.col("labeled") & ~F.col("scored")).alias("skipped"), F.count_if("scored").alias("queries"), *means)


def arm_deltas(ranks_a: DataFrame, ranks_b: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: golden queries, and the means of ndcg, rr and recall of arm b less those of arm a; rankings are (query_id, item, rank), relevant is (query_id, relevant)."""

    def scores(ranks: DataFrame, suffix: str) -> DataFrame:
        lists = ranks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))
        q = relevant.join(lists, "query_id", "left")
        ids = F.coalesce(F.transform("x", lambda r: r["item"]), F.array().cast("array<bigint>"))
        places = F.coalesce(F.transform("x", lambda r: r["rank"].cast("int")), F.array().cast("array<int>"))
        return q.select("query_id", ndcg(ids, places, F.col("relevant"), F.lit(k)).alias(f"ndcg_{suffix}"), reciprocal_rank(ids, places, F.col("relevant")).alias(f"rr_{suffix}"), recall(ids, places, F.col("relevant"), F.lit(k)).alias(f"recall_{suffix}"))

    both = scores(ranks_a, "a").join(scores(ranks_b, "b"), "query_id")
    return both.agg(F.count("*").alias("golden"), *(F.coalesce(F.avg(f"{c}_b") - F.avg(f"{c}_a"), F.lit(0.0)).alias(c) for c in ("ndcg", "rr", "recall")))
