"""Reports and small state changes: page status with its jobs, summaries, metadata merges, models, backfill estimates, entity lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.jobs import newest


def page_status(pages: DataFrame, jobs: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """Each page with the status of its newest job of two kinds."""
    out = pages.select("page_id", "status")
    for kind in kinds:
        last = newest(jobs.where(F.col("kind") == kind), ["page_id"], [F.desc("created_at"), F.desc("job_id")])
        out = out.join(last.select("page_id", F.col("status").alias(f"{kind}_status")), "page_id", "left")
    return out


def failures_by_kind(jobs: DataFrame) -> DataFrame:
    """Failed and dead jobs, and the share of all, for each kind."""
    bad = F.count_if(F.col("status").isin("failed", "dead"))
    return jobs.groupBy("kind").agg(bad.alias("failures"), F.round(bad / F.count("*"), 6).alias("share"))


def merged_metadata(old: Column, new: Column) -> Column:
    """JSON objects of strings put together one level deep; the new value wins, null counts as empty."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    a, b = parse(old), parse(new)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    entries = F.array_sort(F.concat(F.map_entries(kept), F.map_entries(b)))
    return F.to_json(F.map_from_entries(entries))


def resolve_entities(asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, entity_id): by id, else by canonical form, else by alias; the oldest id among equals."""
    norm = F.lower(F.trim("ref"))
    by_id = asked.join(entities, F.col("ref") == F.col("entity_id").cast("string")).select("ref", "entity_id", F.lit(0).alias("arm"))
    by_form = asked.withColumn("n", norm).join(entities.select("entity_id", F.lower("canonical_form").alias("n")), "n").select("ref", "entity_id", F.lit(1).alias("arm"))
    by_alias = asked.withColumn("n", norm).join(aliases.select("entity_id", F.col("normalized").alias("n")), "n").select("ref", "entity_id", F.lit(2).alias("arm"))
    return newest(by_id.unionByName(by_form).unionByName(by_alias), ["ref"], [F.asc("arm"), F.asc("entity_id")]).select("ref", "entity_id")


def backfill_estimate(chunks: DataFrame, price_a_million: float | None, batch: int = 128, seconds: float = 0.5) -> DataFrame:
    """For each model (model_id, tokens): chunks, tokens, cost (null without a price) and duration."""
    n, t = F.count("*"), F.sum("tokens")
    cost = F.round(t / 1e6 * price_a_million, 6) if price_a_million is not None else F.lit(None).cast("double")
    return chunks.groupBy("model_id").agg(n.alias("n_chunks"), t.cast("long").alias("n_tokens"), cost.alias("cost"), F.round(n / batch * seconds, 6).alias("duration_s"))


def cluster_listing(members: DataFrame, points: DataFrame) -> DataFrame:
    """cluster_id, size, x, y: clusters by size with the mean place of their members, where there is one."""
    return members.join(points, "page_id", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def model_pairs(ranks: DataFrame, k: int) -> DataFrame:
    """query_id, a, b, common, jaccard: agreement of each two models' first k items (model, pos, query_id, item, rank), in the models' order."""
    top = ranks.where(F.col("rank") <= k)
    size = top.groupBy("query_id", "model", "pos").agg(F.count("*").alias("n"))
    pairs = size.select("query_id", F.col("model").alias("a"), F.col("pos").alias("pa"), F.col("n").alias("na")).join(size.select("query_id", F.col("model").alias("b"), F.col("pos").alias("pb"), F.col("n").alias("nb")), "query_id").where("pa < pb")
    both = top.select("query_id", "item", F.col("model").alias("a")).join(top.select("query_id", "item", F.col("model").alias("b")), ["query_id", "item"]).groupBy("query_id", "a", "b").agg(F.count("*").alias("common"))
    r = pairs.join(both, ["query_id", "a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)).cast("long"))
    return r.select("query_id", "a", "b", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


def next_runs(watches: DataFrame, now: Column) -> DataFrame:
    """When each watch (watch_id, interval_hours, last_run_at) is next due: an interval after its last run, or after now."""
    base = F.coalesce("last_run_at", now)
    return watches.select("watch_id", (base + F.make_dt_interval(F.lit(0), F.col("interval_hours"))).alias("next_run_at"))


def suggestions(first_pages: DataFrame, similar: DataFrame, shown: DataFrame, k: int) -> DataFrame:
    """Pages like a query's first result (query_id, page_id) that the query did not show: similar is (query_id = page, page_id, score)."""
    near = first_pages.select("query_id", F.col("page_id").alias("seed")).join(similar.select(F.col("query_id").alias("seed"), "page_id", "score"), "seed")
    rest = near.join(shown.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")).cast("long")
    return rest.withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "seed", "page_id", "score", "rank")
