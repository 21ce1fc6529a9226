"""The store's verbs over tables: look-ups, ordered hydration, optional filters, idempotent inserts, replacements, rules of models and watches.

A write is a new table made from the old one and a delta; `now` is always given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import url as U


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, or none."""
    return table.where(F.col(key) == value)


def hydrate(asked: DataFrame, table: DataFrame, key: str, *, by: str = "list_id", ids: str = "ids", distinct: bool = False) -> DataFrame:
    """(by, pos, table's columns) for lists of ids: in the lists' order, ids that the table lacks dropped, repeats kept or (distinct) at their first place alone."""
    each = asked.select(by, F.posexplode(F.array_distinct(ids) if distinct else F.col(ids)).alias("pos", key))
    return each.join(table, key).select(by, "pos", *table.columns)


def conjunction(table: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every condition that is given: equal to a value, or (since=...) not before a time; None asks for nothing."""
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None and c != "since"]
    if wanted.get("since") is not None:
        tests.append(F.col("ts") >= F.lit(wanted["since"]).cast("timestamp_ntz"))
    return reduce(lambda df, t: df.where(t), tests, table)


def newest_first(table: DataFrame, at: str, key: str, limit: int, *, oldest: bool = False) -> DataFrame:
    """The `limit` newest rows with their rank, ties by id; or the oldest ones."""
    order = [F.asc(at) if oldest else F.desc(at), F.asc(key)]
    top = table.orderBy(*order).limit(limit)
    # the rows are `limit` at most, so one sort numbers them
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def cap_newest(items: DataFrame, by: str, at: str, key: str, limit: int) -> DataFrame:
    """Each group's newest `limit` rows; those without a time come last."""
    order = Window.partitionBy(by).orderBy(F.col(at).desc_nulls_last(), F.asc(key))
    return items.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def page_ids_by_domain(pages: DataFrame, domains: DataFrame, limit: int, *, status: str | None = None) -> DataFrame:
    """(domain, page_id, rank): a domain's pages last seen first."""
    some = conjunction(pages, status=status).join(domains.select("domain").distinct(), "domain", "left_semi")
    return cap_newest(some.select("domain", "page_id", "last_seen_at"), "domain", "last_seen_at", "page_id", limit).drop("last_seen_at")


def entities_on_page(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(page_id, entity_id, mention_count, rank): a page's different entities, most mentioned first."""
    have = mentions.select("page_id", "entity_id").distinct().join(entities.select("entity_id", "mention_count"), "entity_id")
    order = Window.partitionBy("page_id").orderBy(F.desc("mention_count"), "entity_id")
    return have.select("page_id", "entity_id", "mention_count", F.row_number().over(order).cast("long").alias("rank"))


def created_jobs(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (pos, idempotency_key, ...) with `created`: false where a job or an earlier request has the key."""
    known = jobs.select("idempotency_key").distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("pos"))
    return asked.join(known, "idempotency_key", "left").withColumn("created", F.col("_known").isNull() & (first == 1)).drop("_known")


def replace_rows(table: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """table with all rows of the delta's keys replaced by the delta's."""
    return table.join(delta.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(delta.select(*table.columns))


def activated(models: DataFrame, model_id: str) -> DataFrame:
    """models with the one that is named active and no other; as they are if it is missing or not ready."""
    ready = models.where((F.col("id") == model_id) & (F.col("status") == "ready")).select(F.lit(True).alias("_ok")).limit(1)
    found = models.join(ready, F.lit(True), "left")
    return found.withColumn("is_active", F.when(F.col("_ok"), F.col("id") == model_id).otherwise(F.col("is_active"))).drop("_ok")


def model_rules(models: DataFrame, hard_max: int = 512) -> DataFrame:
    """models with `may_register`, `may_activate` and `may_retire`: inputs long enough for chunks, ready, not the active one."""
    return models.select("*", (F.col("max_input_tokens") >= hard_max).alias("may_register"), (F.col("status") == "ready").alias("may_activate"), (~F.col("is_active")).alias("may_retire"))


def pending_chunks(chunks: DataFrame, done: DataFrame, *, cursor: int | None = None, pages: int = 25) -> DataFrame:
    """The chunks without a vector of the next pages after the cursor: what a backfill that stopped goes on with."""
    left = chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")
    after = left if cursor is None else left.where(F.col("page_id") > cursor)
    return after.join(after.select("page_id").distinct().orderBy("page_id").limit(pages), "page_id", "left_semi")


def token_windows(requests: DataFrame, *, rpm: int = 300, tpm: int = 1_000_000) -> DataFrame:
    """(minute, requests, tokens, within): what each minute's requests (ts, tokens) take of the budget."""
    minute = F.date_trunc("minute", "ts").alias("minute")
    w = requests.groupBy(minute).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return w.withColumn("within", (F.col("requests") <= rpm) & (F.col("tokens") <= tpm))


def retry_at(now: Column, attempts: Column, base_s: float, retry_after_s: Column | None = None) -> Column:
    """now + base * 2^attempts seconds, or the time that a provider asks for if that is longer."""
    delay = F.lit(base_s) * F.pow(F.lit(2.0), attempts.cast("double"))
    if retry_after_s is not None:
        delay = F.greatest(delay, F.coalesce(retry_after_s.cast("double"), F.lit(0.0)))
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay)


def heartbeat(jobs: DataFrame, beats: DataFrame, lease_s: int) -> DataFrame:
    """Running jobs with their leases moved on by their last beat (job_id, ts); others as they are."""
    last = beats.groupBy("job_id").agg(F.max("ts").alias("_beat"))
    until = F.col("_beat") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_s))
    moved = F.when((F.col("status") == "running") & F.col("_beat").isNotNull(), F.greatest("lease_until", until)).otherwise(F.col("lease_until"))
    return jobs.join(last, "job_id", "left").withColumn("lease_until", moved).drop("_beat")


def watch_problem(kind: Column, url: Column, interval_hours: Column) -> Column:
    """Why a watch is refused, or null: its URL must be absolute http(s), its interval 1 to 8,760 hours, and its kind fit the URL."""
    return (
        F.when(~F.coalesce(U.scheme(url).isin("http", "https") & (U.host(url) != ""), F.lit(False)), "url")
        .when(~F.coalesce(interval_hours.between(1, 8760), F.lit(False)), "interval")
        .when((kind == "podcast") & U.is_audio_url(url), "audio")
        .when((kind == "youtube") & ~F.coalesce(U.youtube_kind(url).isin("playlist", "channel"), F.lit(False)), "listing")
    )


def patched_watches(watches: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """watches after a patch each (watch_id, set: a map of the given fields, whose null clears a title): another interval counts from the last run, or from now."""
    given = lambda c: F.coalesce(F.map_contains_key("set", F.lit(c)), F.lit(False))
    interval = F.coalesce(F.when(given("interval_hours"), F.col("set")["interval_hours"].cast("int")), F.col("interval_hours"))
    moved = interval != F.col("interval_hours")
    base = F.coalesce("last_run_at", now)
    return watches.join(patches, "watch_id", "left").select(
        "watch_id",
        F.when(given("title"), F.col("set")["title"]).otherwise(F.col("title")).alias("title"),
        F.coalesce(F.when(given("enabled"), F.col("set")["enabled"].cast("boolean")), F.col("enabled")).alias("enabled"),
        interval.alias("interval_hours"),
        F.when(moved, base + F.make_dt_interval(F.lit(0), interval)).otherwise(F.col("next_run_at")).alias("next_run_at"),
    )


def rank_problem(ids: Column, ranks: Column) -> Column:
    """Why a list of ranks does not fit its ids, or null: as many, positive, strictly increasing."""
    n = F.size(ranks)
    grows = F.forall(F.arrays_zip(F.slice(ranks, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(ranks, 2, F.greatest(n, F.lit(1))).alias("b")), lambda x: x["a"] < x["b"])
    return F.when(F.size(ids) != n, "length").when(F.exists(ranks, lambda r: r < 1), "positive").when((n > 1) & ~grows, "order")


def store_times(pages: DataFrame, runs: DataFrame, since: Column) -> DataFrame:
    """One row: last_ingest_at, last_run_at, n_indexed and n_since, the pages indexed after `since`."""
    p = pages.agg(F.max("first_seen_at").alias("last_ingest_at"), F.count_if(F.col("status") == "indexed").alias("n_indexed"), F.count_if((F.col("status") == "indexed") & (F.col("first_seen_at") > since)).alias("n_since"))
    return p.crossJoin(runs.agg(F.max("finished_at").alias("last_run_at")))


def should_cluster(times: DataFrame, threshold: DataFrame, now: Column, *, min_pages: int = 50, min_new: int = 20) -> DataFrame:
    """One row, should_run: quiet for the threshold, and enough pages (before the first run) or new ones (after it)."""
    quiet = F.timestamp_diff("SECOND", F.col("last_ingest_at"), now) >= F.col("threshold_s")
    enough = F.when(F.col("last_run_at").isNull(), F.col("n_indexed") >= min_pages).otherwise(F.col("n_since") >= min_new)
    return times.crossJoin(threshold).select(F.coalesce(quiet & enough, F.lit(False)).alias("should_run"))


def knn_edges(near: DataFrame) -> DataFrame:
    """(a, b, weight) of nearest neighbours (query_id, chunk_id, score: cosine): 1 / (1 + distance), the greater of both directions, a < b."""
    weight = 1 / (1 + F.greatest(1 - F.col("score"), F.lit(0.0)))
    edges = near.where("query_id <> chunk_id AND NOT isnan(score)").select(F.least("query_id", "chunk_id").alias("a"), F.greatest("query_id", "chunk_id").alias("b"), weight.alias("weight"))
    return edges.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def membership(fitted: DataFrame) -> DataFrame:
    """(cluster_id, page_id, probability) without noise."""
    return fitted.where("cluster_id >= 0").select("cluster_id", "page_id", "probability")


def run_counts(fitted: DataFrame) -> DataFrame:
    """One row of a fit: n_pages, n_clusters, n_noise."""
    return fitted.agg(F.count("*").alias("n_pages"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), F.count_if(F.col("cluster_id") < 0).alias("n_noise"))


def upsert_clusters(clusters: DataFrame, delta: DataFrame) -> DataFrame:
    """clusters with new sizes; a null label or keywords in the delta leaves the old ones, and a tombstone goes."""
    c, d = clusters.alias("c"), delta.alias("d")
    both = c.join(d, F.col("c.cluster_id") == F.col("d.cluster_id"), "full")
    new = F.col("d.cluster_id").isNotNull()
    return both.select(
        F.coalesce("d.cluster_id", "c.cluster_id").alias("cluster_id"),
        F.coalesce("d.label", "c.label").alias("label"),
        F.coalesce("d.keywords", "c.keywords").alias("keywords"),
        F.coalesce("d.size", "c.size").alias("size"),
        F.when(~new, F.col("c.tombstoned_at")).alias("tombstoned_at"),
    )


def cluster_texts(members: DataFrame, pages: DataFrame, *, body: int = 2000) -> DataFrame:
    """(cluster_id, page_id, text): title and the body's first characters, the parts of a cluster's pseudo-document in pages' order."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("body_text", F.lit("")), 1, body))
    return members.join(pages, "page_id").select("cluster_id", "page_id", text.alias("text"))
