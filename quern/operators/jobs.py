"""Ledgers as tables: jobs, watches, tombstones, blacklist and ingest. A change is a new table made from the old one and a delta; `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def counts_by_status(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Jobs of each status, 0 where there are none."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.col("lease_until") < now))


def due_watches(watches: DataFrame, now: Column, limit: int) -> DataFrame:
    """The watches due the longest."""
    return watches.where(F.col("enabled") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "watch_id").limit(limit)


def upsert(table: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of delta put in place of those with their keys."""
    return table.join(delta, key, "left_anti").select(*table.columns).unionByName(delta)


def insert_new(table: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of delta whose keys it lacks."""
    return table.unionByName(delta.join(table, key, "left_anti").select(*table.columns))


def domain_matches(domain: Column, pattern: Column) -> Column:
    """The domain itself or a subdomain of it."""
    return (domain == pattern) | domain.endswith(F.concat(F.lit("."), pattern))


def blacklist_match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule_id): an exact url rule first, else the newest domain rule.

    A page's domain is taken apart into its suffixes, so that domain rules are an equal-key join too.
    """
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = pages.select("page_id", F.explode(F.concat(F.array(F.struct(F.lit("url").alias("kind"), F.col("url").alias("pattern"))), F.transform(suffixes, lambda s: F.struct(F.lit("domain").alias("kind"), s.alias("pattern"))))).alias("k")).select("page_id", "k.*")
    hits = keys.join(rules, ["kind", "pattern"])
    return newest(hits, ["page_id"], [F.when(F.col("kind") == "url", 0).otherwise(1), F.desc("created_at"), F.asc("rule_id")]).select("page_id", "rule_id")


def forget(tables: dict[str, DataFrame], pattern: str) -> dict[str, DataFrame]:
    """All tables that have a page_id without the pages of a domain, and the tombstones of those pages; entities keep their counts."""
    gone = tables["pages"].where(domain_matches(F.col("domain"), F.lit(pattern))).select("page_id")
    left = {name: df.join(gone, "page_id", "left_anti") if "page_id" in df.columns else df for name, df in tables.items()}
    return left | {"tombstones": gone.withColumn("status", F.lit("pending"))}


def tombstone_sweep(tombstones: DataFrame, chunks: DataFrame, now: Column, *, stale_minutes: int = 10, retention_days: int = 30) -> DataFrame:
    """page_id, status, action: deleted rows become verified or, with chunks left, pending; stale pending ones are purged again; old verified ones go."""
    left = chunks.groupBy("page_id").agg(F.count("*").alias("n"))
    t = tombstones.join(left, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    age = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    status = F.when(F.col("status") == "deleted", F.when(F.col("n") == 0, "verified").otherwise("pending")).otherwise(F.col("status"))
    action = F.when(F.col("status") == "deleted", F.lit("checked")).when((F.col("status") == "pending") & (age > stale_minutes * 60), "purge").when((F.col("status") == "verified") & (age > retention_days * 86400), "drop").otherwise("keep")
    return t.select("page_id", status.alias("status"), action.alias("action"))


def revisit_fold(visits: DataFrame) -> DataFrame:
    """Visits (url, at, pos) to pages: the first visit makes the page, later ones are counted."""
    return visits.groupBy("url").agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("visit_count"))


def ingest_outcomes(batch: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """Each item of a batch (page_id, url, domain, pos): blacklisted, revisit (known, or earlier in the batch) or queued."""
    black = blacklist_match(batch, rules).select("page_id", F.lit(True).alias("black"))
    seen = known.select("url").distinct().withColumn("seen", F.lit(True))
    b = batch.join(black, "page_id", "left").join(seen, "url", "left")
    nth = F.row_number().over(Window.partitionBy("url", F.coalesce("black", F.lit(False))).orderBy("pos"))
    return b.withColumn("nth", nth).select("page_id", "url", F.when(F.col("black"), "blacklisted").when(F.col("seen") | (F.col("nth") > 1), "revisit").otherwise("queued").alias("outcome"))


def fold_breaker(outcomes: DataFrame, *, threshold: int = 3, cooldown_s: int = 60) -> DataFrame:
    """State of each circuit breaker after its ordered outcomes (breaker, ts, pos, ok): state, failures, opened_at.

    Closed until `threshold` failures in a row; open for the cool-down; then one probe decides.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, failures, opened = "closed", 0, None
        for r in pdf.sort_values(["ts", "pos"]).itertuples():
            if state == "open" and (r.ts - opened).total_seconds() < cooldown_s:
                continue  # refused, so the outcome never happens
            if r.ok:
                state, failures = "closed", 0
                continue
            failures += 1
            if state == "open" or failures >= threshold:
                state, opened = "open", r.ts
        return pd.DataFrame({"breaker": [pdf["breaker"].iloc[0]], "state": [state], "failures": [failures]})

    return outcomes.groupBy("breaker").applyInPandas(fold, "breaker long, state string, failures long")
