"""Metric samples: gauges, counters, quantiles and latest-wins labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: Column, step_s: int) -> Column:
    """floor(epoch / step) of a timestamp without zone, read as UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000 * step_s)).cast("long")


def gauge_downsample(samples: DataFrame, step_s: int, by: list[str]) -> DataFrame:
    """Last sample of each bucket: by, bucket, ts, value."""
    last = F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id"))
    return samples.groupBy(*by, bucket(F.col("ts"), step_s).alias("bucket")).agg(last.alias("x")).select(*by, "bucket", "x.ts", "x.value")


def counter_delta(samples: DataFrame, step_s: int, by: list[str]) -> DataFrame:
    """Growth of each bucket's last value over the bucket before's last, over its own first in the first bucket; a reset counts 0."""
    order = F.struct("ts", "event_id")
    b = samples.groupBy(*by, bucket(F.col("ts"), step_s).alias("bucket")).agg(F.max_by("value", order).alias("last"), F.min_by("value", order).alias("first"))
    before = F.lag("last").over(Window.partitionBy(*by).orderBy("bucket"))
    return b.withColumn("delta", F.round(F.greatest(F.lit(0.0), F.col("last") - F.coalesce(before, F.col("first"))), 6)).select(*by, "bucket", "delta")


def latest_label(labels: DataFrame, by: list[str], value: str) -> DataFrame:
    """The label given last for each key."""
    return labels.groupBy(*by).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))


def order_statistics(values: DataFrame, ranks: list[int], *, buckets: int = 1024, few: int = 10_000) -> dict[int, float]:
    """The values of these ranks (from 0) of the one column of numbers, by narrowing ranges.

    Each round counts the range that holds a rank by buckets, which tasks do before anything moves, and goes on in the
    rank's bucket, until it has few values or only one. No task sees all different values, and the driver has a row a bucket.
    """
    x = F.col(values.columns[0]).cast("double")
    base = values.select(x.alias("x")).where("x IS NOT NULL")
    low, high = base.agg(F.min("x"), F.max("x")).first()
    out: dict[int, float] = {}
    todo = [(low, high, 0, None, sorted(set(ranks)))] if ranks else []
    while todo:
        low, high, before, n, asked = todo.pop()
        inside = base.where(F.col("x").between(low, high))
        if low == high:
            out.update(dict.fromkeys(asked, low))
        elif n is not None and n <= few:
            ordered = sorted(r[0] for r in inside.collect())
            out.update({r: ordered[r - before] for r in asked})
        else:
            # halves first, as the width of a range may be more than a double holds
            place = F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * buckets), F.lit(buckets - 1))
            counts = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
            for c in counts:
                own = [r for r in asked if before <= r < before + c["n"]]
                if own:
                    todo.append((c["low"], c["high"], before, c["n"], own))
                before += c["n"]
    return out


def quantiles(values: DataFrame, shares: dict[str, float], **bounds) -> DataFrame:
    """One row with each named share of the one column of numbers, interpolated between neighbours; null without values."""
    n = values.where(F.col(values.columns[0]).isNotNull()).count()
    at = {name: (n - 1) * share for name, share in shares.items()}
    found = order_statistics(values, [r for h in at.values() for r in (math.floor(h), math.ceil(h))], **bounds) if n else {}
    row = [found[math.floor(h)] + (h - math.floor(h)) * (found[math.ceil(h)] - found[math.floor(h)]) if n else None for h in at.values()]
    return values.sparkSession.createDataFrame([row], ", ".join(f"{name} double" for name in shares))


def latency_quantiles(runs: DataFrame) -> DataFrame:
    """p50 and p95 of total, interpolated; null without rows."""
    return quantiles(runs.select("total"), {"p50": 0.5, "p95": 0.95})
