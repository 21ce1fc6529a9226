"""Streams fed file by file give what one batch over all files gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.streaming import flows as W


@pytest.fixture(scope="module")
def landed(spark, data, tmp_path_factory):
    """The events, in order of time, as six files that land one after the other."""
    out = tmp_path_factory.mktemp("landing")
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("event_id", F.col("event_id").cast("long")).withColumn("user_id", F.col("user_id").cast("long"))
    part = F.ntile(6).over(Window.orderBy("ts")) - 1
    numbered = events.withColumn("part", part).persist()
    for i in range(6):
        numbered.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"file://{out}/events")
    numbered.unpersist()
    return f"file://{out}/events", events


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def stream(spark, landed):
    return W.event_stream(spark, landed[0], files_a_batch=1)


def test_dedup(spark, landed):
    s = stream(spark, landed).withColumn("key", F.concat_ws("/", "event_type", "user_id"))
    got = W.finished(W.ingest_dedup(s, "key"), "append").select("key")
    assert plain(got) == plain(landed[1].select(F.concat_ws("/", "event_type", "user_id")).distinct())


def test_latest_state(spark, landed):
    got = W.finished(W.latest_state(stream(spark, landed)), "complete")
    want = landed[1].groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")), F.count("*"))
    assert plain(got) == plain(want)


def test_tumbling(spark, landed):
    got = W.finished(W.tumbling_metrics(stream(spark, landed)), "complete").select("event_type", "n")
    want = landed[1].groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("n")).select("event_type", "n")
    assert plain(got) == plain(want)


def test_late_feedback(spark, landed):
    s = stream(spark, landed)
    runs = s.where("event_type = 'view'").select(F.col("user_id").alias("query_id"), "ts")
    feedback = s.where("event_type = 'click'").select(F.col("user_id").alias("query_id"), F.col("ts").alias("fts"), (F.col("value") > 20).alias("relevant"))
    got = W.finished(W.with_feedback(runs, feedback), "append").where("relevant IS NOT NULL").count()
    e = landed[1]
    v, c = e.where("event_type = 'view'").alias("v"), e.where("event_type = 'click'").alias("c")
    want = v.join(c, F.expr("v.user_id = c.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 7 DAYS")).count()
    assert got == want > 0


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """Two hundred days of three users' events as seven files, of which the newest lands first."""
    out = tmp_path_factory.mktemp("scattered")
    e = spark.range(2400).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 7200 + F.pmod(F.xxhash64("id"), F.lit(5000))).cast("timestamp_ntz").alias("ts"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).alias("user_id"), F.concat(F.lit("t"), F.pmod("id", F.lit(4))).alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    e = e.where("event_id % 40 < 25")
    for i in range(7):
        e.where(F.floor(F.col("event_id") / 350) == 6 - i).coalesce(1).write.mode("append").parquet(f"file://{out}/events")
    return f"file://{out}/events", e


def test_dedup_of_files_out_of_order(spark, scattered):
    s = stream(spark, scattered).withColumn("key", F.concat_ws("/", "event_type", "user_id"))
    got = W.finished(W.ingest_dedup(s, "key"), "append").select("key")
    assert plain(got) == plain(scattered[1].select(F.concat_ws("/", "event_type", "user_id")).distinct())


def test_sessions_of_files_out_of_order(spark, scattered):
    got = W.finished(W.idle_sessions(stream(spark, scattered)), "complete").select("user_id", F.col("start").cast("timestamp_ntz"), "n")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = scattered[1].withColumn("new", F.when(F.col("ts") - F.lag("ts").over(by) < F.expr("INTERVAL 12 HOURS"), 0).otherwise(1))
    want = new.withColumn("s", F.sum("new").over(by)).groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("s")
    assert plain(got) == plain(want) and got.count() > 100
