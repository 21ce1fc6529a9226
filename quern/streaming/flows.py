"""Streams: ingest without repeats, tumbling metrics, latest job states, idle sessions, late feedback.

Each takes a streaming table and gives one back; `finished` runs one over what a source holds now and returns the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.store import work_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, *, files_a_batch: int = 4) -> DataFrame:
    """Events as they land as Parquet files in a folder; timestamps without zone are read as UTC."""
    s = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def ingest_dedup(stream: DataFrame, key: str, delay: str | None = None) -> DataFrame:
    """The first row of each key, in whatever order rows land; a delay bounds the state to keys that repeat within it, and drops later rows."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]) if delay else stream.dropDuplicates([key])


def tumbling_metrics(stream: DataFrame, step: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Count and sum of each event type's windows."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_state(stream: DataFrame) -> DataFrame:
    """The newest transition of each job (user)."""
    return stream.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x"), F.count("*").alias("transitions")).select("job_id", F.col("x.event_type").alias("status"), "transitions")


def idle_sessions(stream: DataFrame, gap: str = "12 hours", delay: str | None = None) -> DataFrame:
    """Runs of a user's events without a pause of `gap`, in whatever order rows land; a delay bounds the state, and drops later rows in any output mode."""
    return (stream.withWatermark("ts", delay) if delay else stream).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def with_feedback(runs: DataFrame, feedback: DataFrame, within: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Query-log rows with the feedback on them that comes within a time; rows without any go out when the time is over."""
    r, f = runs.withWatermark("ts", "1 day").alias("r"), feedback.withWatermark("fts", "1 day").alias("f")
    near = F.expr(f"r.query_id = f.query_id AND f.fts >= r.ts AND f.fts <= r.ts + {within}")
    return r.join(f, near, "left_outer").select("r.query_id", "r.ts", "f.relevant")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream over all that its source holds: each batch is a folder of its own in the shared one, so that a batch that is tried again is not there twice; in complete mode the last one counts."""
    spark = stream.sparkSession
    path = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")
