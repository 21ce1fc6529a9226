"""The retrieval model's tables, read or derived from the stored ones with declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import fixed_chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, domain, body_text, first_seen_at, status: one page a document; every tenth is still queued."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("domain"),
        F.col("text").alias("body_text"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT))").alias("first_seen_at"),
        F.when(F.col("doc_id") % 10 == 9, "queued").otherwise("indexed").alias("status"),
    )


def chunks(spark: SparkSession, sf_dir: str, width: int = 400) -> DataFrame:
    return fixed_chunks(pages(spark, sf_dir), width)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, page_id, ordinal, vector and label of each stored embedding; four chunks make a page."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 4").alias("page_id"), (F.col("vec_id") % 4).cast("int").alias("ordinal"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every embedding whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, page_id, probability: an embedding belongs to the cluster of its label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("page_id"), F.lit(1.0).alias("probability"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
