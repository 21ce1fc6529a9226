"""Similar pages by vectors and by clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vector import dot
from quern.operators.retrieval import dense_topk, ranked


def vector_similarity(queries: DataFrame, page_vectors: DataFrame, k: int) -> DataFrame:
    """query_id, page_id, score, rank: pages by dot product of unit vectors, without the query's own page."""
    near = dense_topk(queries, page_vectors.select(F.col("page_id").alias("chunk_id"), "vector"), k + 1)
    rest = near.where("query_id <> chunk_id").select("query_id", F.col("chunk_id").alias("page_id"), "score")
    return ranked(rest, ["query_id"], "score", "page_id", k)


def cluster_similarity(queries: DataFrame, members: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Pages of the query page's cluster: by dot product if both have a vector, else by membership probability."""
    own = queries.select(F.col("query_id").alias("page_id")).join(members, "page_id").select(F.col("page_id").alias("query_id"), "cluster_id")
    near = own.join(members, "cluster_id").where("page_id <> query_id")
    v = near.join(vectors.select("page_id", F.col("vector").alias("pv")), "page_id", "left").join(vectors.select(F.col("page_id").alias("query_id"), F.col("vector").alias("qv")), "query_id", "left")
    score = F.coalesce(dot(F.col("pv"), F.col("qv")), F.col("probability"), F.lit(0.0))
    return ranked(v.select("query_id", "page_id", score.alias("score")), ["query_id"], "score", "page_id", k)
