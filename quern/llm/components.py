"""Connected components of an edge table, by alternating large and small stars; no vertex list leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, stored_at


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the least node of its own.

    Loops and repeated edges do no harm; no edges, no rows. Each round starts from a table written to the shared folder,
    which goes when the next one is there.
    """
    now, path = stored_at(edges.where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        old = path
        now, path = stored_at(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct(), "edges")
        dropped(edges.sparkSession, old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
