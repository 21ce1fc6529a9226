"""Merges of entities as a log: nothing is overwritten, and mentions at any time follow from the first ones and the log.

Log: (seq, kind, merge_id, source, target), kind being merge or undo; seq tells the order, an undo names its merge. A merge
stands until its undo. A source that has been merged can't be merged again while that stands, so standing merges lead from
each entity to one that still is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.entities import apply_merges


def standing(log: DataFrame, at: int | None = None) -> DataFrame:
    """(seq, merge_id, source, target) of the merges that stand after step `at`; by default, after the last."""
    seen = log if at is None else log.where(F.col("seq") <= at)
    undone = seen.where("kind = 'undo'").select("merge_id")
    return seen.where("kind = 'merge'").join(undone, "merge_id", "left_anti").select("seq", "merge_id", "source", "target")


def problems(log: DataFrame) -> DataFrame:
    """(seq, problem) of steps that can't be: a merge with itself, of a source or into a target that has been merged, or an undo of no merge, a second one, or one before a later merge of its target is undone.

    Each merge has a span from its step to its undo's; spans meet by the entity they share, so only neighbours are compared.
    """
    merges, undos = log.where("kind = 'merge'"), log.where("kind = 'undo'")
    ends = undos.groupBy("merge_id").agg(F.min("seq").alias("end"))
    spans = merges.join(ends, "merge_id", "left").select("merge_id", F.col("seq").alias("begin"), F.coalesce("end", F.lit(2**62)).alias("end"), "source", "target")
    own = spans.where("source = target").select(F.col("begin").alias("seq"), F.lit("same").alias("problem"))
    during = lambda a, b: (F.col(f"{b}.begin") < F.col(f"{a}.begin")) & (F.col(f"{a}.begin") < F.col(f"{b}.end"))
    touching = spans.select("merge_id", "begin", "end", F.explode(F.array_distinct(F.array("source", "target"))).alias("entity"))
    gone = spans.select("merge_id", "begin", "end", F.col("source").alias("entity"))
    merged = touching.alias("a").join(gone.alias("b"), "entity").where(during("a", "b")).select(F.col("a.begin").alias("seq"), F.lit("merged").alias("problem"))
    known = undos.join(merges.select("merge_id", F.col("seq").alias("begin")), "merge_id", "left")
    unknown = known.where("begin IS NULL OR begin > seq").select("seq", F.lit("no merge").alias("problem"))
    twice = undos.join(ends, "merge_id").where(F.col("seq") > F.col("end")).select("seq", F.lit("undone").alias("problem"))
    target = spans.where(F.col("end") < 2**62).select("merge_id", "begin", "end", F.col("target").alias("entity"))
    # a later merge that touches the target and stands beyond the undo
    over = target.alias("a").join(touching.alias("b"), "entity").where("b.begin > a.begin AND b.begin < a.end AND b.end > a.end").select(F.col("a.end").alias("seq"), F.lit("not the last").alias("problem"))
    return own.unionByName(merged).unionByName(unknown).unionByName(twice).unionByName(over).distinct()


def survivors(merges: DataFrame, save) -> DataFrame:
    """(source, target) of standing merges, with the entity at the end of the chain as target; chains halve each round."""
    links = save(merges.select("source", "target"))
    while True:
        ahead = links.select(F.col("source").alias("target"), F.col("target").alias("further"))
        after = save(links.join(ahead, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        links = after.select("source", "target")
        if after.where("moved").isEmpty():
            return links


def mentions_at(first: DataFrame, log: DataFrame, save, at: int | None = None) -> DataFrame:
    """Mentions (entity_id, page_id, surface_form, char_start) after step `at`, from the first ones."""
    return apply_merges(first, survivors(standing(log, at), save))


def merged(mentions: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """The live table after one merge, and the snapshot that entities.undo_merge() needs: both entities' mentions before it."""
    snapshot = mentions.where(F.col("entity_id").isin(source, target))
    plan = mentions.sparkSession.createDataFrame([(source, target)], "source long, target long")
    return apply_merges(mentions, plan), snapshot
