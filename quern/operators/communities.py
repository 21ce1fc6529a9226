"""Communities of a weighted graph by modularity: parallel moves, refinement, contraction, level by level.

Each step is a join and a sum by node or community; no community or neighbourhood is held by one task, and what comes to
the driver are two sums a round. Nodes of one round decide at the same time, so a part of them rests in each, chosen by a
hash of seed, round and node, and a round that doesn't raise modularity is taken back and done with fewer of them.

In the refinement each node starts alone within its community, and lone nodes join a part beside them that rests in this
round; so parts are connected. They are the next level's nodes, which begin in their communities. The communities at the
end are cut into their connected pieces, which never lowers modularity.

A level of ONE_TASK edges or fewer, as the last ones are, is done by one task, where nodes move one after the other.
"""

from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.entities import components

#: Rounds of moves and of refinement in a level, levels, the least share of nodes that moves, and what counts as a gain.
ROUNDS, REFINEMENTS, LEVELS, LEAST_SHARE, GAIN = 20, 4, 12, 1 / 16, 1e-9
ONE_TASK = 200_000


def quality(edges: DataFrame, of: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of nodes (id, community) on edges (a, b, w); an edge of a node with itself is there once."""
    ends = edges.join(of.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    both = ends.select("w", F.explode(F.array("ca", "cb")).alias("c"), (F.col("ca") == F.col("cb")).alias("inside"))
    sums = both.groupBy("c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)).alias("inside"))
    total, inside, squares = sums.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return inside / total - resolution * squares / total**2 if total else 0.0


def _degrees(edges: DataFrame) -> DataFrame:
    """(id, k): weights of a node's ends; an edge with itself has two."""
    return edges.select("w", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.sum("w").alias("k"))


def _ways(edges: DataFrame) -> DataFrame:
    apart = edges.where("a <> b")
    return apart.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(apart.select(F.col("b").alias("id"), F.col("a").alias("other"), "w"))


def _chance(seed: int, turn: int, column: str = "id"):
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col(column)), F.lit(1 << 20)) / float(1 << 20)


def _best(scored: DataFrame) -> DataFrame:
    """(id, to, gain): the place of the greatest gain, then the least name."""
    return scored.groupBy("id").agg(F.max(F.struct("gain", (-F.col("c")).alias("minus"))).alias("x")).select("id", (-F.col("x.minus")).alias("to"), F.col("x.gain").alias("gain"))


def _moved(ways: DataFrame, state: DataFrame, total: float, resolution: float, active) -> DataFrame:
    """state (id, k, community) after each active node has gone to the community of most gain beside it."""
    sums = state.groupBy("community").agg(F.sum("k").alias("sum")).withColumnRenamed("community", "c")
    near = ways.join(state.select(F.col("id").alias("other"), F.col("community").alias("c")), "other").groupBy("id", "c").agg(F.sum("w").alias("w"))
    # its own community is a choice even without a neighbour there
    near = near.unionByName(state.select("id", F.col("community").alias("c"), F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
    met = near.join(state.where(active), "id").join(sums, "c")
    rest = F.col("sum") - F.when(F.col("c") == F.col("community"), F.col("k")).otherwise(0.0)
    scored = met.select("id", "c", (F.col("w") - resolution * F.col("k") * rest / total).alias("gain"), (F.col("c") == F.col("community")).alias("own"))
    stay = scored.where("own").select("id", F.col("gain").alias("stay"))
    better = _best(scored.where("NOT own").select("id", "c", "gain")).join(stay, "id").where(F.col("gain") > F.col("stay") + GAIN * total).select("id", "to")
    return state.join(better, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community"))


def _refined(ways: DataFrame, state: DataFrame, total: float, resolution: float, seed: int, rounds: int, save) -> DataFrame:
    """(id, part): connected parts of communities."""
    parts = state.withColumn("part", F.col("id"))
    inside = ways.join(state.select("id", F.col("community").alias("c1")), "id").join(state.select(F.col("id").alias("other"), F.col("community").alias("c2")), "other").where("c1 = c2").select("id", "other", "w")
    inside = save(inside)
    for turn in range(rounds):
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("sum"))
        moving = (F.col("n") == 1) & (_chance(seed, turn, "part") < 0.5)
        now = parts.join(sizes, "part").withColumn("moving", moving)
        rest = now.where("NOT moving").select(F.col("id").alias("other"), F.col("part").alias("c"), "sum")
        near = inside.join(rest, "other").groupBy("id", "c").agg(F.sum("w").alias("w"), F.first("sum").alias("sum"))
        scored = near.join(now.where("moving").select("id", "k"), "id").select("id", "c", (F.col("w") - resolution * F.col("k") * F.col("sum") / total).alias("gain"))
        to = _best(scored.where("gain > 0")).select("id", "to")
        parts = save(parts.join(to, "id", "left").select("id", "k", "community", F.coalesce("to", "part").alias("part")))
    return parts


def _level_task(total: float, resolution: float, seed: int):
    """A level's edges (a, b, w) and nodes (a, community as b, degree as w, marked by node) to (id, k, community, part)."""

    def task(batches):
        near: dict[int, dict[int, float]] = defaultdict(dict)
        of, k, sums = {}, {}, defaultdict(float)
        for batch in batches:
            for a, b, w, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node:
                    of[a], k[a] = b, w
                    sums[b] += w
                elif a != b:
                    near[a][b] = near[b][a] = w
        order = sorted(of)
        random.Random(seed).shuffle(order)

        def ways(i: int, place: dict[int, int]) -> dict[int, float]:
            out: dict[int, float] = defaultdict(float)
            for o, w in near[i].items():
                out[place[o]] += w
            return out

        gain = lambda i, w, there: w - resolution * k[i] * there / total
        moved = True
        while moved:
            moved = False
            for i in order:
                own, there = of[i], ways(i, of)
                sums[own] -= k[i]
                best, most = own, gain(i, there.get(own, 0.0), sums[own]) + GAIN * total
                for c in sorted(there):
                    if c != own and gain(i, there[c], sums[c]) > most:
                        best, most = c, gain(i, there[c], sums[c])
                of[i] = best
                sums[best] += k[i]
                moved |= best != own
        part, size, weight = {i: i for i in order}, {i: 1 for i in order}, dict(k)
        for i in order:
            if size[part[i]] == 1:
                there = {c: w for c, w in ways(i, part).items() if c != part[i] and of[c] == of[i]}
                best = max(there, key=lambda c: (gain(i, there[c], weight[c]), -c), default=None)
                if best is not None and gain(i, there[best], weight[best]) > 0:
                    part[i] = best
                    size[best], weight[best], size[i], weight[i] = size[best] + 1, weight[best] + k[i], 0, 0.0
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), *(pa.array([d[i] for i in order], t) for d, t in ((k, pa.float64()), (of, pa.int64()), (part, pa.int64())))], names=["id", "k", "community", "part"])

    return task


def _level(level: DataFrame, state: DataFrame, total: float, resolution: float, seed: int, depth: int, save) -> DataFrame:
    """(id, k, community, part) after a level's moves and refinement."""
    ways, state = save(_ways(level)), save(state)
    reached, share = quality(level, state, resolution), 0.5
    for turn in range(ROUNDS):
        after = save(_moved(ways, state, total, resolution, _chance(seed, depth * ROUNDS + turn) < share))
        now = quality(level, after, resolution)
        if now > reached + GAIN:
            state, reached = after, now
        elif share > LEAST_SHARE:
            share /= 2
        else:
            break
    return _refined(ways, state, total, resolution, seed + depth, REFINEMENTS, save)


def communities(nodes: DataFrame, edges: DataFrame, save, *, resolution: float = 1.0, seed: int = 42, one_task: int = ONE_TASK) -> DataFrame:
    """(id, community) for nodes (id) and undirected edges (a, b, weight); a community is named by its least node.

    Edges count once in either direction, several of one pair are summed, those of no weight or without an end are left
    out. A node without edges is alone. `save` writes a table and reads it back.
    """
    given = edges.where("weight > 0 AND a IS NOT NULL AND b IS NOT NULL").groupBy(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    given = save(given)
    ids = save(nodes.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct())
    total = given.agg(F.coalesce(F.sum("w"), F.lit(0.0)) * 2).first()[0]
    if not total:
        return ids.select("id", F.col("id").alias("community"))
    level, place = given, ids.select("id", F.col("id").alias("node"))
    state = _degrees(level).withColumn("community", F.col("id"))
    for depth in range(LEVELS):
        if level.count() <= one_task:
            rows = level.select("a", "b", "w", F.lit(False).alias("node")).unionByName(state.select(F.col("id").alias("a"), F.col("community").alias("b"), F.col("k").alias("w"), F.lit(True).alias("node")))
            parts = save(rows.coalesce(1).mapInArrow(_level_task(total, resolution, seed + depth), "id long, k double, community long, part long"))
        else:
            parts = _level(level, state, total, resolution, seed, depth, save)
        size = parts.agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).first()
        if size["n"] == size["parts"]:
            break
        to = parts.select("id", "part")
        end = lambda name, new: to.select(F.col("id").alias(name), F.col("part").alias(new))
        level = save(level.join(end("a", "x"), "a").join(end("b", "y"), "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
        place = save(place.join(to.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("part", "node").alias("node")))
        state = parts.groupBy("part").agg(F.sum("k").alias("k"), F.first("community").alias("community")).withColumnRenamed("part", "id")
    found = save(place.join(state.select(F.col("id").alias("node"), "community"), "node", "left").select("id", F.coalesce("community", "node").alias("community")))
    of = lambda name, c: found.select(F.col("id").alias(name), F.col("community").alias(c))
    inside = given.where("a <> b").join(of("a", "x"), "a").join(of("b", "y"), "b").where("x = y").select("a", "b")
    return components(inside, ids.select(F.col("id").alias("entity_id")), save).select(F.col("entity_id").alias("id"), F.col("component").alias("community"))
