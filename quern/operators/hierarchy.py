"""Density clusters of any density: a spanning tree of mutual reachability, its condensed tree, and excess of mass.

1. Vectors are held in blocks. A row's core distance is that to its min_samples-th nearest row, itself counted; two rows
   are as far apart as the greatest of their distance and both cores.
2. The spanning tree grows in rounds: each part takes its least edge to another part. Of each pair of blocks go on the least
   edges of its parts, and no pairs of rows. Edges have one order (length, then ids), so no round makes a circle.
3. Parts of less than min_cluster_size rows are joined in rounds of table joins, only along an edge that is the least of
   both sides, or of a small part that leads to a large one; this is the order in which ever longer edges would join them.
   Each row learns at which edge it came to a large part, and to which.
4. What is left are the edges between large parts, fewer than rows / min_cluster_size. The driver makes the tree of them;
   rows are counted by tree node on executors, and the clusters of most excess of mass are chosen from these sums.

Exact, and quadratic in blocks: each round meets every pair of blocks that lies in more than one part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.entities import components

BLOCK = 1024
#: Parts up to which one task joins the parts of a round; more are joined by rounds of joins.
ONE_TASK = 200_000
#: Rows that are equal are at distance 0, whose inverse is no number; this stands for it.
MOST_LAMBDA = 1e18

_EDGE = "w double, lo long, hi long"


def _block_task(rows: int):
    """(id, vector) to blocks."""

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                m = np.array(part.column(1).to_pylist(), float)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "matrix"])

    return task


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean; near pairs by their differences, since products round them."""
    na, nb = (a**2).sum(axis=1), (b**2).sum(axis=1)
    d = np.maximum(na[:, None] + nb - 2 * a @ b.T, 0)
    i, j = np.nonzero(d < 1e-6 * (na[:, None] + nb))
    for at in range(0, len(i), 100_000):
        x, y = i[at : at + 100_000], j[at : at + 100_000]
        d[x, y] = ((a[x] - b[y]) ** 2).sum(axis=1)
    return np.round(np.sqrt(d), 9)


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(n, -1)


def _nearest_task(k: int):
    """(no, at, d): of each row the k least distances to another block's rows."""

    def task(batches):
        for b in batches:
            for r in b.to_pylist():
                a, o = _matrix(r["matrix"], len(r["ids"])), _matrix(r["o_matrix"], len(r["o_ids"]))
                d = np.sort(distances(a, o), axis=1)[:, :k]
                at = np.repeat(np.arange(len(a)), d.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["no"])), pa.array(at.astype(np.int32)), pa.array(d.reshape(-1))], names=["no", "at", "d"])

    return task


def _out_task(batches):
    """(part, other, w, lo, hi): the least edge from each part of two blocks to another part, of those between the blocks."""
    for b in batches:
        for r in b.to_pylist():
            ids, o_ids, part, o_part = (np.array(r[k], np.int64) for k in ("ids", "o_ids", "part", "o_part"))
            d = np.maximum(distances(_matrix(r["matrix"], len(ids)), _matrix(r["o_matrix"], len(o_ids))), np.maximum(np.array(r["core"])[:, None], np.array(r["o_core"])))
            d[part[:, None] == o_part] = np.inf
            out = []
            for m, x, px, y, py in ((d, ids, part, o_ids, o_part), (d.T, o_ids, o_part, ids, part)):
                least = m.min(axis=1)
                rows = np.flatnonzero(np.isfinite(least))
                # ties in a row go to the least pair of ids
                tie = m[rows] == least[rows, None]
                lo, hi = np.minimum(x[rows, None], y), np.maximum(x[rows, None], y)
                lo = np.where(tie, lo, np.iinfo(np.int64).max)
                first = lo.min(axis=1, initial=np.iinfo(np.int64).max)
                hi = np.where(lo == first[:, None], hi, np.iinfo(np.int64).max)
                col = hi.argmin(axis=1) if len(rows) else np.zeros(0, int)
                w, lo, hi = least[rows], first, hi[np.arange(len(rows)), col]
                order = np.lexsort((hi, lo, w, px[rows]))
                keep = order[np.flatnonzero(np.append(True, np.diff(px[rows][order]) != 0))] if len(rows) else order
                out.append((px[rows][keep], py[col[keep]], w[keep], lo[keep], hi[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["part", "other", "w", "lo", "hi"])


def _union_task(batches):
    """(part, root): parts that edges (part, other) join, by the least of them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    parts = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([find(p) for p in parts], pa.int64())], names=["part", "root"])


def _united(edges: DataFrame, save, one_task: int) -> DataFrame:
    if edges.count() <= one_task:
        return edges.select("part", "other").coalesce(1).mapInArrow(_union_task, "part long, root long")
    nodes = edges.select(F.col("part").alias("entity_id")).distinct()
    return components(edges.select(F.col("part").alias("a"), F.col("other").alias("b")), nodes, save).select(F.col("entity_id").alias("part"), F.col("component").alias("root"))


def spanning_tree(vectors: DataFrame, min_samples: int, save, *, block: int = BLOCK, one_task: int = ONE_TASK) -> DataFrame:
    """(w, lo, hi): edges of the least spanning tree of mutual reachability over (page_id, vector)."""
    rows = vectors.select(F.col("page_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = save(rows.mapInArrow(_block_task(block), "ids array<long>, matrix binary").withColumn("no", F.monotonically_increasing_id()))
    other = blocks.select(*(F.col(c).alias(f"o_{c}") for c in ("no", "ids", "matrix")))
    near = blocks.crossJoin(other).mapInArrow(_nearest_task(min_samples), "no long, at int, d double")
    place = F.row_number().over(Window.partitionBy("no", "at").orderBy("d"))
    # a row without so many others has the distance to its last one
    core = near.withColumn("place", place).where(F.col("place") <= min_samples).groupBy("no", "at").agg(F.max("d").alias("d"))
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda x: x[name])
    blocks = save(blocks.join(core.groupBy("no").agg(in_order("d").alias("core")), "no"))
    parts = save(blocks.select("no", F.posexplode("ids").alias("at", "id")).withColumn("part", F.col("id")))
    tree = None
    while True:
        state = blocks.join(parts.groupBy("no").agg(in_order("part").alias("part")), "no")
        other = state.select(*(F.col(c).alias(f"o_{c}") for c in ("no", "ids", "matrix", "core", "part")))
        apart = "no <= o_no AND NOT (array_min(part) = array_max(part) AND array_min(o_part) = array_max(o_part) AND part[0] = o_part[0])"
        found = state.crossJoin(other).where(apart).mapInArrow(_out_task, f"part long, other long, {_EDGE}")
        least = save(found.groupBy("part").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("part", "e.other", "e.w", "e.lo", "e.hi"))
        if least.isEmpty():
            break
        edges = least.select("w", "lo", "hi").distinct()
        tree = edges if tree is None else tree.unionByName(edges)
        roots = _united(least, save, one_task)
        parts = save(parts.join(roots, "part", "left").select("no", "at", "id", F.coalesce("root", "part").alias("part")))
    return save(tree) if tree is not None else save(vectors.sparkSession.createDataFrame([], _EDGE))


def contracted(tree: DataFrame, ids: DataFrame, least_size: int, save) -> tuple[DataFrame, DataFrame]:
    """(id, leaf, w, lo, hi): the large part that each row came to, and by which edge; and the edges (a, b, w, lo, hi) between large parts.

    A leaf is named by its least row at its beginning. Rows that come to no large part are left out.
    """
    parts, edges, came = save(ids.select("id", F.col("id").alias("part"))), tree, None
    while True:
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
        of = lambda end, name: parts.join(sizes, "part").select(F.col("id").alias(end), F.col("part").alias(name), F.col("n").alias(f"n_{name}"))
        edges = save(edges.select("w", "lo", "hi").join(of("lo", "a"), "lo").join(of("hi", "b"), "hi").where("a <> b"))
        ways = edges.select(F.col("a").alias("part"), F.col("n_a").alias("n"), "w", "lo", "hi", F.col("b").alias("other"), F.col("n_b").alias("n_other"))
        ways = ways.unionByName(edges.select(F.col("b").alias("part"), F.col("n_b").alias("n"), "w", "lo", "hi", F.col("a").alias("other"), F.col("n_a").alias("n_other")))
        best = ways.where(F.col("n") < least_size).groupBy("part").agg(F.min(F.struct("w", "lo", "hi", "other", "n", "n_other")).alias("e")).select("part", "e.*")
        best = save(best)
        if best.isEmpty():
            return came if came is not None else parts.where("false").select("id", F.col("part").alias("leaf"), *(F.lit(0).cast(k).alias(c) for c, k in (("w", "double"), ("lo", "long"), ("hi", "long")))), edges
        back = best.select(F.col("part").alias("other"), F.col("lo").alias("lo_back"), F.col("hi").alias("hi_back"))
        met = best.join(back, "other", "left").withColumn("both", F.col("n_other") < least_size).where("NOT both OR (lo = lo_back AND hi = hi_back)")
        to = F.when(F.col("both"), F.least("part", "other")).otherwise(F.col("other"))
        moves = save(met.select("part", to.alias("to"), ((~F.col("both")) | (F.col("n") + F.col("n_other") >= least_size)).alias("large"), "w", "lo", "hi"))
        now = save(parts.join(moves, "part", "left"))
        new = now.where("large").select("id", F.col("to").alias("leaf"), "w", "lo", "hi")
        came = new if came is None else came.unionByName(new)
        parts = now.select("id", F.coalesce("to", "part").alias("part"))


class CondensedTree:
    """The tree of the edges between large parts: node, parent, and the edge at which a node joins its parent."""

    def __init__(self, leaves: list[int], edges: list[tuple]):
        self.at = {leaf: k for k, leaf in enumerate(leaves)}
        n = len(leaves)
        self.parent, self.edge = [-1] * n, [(np.inf, 0, 0)] * n
        top = {k: k for k in range(n)}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for a, b, w, lo, hi in sorted(edges, key=lambda e: e[2:]):
            x, y, new = find(self.at[a]), find(self.at[b]), len(self.parent)
            self.parent.append(-1)
            self.edge.append((np.inf, 0, 0))
            for c in (x, y):
                self.parent[c], self.edge[c], top[c] = new, (w, lo, hi), new
            top[new] = new

    def node_of(self, leaf: int, edge: tuple) -> int:
        """Which node a row fell out of, that came to the leaf's part by the edge."""
        k = self.at[leaf]
        while self.edge[k] < edge:
            k = self.parent[k]
        return k

    def chosen(self, sums: dict[int, tuple[int, float]]) -> list[int]:
        """For each node the cluster it belongs to, or -1. sums: of the rows that fell out of a node, how many, and their inverse distances added up.

        The whole tree is no cluster. A node's mass is how long its rows stay in it; a node is chosen when its mass is
        that of its chosen descendants or more.
        """
        n = len(self.parent)
        size, mass, best = [0] * n, [0.0] * n, [0.0] * n
        for k in range(n):  # children come before their parents
            rows, total = sums.get(k, (0, 0.0))  # a child's rows stay in the parent until the split, which is the child's birth
            size[k] += rows
            birth = inverse(self.edge[k][0])
            mass[k] += total - size[k] * birth
            if self.parent[k] >= 0:
                size[self.parent[k]] += size[k]
                mass[self.parent[k]] += size[k] * birth
        own, pick = [0.0] * n, [False] * n
        for k in range(n):
            pick[k] = self.parent[k] >= 0 and mass[k] >= best[k]
            own[k] = mass[k] if pick[k] else best[k]
            if self.parent[k] >= 0:
                best[self.parent[k]] += own[k]
        cluster = [-1] * n
        for k in reversed(range(n)):
            above = cluster[self.parent[k]] if self.parent[k] >= 0 else -1
            cluster[k] = above if above >= 0 else k if pick[k] else -1
        return cluster


def inverse(w: float) -> float:
    return min(1 / w, MOST_LAMBDA) if w > 0 else MOST_LAMBDA


def _node_task(tree: CondensedTree):
    def task(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tree.node_of(leaf, (w, lo, hi)) for _, leaf, w, lo, hi in rows], pa.int32()), pa.array([inverse(r[2]) for r in rows], pa.float64())], names=["id", "node", "lam"])

    return task


def hierarchical_clusters(vectors: DataFrame, min_cluster_size: int, min_samples: int, save, *, block: int = BLOCK, one_task: int = ONE_TASK) -> DataFrame:
    """page_id, cluster_id (-1: noise), probability over (page_id, vector), ids being different; a cluster is named by its least page.

    Rows without a vector are noise. A table of fewer than min_cluster_size rows, or without two clusters, is noise as a whole.
    """
    every = vectors.select(F.col("page_id").cast("long").alias("page_id"), "vector")
    rows = save(every.where("size(vector) > 0"))
    tree = spanning_tree(rows, min_samples, save, block=block, one_task=one_task)
    came, edges = contracted(tree, rows.select(F.col("page_id").alias("id")), min_cluster_size, save)
    came = save(came)
    leaves = [r[0] for r in came.select("leaf").distinct().orderBy("leaf").collect()]
    condensed = CondensedTree(leaves, [tuple(r) for r in edges.select("a", "b", "w", "lo", "hi").collect()])
    placed = save(came.select("id", "leaf", "w", "lo", "hi").mapInArrow(_node_task(condensed), "id long, node int, lam double"))
    sums = {r["node"]: (r["n"], r["s"], r["most"]) for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.sum("lam").alias("s"), F.max("lam").alias("most")).collect()}
    cluster = condensed.chosen({k: v[:2] for k, v in sums.items()})
    # the last that happens to a node: its split, or its last row
    split = {p: inverse(condensed.edge[k][0]) for k, p in enumerate(condensed.parent) if p >= 0}
    most = [split.get(k, sums.get(k, (0, 0.0, 0.0))[2]) for k in range(len(cluster))]
    model = [(k, c, float(most[c])) for k, c in enumerate(cluster) if c >= 0]
    named = placed.join(vectors.sparkSession.createDataFrame(model, "node int, cluster int, most double"), "node")
    names = named.groupBy("cluster").agg(F.min("id").alias("cluster_id"))
    found = named.join(names, "cluster").select(F.col("id").alias("page_id"), "cluster_id", F.least(F.lit(1.0), F.col("lam") / F.col("most")).alias("probability"))
    return every.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
