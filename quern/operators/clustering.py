"""Topic clusters: parameters, fits, keywords, and identifiers that stay stable between runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import keyword_tokens


def density_params(n: Column) -> tuple[Column, Column]:
    """(min_cluster_size, min_samples) for n pages; halves round to even."""
    size = F.greatest(F.lit(5), F.least(F.lit(25), F.bround(F.sqrt(n.cast("double")) / 2).cast("int")))
    return size, F.greatest(F.lit(3), F.least(F.lit(15), F.floor(size / 2).cast("int")))


def kmeans_k(n: int) -> int:
    return min(n, max(1, int((n / 2) ** 0.5)))


def kmeans(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """page_id, cluster_id, probability 1.0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("page_id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    fitted = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(data)
    return fitted.transform(data).select("page_id", "cluster_id", F.lit(1.0).alias("probability"))


def projection(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """page_id, x, y: principal components of the vectors; their signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("page_id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    out = PCA(k=dims, inputCol="features", outputCol="p").fit(data).transform(data)
    return out.select("page_id", vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y"))


def class_tfidf(docs: DataFrame, top: int = 10) -> DataFrame:
    """cluster_id, term, score, rank over (cluster_id, text): tf / all of the cluster * ln(1 + words a cluster / f_t)."""
    words = docs.select("cluster_id", F.explode(keyword_tokens(F.col("text"))).alias("term"))
    tf = words.groupBy("cluster_id", "term").agg(F.count("*").alias("tf"))
    total = tf.groupBy("cluster_id").agg(F.sum("tf").alias("n"))
    # the mean is over all clusters, those without a keyword too
    mean = total.agg(F.sum("n").alias("a")).crossJoin(docs.agg(F.count_distinct("cluster_id").alias("c"))).select((F.col("a") / F.col("c")).alias("a"))
    ft = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    score = F.col("tf") / F.col("n") * F.log(1 + F.col("a") / F.col("f"))
    scored = tf.join(ft, "term").join(total, "cluster_id").crossJoin(mean).select("cluster_id", "term", score.alias("score"))
    # the best of each of 32 parts first, so that no cluster's whole vocabulary meets in one sort
    part = F.pmod(F.xxhash64("term"), F.lit(32)).alias("part")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "term"))
    some = scored.select("*", part).withColumn("rank", best("cluster_id", "part")).where(F.col("rank") <= top)
    return some.withColumn("rank", best("cluster_id").cast("long")).where(F.col("rank") <= top).select("cluster_id", "term", "score", "rank")


def label_of(keywords: DataFrame, n: int = 5) -> DataFrame:
    """A cluster's first keywords as its label."""
    rows = keywords.where(F.col("rank") <= n).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("x"))
    return rows.select("cluster_id", F.array_join(F.transform("x", lambda r: r["term"]), ", ").alias("label"))


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, both, jaccard of every pair of clusters with a page in common; all others have 0."""
    sizes = lambda df, name: df.groupBy("cluster_id").agg(F.count("*").alias(name))
    both = old.select("page_id", F.col("cluster_id").alias("old_id")).join(new.select("page_id", F.col("cluster_id").alias("new_id")), "page_id").groupBy("old_id", "new_id").agg(F.count("*").alias("both"))
    r = both.join(sizes(old, "n_old").withColumnRenamed("cluster_id", "old_id"), "old_id").join(sizes(new, "n_new").withColumnRenamed("cluster_id", "new_id"), "new_id")
    return r.select("old_id", "new_id", "both", "n_old", "n_new", F.round(F.col("both") / (F.col("n_old") + F.col("n_new") - F.col("both")), 6).alias("jaccard"))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths; for the few clusters of one connected part."""
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assign(cost.T))
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            row, free = match[col], np.flatnonzero(~used[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < low[free]
            low[free[better]], way[free[better]] = slack[better], col
            nxt = free[np.argmin(low[free])]
            delta = low[nxt]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col], col = match[way[col]], way[col]
    return sorted((int(match[c]) - 1, c - 1) for c in range(1, m + 1) if match[c])


def lineage(old: DataFrame, new: DataFrame, *, persist: float = 0.5, parent: float = 0.3, absorb: float = 0.5) -> DataFrame:
    """event, cluster_id, other, jaccard: what became of the clusters of one run in the next.

    persisted: paired by the least total of 1 - Jaccard and at `persist` or more, other is the new cluster's number in
    its run; split: an unpaired new cluster with old ones above `parent` (other lists them); created: without; merged: an
    unpaired old one of whose members more than `absorb` are in new ones (other lists them); dissolved: else. The table
    of overlaps is a few rows a cluster and not a row a page; the pairing over all clusters of a run is made from it.
    """
    pairs = overlaps(old, new).toPandas()
    olds = [r[0] for r in old.select("cluster_id").distinct().orderBy("cluster_id").collect()]
    news = [r[0] for r in new.select("cluster_id").distinct().orderBy("cluster_id").collect()]
    j = np.zeros((len(news), len(olds)))
    at_new, at_old = {c: i for i, c in enumerate(news)}, {c: i for i, c in enumerate(olds)}
    share = np.zeros_like(j)
    for r in pairs.itertuples():
        j[at_new[r.new_id], at_old[r.old_id]] = r.jaccard
        share[at_new[r.new_id], at_old[r.old_id]] = r.both / r.n_old
    kept = {a: b for a, b in (assign(1 - j) if news and olds else []) if j[a, b] >= persist}
    rows = [("persisted", olds[b], str(news[a]), float(j[a, b])) for a, b in kept.items()]
    for a, c in enumerate(news):
        if a not in kept:
            parents = [olds[b] for b in np.flatnonzero(j[a] > parent)]
            rows.append(("split" if parents else "created", c, ",".join(map(str, parents)) or None, None))
    for b, c in enumerate(olds):
        if b not in kept.values():
            into = [news[a] for a in np.flatnonzero(share[:, b] > absorb)]
            rows.append(("merged" if into else "dissolved", c, ",".join(map(str, into)) or None, None))
    return old.sparkSession.createDataFrame(rows, "event string, cluster_id long, other string, jaccard double")


def _unit_blocks(rows: int):
    """(id, vector, weight) to blocks of at most `rows`: ids, weights and one matrix scaled to unit length."""

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                m = np.array(part.column(1).to_pylist(), float)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                lists = [pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([(m / np.where(n == 0, 1, n)).tobytes()], pa.binary())], names=["ids", "weights", "matrix"])

    return task


def _counted(near: np.ndarray, ids: np.ndarray, others: np.ndarray, weights: np.ndarray):
    """Of each row: the weight of the others near it, without itself."""
    n = near @ weights - (near & (ids[:, None] == others)).any(axis=1)
    return ids[n > 0], n[n > 0]


def _least(near: np.ndarray, ids: np.ndarray, others: np.ndarray, weights: np.ndarray):
    """Of each row: the least of the others near it."""
    some = near.any(axis=1)
    return ids[some], np.where(near[some], others, np.iinfo(np.int64).max).min(axis=1)


def _forest(near: np.ndarray, ids: np.ndarray, others: np.ndarray, weights: np.ndarray):
    """Links, fewer than there are rows on both sides, that connect what the near pairs connect."""
    here, there, out = np.zeros(len(ids), bool), np.zeros(len(others), bool), ([], [])
    for start in np.flatnonzero(near.any(axis=1)):
        front = np.zeros(0, int) if here[start] else np.array([start])
        here[front] = True
        while len(front):
            across = np.flatnonzero(near[front].any(axis=0) & ~there)
            there[across] = True
            front = np.flatnonzero(near[:, across].any(axis=1) & ~here)
            here[front] = True
            found = np.concatenate([others[across], ids[front]])
            found = found[found != ids[start]]
            out[0].append(np.full(len(found), ids[start]))
            out[1].append(found)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


def _near_task(reach: float, how):
    """`how` of each pair of blocks, as rows (a, b)."""

    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q, c = (np.frombuffer(r[k]).reshape(len(r[i]), -1) for k, i in (("q_matrix", "q_ids"), ("matrix", "ids")))
                a, b = how(np.round(q @ c.T, 9) >= reach, np.array(r["q_ids"]), np.array(r["ids"]), np.array(r["weights"]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return task


def density_clusters(vectors: DataFrame, eps: float, min_samples: int, save, *, cell: float | None = None, block: int = 2048) -> DataFrame:
    """page_id, cluster_id (-1: noise): density clusters of unit vectors whose cosine distance is eps or less.

    Pages with min_samples neighbours are cores; cores that are near each other make a cluster, named by its least core;
    other pages go with the least near core. All neighbours within eps count: equal vectors are one row of their number,
    and from each pair of blocks go on counts, then links that connect the same cores as all near pairs do, and not the
    pairs. A variable-density hierarchy has no distributed form here; this is its cut at one distance.
    """
    from quern.operators.entities import components

    v = vectors.select(F.col("page_id").cast("long").alias("page_id"), "vector")
    groups = save(v.where(F.size("vector") > 0).groupBy("vector").agg(F.min("page_id").alias("id"), F.count("*").alias("n")).select("id", "vector", "n"))

    def blocks(rows: DataFrame) -> DataFrame:
        # kept, so that both sides of a pair are cut alike
        return save(rows.select("id", "vector", "n").mapInArrow(_unit_blocks(block), "ids array<long>, weights array<long>, matrix binary"))

    def near(asked: DataFrame, among: DataFrame, how, where: str = "true") -> DataFrame:
        q = asked.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        return among.crossJoin(q).where(where).mapInArrow(_near_task(1 - eps, how), "a long, b long")

    every = blocks(groups)
    cores = save(near(every, every, _counted).groupBy("a").agg(F.sum("b").alias("near")).where(F.col("near") >= min_samples).select(F.col("a").alias("id")))
    inner = blocks(groups.join(cores, "id", "left_semi"))
    names = components(near(inner, inner, _forest, "q_ids[0] <= ids[0]"), cores.select(F.col("id").alias("entity_id")), save)
    border = near(blocks(groups.join(cores, "id", "left_anti")), inner, _least).groupBy("a").agg(F.min("b").alias("entity_id"))
    owned = names.select(F.col("entity_id").alias("id"), "component").unionByName(border.join(names, "entity_id").select(F.col("a").alias("id"), "component"))
    of_vector = groups.join(owned, "id").select("vector", "component")
    return v.join(of_vector, "vector", "left").select("page_id", F.coalesce("component", F.lit(-1)).alias("cluster_id"))


def idle_threshold_s(runs: DataFrame) -> DataFrame:
    """Seconds of quiet before a run: three medians of the last five runs' milliseconds, between 5 and 60 minutes; 15 minutes without runs."""
    last = runs.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(5)
    s = F.median("duration_ms") * 3 / 1000
    return last.agg(F.coalesce(F.greatest(F.lit(300.0), F.least(F.lit(3600.0), s)), F.lit(900.0)).alias("threshold_s"))
