"""Density clusters of any density equal a plain version: all distances, one edge after the other, the tree cut from the top."""

import numpy as np
import pytest

from quern.operators import hierarchy as H
from quern.sources.store import saved


def plain(m, ids, least_size, min_samples):
    """{id: (cluster, probability)}, clusters as frozen sets of their ids; recursive, from the top of the tree down."""
    n = len(m)
    d = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2)), 9)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    edges = sorted((reach[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(n) for j in range(i))
    group, tree = list(range(n)), []
    for w, _, _, i, j in edges:
        if group[i] != group[j]:
            tree.append((w, i, j))
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    lam = lambda w: min(1 / w, H.MOST_LAMBDA) if w > 0 else H.MOST_LAMBDA

    def parts(rows, kept):
        of = {r: r for r in rows}
        for _, i, j in kept:
            if i in of and j in of:
                a, b = of[i], of[j]
                of = {r: a if g == b else g for r, g in of.items()}
        out = {}
        for r, g in of.items():
            out.setdefault(g, set()).add(r)
        return list(out.values())

    def condensed(rows, k, born):
        """(mass, chosen clusters below or at this node, rows with their inverse distances, last inverse)."""
        fell, mass = {}, 0.0
        for e in range(k, -1, -1):
            w, i, j = tree[e]
            if i not in rows:
                continue
            one, two = parts(rows, tree[:e])
            if len(one) >= least_size and len(two) >= least_size:
                mass += (len(rows)) * (lam(w) - born)
                below = [condensed(x, e - 1, lam(w)) for x in (one, two)]
                best = sum(b["best"] for b in below)
                every = {**fell, **below[0]["fell"], **below[1]["fell"]}
                clusters = below[0]["clusters"] + below[1]["clusters"]
                return {"mass": mass, "best": max(mass, best), "fell": every, "clusters": [(every, lam(w))] if mass >= best else clusters, "last": lam(w), "split": clusters}
            gone = [x for x in (one, two) if len(x) < least_size]
            for x in gone:
                for r in x:
                    fell[r] = lam(w)
                    mass += lam(w) - born
            rows = set() if len(gone) == 2 else (one if two in gone else two)
            if not rows:
                break
        return {"mass": mass, "best": mass, "fell": fell, "clusters": [(fell, max(fell.values()))], "last": max(fell.values()), "split": []}

    out = {i: (None, 0.0) for i in ids}
    if n >= least_size and tree:
        for fell, last in condensed(set(range(n)), len(tree) - 1, 0.0)["split"]:
            name = frozenset(ids[r] for r in fell)
            out.update({ids[r]: (name, min(1.0, x / last)) for r, x in fell.items()})
    return out


def clusters_of(df):
    rows = [tuple(r) for r in df.select("page_id", "cluster_id", "probability").collect()]
    members = {}
    for i, c, _ in rows:
        members.setdefault(c, set()).add(i)
    assert all(c == -1 or c == min(m) for c, m in members.items())
    return {i: (None if c == -1 else frozenset(members[c]), round(p, 9)) for i, c, p in rows}


def frame(spark, m, ids):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "page_id long, vector array<double>").repartition(2)


def blobs(seed, sizes, spreads, width=3, noise=15):
    rng = np.random.default_rng(seed)
    centres = 6 * rng.normal(size=(len(sizes), width))
    m = [c + s * rng.normal(size=(n, width)) for c, n, s in zip(centres, sizes, spreads, strict=True)]
    return np.concatenate([*m, rng.uniform(-9, 9, (noise, width))])


@pytest.mark.parametrize("seed, sizes, spreads, least, samples, one_task", [(1, (40, 30, 25), (0.2, 0.9, 2.0), 6, 4, 10**6), (2, (30, 30), (0.1, 1.5), 5, 3, 0)])
def test_blobs_of_unlike_density(spark, seed, sizes, spreads, least, samples, one_task):
    m = blobs(seed, sizes, spreads)
    m[3] = m[1] = m[0]  # equal rows
    ids = np.random.default_rng(seed).permutation(len(m)) * 3 + 1
    found = clusters_of(H.hierarchical_clusters(frame(spark, m, ids), least, samples, saved(spark), block=32, one_task=one_task))
    want = {i: (c, round(p, 9)) for i, (c, p) in plain(m, ids.tolist(), least, samples).items()}
    assert len({c for c, _ in want.values()}) > 2
    assert {i: c for i, (c, _) in found.items()} == {i: c for i, (c, _) in want.items()}
    assert all(found[i][1] == pytest.approx(want[i][1], abs=1e-8) for i in want)


def test_tables_too_small_or_without_vectors(spark):
    few = frame(spark, blobs(3, (3,), (1.0,), noise=0), range(3))
    assert {tuple(r) for r in H.hierarchical_clusters(few, 5, 3, saved(spark)).collect()} == {(i, -1, 0.0) for i in range(3)}
    none = spark.createDataFrame([(7, None), (8, [])], "page_id long, vector array<double>")
    assert {tuple(r) for r in H.hierarchical_clusters(none, 5, 3, saved(spark)).collect()} == {(7, -1, 0.0), (8, -1, 0.0)}
    assert H.hierarchical_clusters(none.where("false"), 5, 3, saved(spark)).count() == 0
