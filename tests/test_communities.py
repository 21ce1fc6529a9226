"""Communities reach a plain version's modularity and are connected."""

import random
from collections import defaultdict

import pytest

from quern.operators import communities as C
from quern.sources.store import saved


def modularity(edges, of, resolution=1.0):
    total = 2 * sum(w for _, _, w in edges)
    k, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        k[of[a]] += w
        k[of[b]] += w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - resolution * sum(x * x for x in k.values()) / total**2


def plain(nodes, edges, resolution=1.0):
    """One node after the other to its best community until none moves, then the same on the communities."""
    total = 2 * sum(w for _, _, w in edges)
    own = {n: n for n in nodes}
    while True:
        groups = sorted(set(own.values()))
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in edges:
            x, y = own[a], own[b]
            k[x] += w
            k[y] += w
            if x != y:
                near[x][y] += w
                near[y][x] += w
        of, sums, moved, any_move = {g: g for g in groups}, {g: k[g] for g in groups}, True, False
        while moved:
            moved = False
            for g in groups:
                ways = defaultdict(float)
                for o, w in near[g].items():
                    ways[of[o]] += w
                sums[of[g]] -= k[g]
                gain = lambda c: ways[c] - resolution * k[g] * sums.get(c, 0) / total  # noqa: B023, E731
                best = max([*ways, of[g]], key=lambda c: (gain(c), c == of[g]))
                if gain(best) > gain(of[g]) + 1e-12:
                    of[g], moved, any_move = best, True, True
                sums[of[g]] = sums.get(of[g], 0) + k[g]
        own = {n: of[g] for n, g in own.items()}
        if not any_move:
            return own


def connected(edges, members):
    beside = defaultdict(set)
    for a, b, _ in edges:
        beside[a].add(b)
        beside[b].add(a)
    seen, todo = set(), [next(iter(members))]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += beside[n] & members
    return seen == members


def planted(seed, groups=5, size=12, loose=40):
    rng = random.Random(seed)
    edges = {}
    for g in range(groups):
        for i in range(size):
            for j in range(i):
                if rng.random() < 0.5:
                    edges[g * size + j, g * size + i] = rng.uniform(0.5, 1)
    for _ in range(loose):
        a, b = sorted(rng.sample(range(groups * size), 2))
        edges[a, b] = rng.uniform(0.2, 0.6)
    return list(range(groups * size + 2)), [(a, b, w) for (a, b), w in edges.items()]


@pytest.mark.parametrize("seed, resolution, one_task", [(1, 1.0, 0), (2, 1.0, 10**6), (3, 2.5, 10**6)])
def test_as_good_as_a_plain_version(spark, monkeypatch, seed, resolution, one_task):
    monkeypatch.setattr(C, "LEAST_SHARE", 1 / 4)
    monkeypatch.setattr(C, "REFINEMENTS", 3)
    nodes, edges = planted(seed)
    n, e = spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(edges, "a long, b long, weight double")
    of = dict(tuple(r) for r in C.communities(n, e, saved(spark), resolution=resolution, one_task=one_task).select("id", "community").collect())
    assert set(of) == set(nodes)
    groups = defaultdict(set)
    for i, c in of.items():
        groups[c].add(i)
    assert all(c == min(m) and connected(edges, m) for c, m in groups.items())
    assert len(groups[nodes[-1]]) == 1
    q = modularity(edges, of, resolution)
    assert q >= 0.98 * modularity(edges, plain(nodes, edges, resolution), resolution)
    again = e.withColumnRenamed("weight", "w")
    assert C.quality(again, spark.createDataFrame(list(of.items()), "id long, community long"), resolution) == pytest.approx(q)


def test_graphs_of_no_edges(spark):
    n = spark.createDataFrame([(1,), (2,), (None,), (2,)], "id long")
    e = spark.createDataFrame([(1, 2, 0.0), (None, 2, 1.0)], "a long, b long, weight double")
    assert sorted(map(tuple, C.communities(n, e, saved(spark)).collect())) == [(1, 1), (2, 2)]
