import itertools
import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import clustering as C
from quern.operators import entities as E
from quern.operators import jobs as J
from quern.operators import metrics as K
from quern.operators import retrieval as R
from quern.operators import timeseries as T
from quern.sources.store import saved


def arm(spark, *ids, q=1):
    return spark.createDataFrame([(q, i, r) for r, i in enumerate(ids, 1)], "query_id int, chunk_id string, rank int")


def test_fusion_prefers_what_both_arms_have(spark):
    rows = R.rrf_fuse([arm(spark, "a", "b"), arm(spark, "b", "c")]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def scored(spark):
    return spark.createDataFrame([(1, "c1", "p1", 0.5, None), (1, "c2", "p1", 0.4, 0.9), (1, "c3", "p2", 0.6, 0.1)], "query_id int, chunk_id string, page_id string, fusion double, rerank double")


def test_rollups(spark):
    best = lambda how, m=3: [(r.page_id, r.score) for r in R.rollup(scored(spark), how, m).orderBy("rank").collect()]
    assert best("max") == [("p1", 0.9), ("p2", 0.1)]
    assert best("mean_top_m", 2) == [("p1", 0.7), ("p2", 0.1)]
    assert best("sum_rrf") == [("p1", 0.9), ("p2", 0.6)]
    with pytest.raises(ValueError):
        R.rollup(scored(spark), "median")


def test_decay_halves_and_leaves_unknown_pages(spark):
    s = spark.createDataFrame([(1, "old", 1.0, 1), (1, "new", 0.6, 2), (1, "none", 0.55, 3)], "query_id int, page_id string, score double, rank int")
    seen = spark.sql("SELECT 'old' page_id, timestamp_ntz'2024-01-01' first_seen_at UNION ALL SELECT 'new', timestamp_ntz'2024-02-05'")
    got = R.recency_decay(s, seen, F.expr("timestamp_ntz'2024-01-31'"), 30).orderBy("rank").collect()
    assert [(r.page_id, r.score) for r in got] == [("new", 0.6), ("none", 0.55), ("old", 0.5)]


def test_slices_part_the_ranking(spark):
    df = R.rollup(spark.createDataFrame([(1, str(i), str(i), 1.0 / (i + 1)) for i in range(25)], "query_id int, chunk_id string, page_id string, fusion double"))
    parts = [[r.page_id for r in R.page_slice(df, o, 10).collect()] for o in (0, 10, 20)]
    assert sum(map(len, parts)) == 25 and len(set(itertools.chain(*parts))) == 25
    assert R.page_slice(df, 10, 10).first().has_more and not R.page_slice(df, 20, 10).first().has_more


def test_empty_id_filter_leaves_nothing(spark):
    p = spark.sql("SELECT 1 page_id, 'd' domain, timestamp_ntz'2024-01-01' first_seen_at, 'indexed' status")
    assert R.page_filter(p, ids=p.select("page_id").where("false")).count() == 0
    assert R.page_filter(p, after="2024-01-01", before="2024-01-02").count() == 1
    assert R.page_filter(p, before="2024-01-01").count() == 0


def test_dense_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    df = lambda m, c: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{c} long, vector array<double>").repartition(3)
    got = R.dense_topk(df(q, "query_id"), df(v, "chunk_id"), 7, block=40).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit(q) @ unit(v).T), axis=1)[:, :7]
    assert {(r.query_id, r.rank): r.chunk_id for r in got} == {(i, k + 1): int(want[i, k]) for i in range(5) for k in range(7)}


def test_dense_ties_break_on_the_id(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], "chunk_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(1, [2.0, 1.0])], "query_id long, vector array<double>")
    got = R.dense_topk(q, v, 25, block=7).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [i for i in range(60) if i % 3 == 2] + [i for i in range(60) if i % 3 == 1][:5]
    # queries beyond the bound are dealt out by a shuffle, with the same result
    assert R.dense_topk(q, v, 25, block=7, most_bytes=0).orderBy("rank").collect() == got


def test_bm25_both_ways(spark):
    docs = spark.createDataFrame([(1, "zebra"), (2, "plum plum plum"), (3, "plum and some other words here"), (5, "plum plum plum"), (4, None), (6, "")], "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "Plum"), (2, "words, plum and zebra"), (3, "nothing"), (4, "")], "query_id long, text string")
    one = R.bm25_topk(q, docs, 3, save=saved(spark)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in one] == [(1, 2), (1, 5), (1, 3), (2, 3), (2, 1), (2, 2)]
    joined = R.bm25_topk(q, docs, 3, save=saved(spark), most_terms=0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, round(r.score, 9)) for r in joined] == [(r.query_id, r.chunk_id, round(r.score, 9)) for r in one]
    small = R.bm25_topk(q, docs, 3, save=saved(spark), cells=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in small] == [tuple(r) for r in one]
    among = docs.where("chunk_id > 2").select("chunk_id")
    for most in (500_000, 0):
        got = R.bm25_topk(q, docs, 3, save=saved(spark), among=among, most_terms=most).where("query_id = 1").orderBy("rank").collect()
        assert [(r.chunk_id, round(r.score, 9)) for r in got] == [(c, round(next(x.score for x in one if (x.query_id, x.chunk_id) == (1, c)), 9)) for c in (5, 3)]


def test_phrases(spark):
    p = spark.createDataFrame([("near", "small boats and harbours"), ("far", "boats for the small harbours")], "chunk_id string, text string")
    assert [r.chunk_id for r in R.phrase_match(spark.createDataFrame([(1, "Small boats"), (2, "")], "query_id int, phrase string"), p).collect()] == ["near"]


def test_keywords_count_clusters_without_any(spark):
    docs = spark.createDataFrame([(1, "harbour harbour boat"), (2, "lantern"), (3, ""), (4, "the a")], "cluster_id int, text string")
    got = {(r.cluster_id, r.term): r.score for r in C.class_tfidf(docs).collect()}
    assert got[1, "harbour"] == pytest.approx(2 / 3 * math.log(1 + (4 / 4) / 2)) and got[2, "lantern"] == pytest.approx(math.log(2))


def test_greedy_links_match_a_plain_loop(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] / max(len(a), len(b))

    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), "".join(rnd.choice("xyz") for _ in range(rnd.randint(3, 6))), i) for i in range(60)]
    got = {(r.block_key, r.form): r.linked for r in E.link_greedily(spark.createDataFrame(rows, "block_key string, form string, first_seen long"), saved(spark), 0.3).collect()}
    want = {}
    for block in "ab":
        kept = []
        for form in dict.fromkeys(f for b, f, _ in rows if b == block):
            hit = next((k for k in kept if distance(form, k) <= 0.3), None)
            if hit is None:
                kept.append(form)
            want[block, form] = hit or form
    assert got == want
    with pytest.raises(ValueError):
        E.link_greedily(spark.createDataFrame(rows, "block_key string, form string, first_seen long"), saved(spark), 1.0)


def test_links_to_known_entities(spark):
    forms = spark.createDataFrame([("t", "k", "k river"), ("t", "k", "k rivers"), ("t", "k", "k other name"), ("t", "k", "k alone")], "type string, block_key string, form string")
    known = spark.createDataFrame([("t", "k", 2, "k river"), ("t", "k", 1, "k rivrs"), ("t", "k", 3, "k what it is called")], "type string, block_key string, entity_id int, form string")
    near = spark.createDataFrame([("t", "k other name", "k what it is called", 0.9), ("t", "k alone", "k what it is called", 0.8)], "type string, form string, other string, cosine double")
    assert {r.form: r.entity_id for r in E.link_to_known(forms, known, cosine=near).collect()} == {"k river": 2, "k rivers": 1, "k other name": 3}


def ranking(spark, *items):
    return spark.createDataFrame([(1, x, i) for i, x in enumerate(items, 1)], "query_id int, item string, rank int")


def rbo(a, b, p=0.9):
    s, l = sorted((a, b), key=len)
    x = lambda d: len(set(s[:d]) & set(l[:d]))
    n, m = len(s), len(l)
    total = sum(x(d) / d * p**d for d in range(1, m + 1)) + sum(x(n) * (d - n) / (n * d) * p**d for d in range(n + 1, m + 1))
    return (1 - p) / p * total + ((x(m) - x(n)) / m + x(n) / n) * p**m


@pytest.mark.parametrize(("a", "b"), [("abc", "abc"), ("abc", "cba"), ("abcde", "ab"), ("ab", "xy"), ("a", "abcdef")])
def test_agreement(spark, a, b):
    x, y = ranking(spark, *a), ranking(spark, *b)
    assert K.rank_biased_overlap(x, y).first().rbo == pytest.approx(rbo(a, b))
    assert K.rank_biased_overlap(y, x).first().rbo == pytest.approx(rbo(a, b))
    common = [c for c in a if c in b]
    got = K.kendall_tau(x, y).collect()
    if len(common) >= 2:
        signs = [math.copysign(1, b.index(q) - b.index(p)) for p, q in itertools.combinations(common, 2)]
        assert got[0].tau == pytest.approx(sum(signs) / len(signs))
    else:
        assert not got or got[0].tau is None


def test_relevance(spark):
    ranks = ranking(spark, *"abcd")
    rel = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "query_id int, item string")
    r = K.relevance(ranks, rel, 3).first()
    assert r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5), abs=1e-6)
    assert (r.rr, r.recall) == (0.5, pytest.approx(1 / 3, abs=1e-6))
    none = K.relevance(ranks, rel.where("false"), 3).first()
    assert (none.ndcg, none.rr, none.recall) == (None, 0.0, None)


def test_jaccard_of_empty_lists(spark):
    df = spark.sql("SELECT array('a','b') a, array('b','c') b, cast(array() as array<string>) e")
    assert df.select(K.jaccard_at_k(F.col("a"), F.col("b"), 2)).first()[0] == pytest.approx(1 / 3)
    assert df.select(K.jaccard_at_k(F.col("e"), F.col("e"), 2)).first()[0] == 1.0


def test_quantiles_interpolate(spark):
    r = T.latency_quantiles(spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "total double")).first()
    assert (r.p50, r.p95) == (200.0, 290.0)
    assert T.latency_quantiles(spark.createDataFrame([], "total double")).first().p50 is None


def test_counter_resets(spark):
    rows = [(1, 0, 5.0), (2, 50, 8.0), (3, 100, 2.0), (4, 150, 6.0), (5, 250, 7.0)]
    df = spark.createDataFrame(rows, "event_id int, s int, value double").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value", F.lit("m").alias("metric"))
    assert [r.delta for r in T.counter_delta(df, 100, ["metric"]).orderBy("bucket").collect()] == [3.0, 0.0, 1.0]


def test_blacklist_prefers_urls_then_newest(spark):
    pages = spark.createDataFrame([(1, "http://a.b.example/x", "a.b.example"), (2, "http://b.example/", "b.example"), (3, "http://notb.example", "notb.example")], "page_id int, url string, domain string")
    rules = spark.createDataFrame([(1, "domain", "b.example", 1), (2, "domain", "a.b.example", 2), (3, "url", "http://b.example/", 0)], "rule_id int, kind string, pattern string, created_at int")
    assert {r.page_id: r.rule_id for r in J.blacklist_match(pages, rules).collect()} == {1: 2, 2: 3}


def test_upsert_and_insert(spark):
    t, d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert dict(map(tuple, J.upsert(t, d, ["k"]).collect())) == {1: "a", 2: "B", 3: "C"}
    assert dict(map(tuple, J.insert_new(t, d, ["k"]).collect())) == {1: "a", 2: "b", 3: "C"}


def test_breaker(spark):
    rows = [(1, i, s, ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, False), (10, True), (70, False), (80, True), (140, True), (141, False)])]
    df = spark.createDataFrame(rows, "breaker long, pos int, s int, ok boolean").select("breaker", "pos", F.timestamp_seconds("s").alias("ts"), "ok")
    r = J.fold_breaker(df).first()
    assert (r.state, r.failures) == ("closed", 1)


def test_merge_and_undo(spark):
    m = spark.createDataFrame([(1, 10, "a", 0), (2, 10, "a", 0), (2, 11, "b", None), (2, 11, "b", None), (1, 12, "c", 3)], "entity_id long, page_id long, surface_form string, char_start int")
    now = E.apply_merges(m, spark.createDataFrame([(2, 1)], "source long, target long"))
    assert sorted(map(tuple, now.collect()), key=repr) == sorted([(1, 10, "a", 0), (1, 11, "b", None), (1, 11, "b", None), (1, 12, "c", 3)], key=repr)
    assert sorted(map(tuple, E.undo_merge(now, m, 2, 1).collect()), key=repr) == sorted(map(tuple, m.collect()), key=repr)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 30, 31, 40]], "entity_id long")
    got = {r.entity_id: r.component for r in E.components(edges, nodes, saved(spark)).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40}


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6)]:
        cost = rng.random((n, m)).round(2)
        got = sum(cost[a, b] for a, b in C.assign(cost))
        small, large = (cost, m) if n <= m else (cost.T, n)
        assert got == pytest.approx(min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small))))


def test_lineage_keeps_the_least_total(spark):
    """Crossed pairs cost less in all although one straight pair would do: nothing persists."""
    run = lambda *sets: spark.createDataFrame([(p, c) for c, s in enumerate(sets, 1) for p in s], "page_id int, cluster_id long")
    got = C.lineage(run({1, 2, 4}, {3}), run({1, 2, 3}, {4})).collect()
    assert "persisted" not in {r.event for r in got}
    same = C.lineage(run({1, 2}, {3, 4}), run({1, 2}, {3, 4, 5})).collect()
    assert sorted((r.event, r.cluster_id, r.other) for r in same) == [("persisted", 1, "1"), ("persisted", 2, "2")]


def test_density_clusters(spark):
    rng = np.random.default_rng(0)
    axes = np.eye(6)[:2]
    v = np.concatenate([a + rng.normal(0, 0.05, (20, 6)) for a in axes] + [[[0, 0, 0, 0, 0, 1.0]]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "page_id long, vector array<double>")
    got = {r.page_id: r.cluster_id for r in C.density_clusters(df, 0.2, 4, saved(spark)).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[i] for i in range(20, 40)} == {20} and got[40] == -1


@pytest.mark.parametrize("block", [7, 2048])
def test_density_clusters_match_brute_force(spark, block):
    """Groups of copies, blobs that touch, a bridge of copies between two blobs, and pages without a vector."""
    rng = np.random.default_rng(4)
    at = lambda angle: [math.cos(angle), math.sin(angle), 0.0]
    v = [at(a) for a in [*rng.normal(0, 0.002, 15), *rng.normal(0.1, 0.002, 15), *[0.2] * 9, *[0.295] * 9, *rng.normal(1, 0.05, 20), *rng.uniform(1.5, 3, 25)]]
    v = [v[i] for i in rng.permutation(len(v))]
    df = spark.createDataFrame([*enumerate(v), (900, None), (901, [])], "page_id long, vector array<double>").repartition(3)
    eps, least = 1 - math.cos(0.11), 5
    near = np.round(np.array(v) @ np.array(v).T, 9) >= 1 - eps
    core, want = near.sum(axis=1) - 1 >= least, {}
    for i in np.flatnonzero(core):
        todo = [] if i in want else [i]
        while todo:
            if (k := todo.pop()) not in want:
                want[k] = i
                todo += np.flatnonzero(near[k] & core).tolist()
    want |= {i: want[np.flatnonzero(near[i] & core)[0]] if (near[i] & core).any() else -1 for i in np.flatnonzero(~core)}
    got = {r.page_id: r.cluster_id for r in C.density_clusters(df, eps, least, saved(spark), block=block).collect()}
    assert got == {**{int(k): int(x) for k, x in want.items()}, 900: -1, 901: -1}
    assert len(set(got.values()) - {-1}) < 6


def test_entry_without_the_llm_subpackage(tmp_path):
    """The entry module imports and lists the engine's queries when quern.llm is gone."""
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "quern"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    (tmp_path / "quern").mkdir()
    for p in (root / "quern").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quern" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    names, oracles = json.loads(out.stdout)
    assert "hybrid_search" in names and not [n for n in names if n.startswith("op")] and "hybrid_search" in oracles
