"""Queries as they run on larger tables: without broadcasts, in bounded pieces."""

import contextlib
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import entities as E
from quern.operators import sparse as SX
from quern.operators.retrieval import dense_topk, ranked
from quern.plans import catalogue
from quern.sources.store import saved, work_dir
from test_catalogue import TABLES, rows


@contextlib.contextmanager
def conf(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same_as_twin(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, twin = catalogue.QUERIES[name](spark, data), con.execute(catalogue.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in twin.description], twin.fetchall())


@pytest.mark.parametrize("name", ["compare_models"])
def test_without_broadcasts(spark, data, name):
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        same_as_twin(spark, data, name)


@pytest.mark.parametrize("seed, lightest, block", [(1, 0, 3), (2, -3, 2), (3, 1, 128)])
def test_most_similar_pages_are_those_of_all_pairs(spark, seed, lightest, block):
    """Weights of nought, below it (2) and none; mentions twice and without a page; queries of one entity and with few pages beside them."""
    rng = random.Random(seed)
    mentions = [(p, min(int(rng.expovariate(0.25)), 30)) for p in range(150) for _ in range(rng.randrange(1, 6))] + [(None, 1), (7, 99), (8, 98), (9, 98)]
    weights = [(e, rng.choice([float(lightest), 0.5, 1.5, round(rng.uniform(0, 3), 6)])) for e in range(25)]
    m = spark.createDataFrame(mentions, "page_id long, entity_id long")
    w, q = spark.createDataFrame(weights, "entity_id long, idf double"), spark.createDataFrame([(p,) for p in range(0, 160, 3)], "page_id long")
    all_pairs = ranked(E.entity_similarity(m, w, q), ["query_id"], "score", "page_id", 4)
    found = E.most_similar(m, w, q, 4, saved(spark), block=block)
    key = lambda df: sorted((r["query_id"], r["rank"], r["page_id"], r["score"]) for r in df.collect())
    assert key(found) == key(all_pairs)


def test_entity_similarity_does_not_make_all_pairs(spark, data):
    """Its join meets entries whose bounds reach a query's last place, by entity and block; not all pages of an entity."""
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = catalogue.QUERIES["entity_similarity"](spark, data)
        assert df.count() == 300
        assert "block" in df._jdf.queryExecution().optimizedPlan().toString()
        same_as_twin(spark, data, "entity_similarity")


def test_many_queries_meet_the_vectors_in_parts(spark):
    """Equal rows, ties, zero vectors, parts and blocks of a few rows: as by broadcast blocks."""
    rng = random.Random(4)
    v = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(230)] + [(i, None) for i in range(230, 234)] + [(300 + i, [1.0, 1.0, 0.0, 1 / 3]) for i in range(20)]
    df = spark.createDataFrame(v, "chunk_id long, vector array<float>")
    q = df.withColumnRenamed("chunk_id", "query_id")
    found = lambda r: sorted((x["query_id"], x["rank"], x["chunk_id"], round(x["score"], 12)) for x in r.collect())
    want = found(dense_topk(q, df, 6))
    assert found(dense_topk(q, df, 6, most_bytes=0, most=40, block=16)) == want == found(dense_topk(q, df, 6, most_bytes=0))
    # no row holds two blocks
    plan = dense_topk(q, df, 6, most_bytes=0, most=40)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_places_take_two_bytes_and_a_merge_finds_them(spark):
    """Places of 65,536 and more, beside others, take four."""
    far = [(i, "x " * (65_530 if i == 3 else 3) + " ".join(["seen twice"] * 8)) for i in range(6)]
    more = [(i, "seen twice or seen thrice") for i in range(6, 30)]
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1)
    index = SX.add(SX.create(frame(far), f"{work_dir(spark)}/sparse-{uuid.uuid4().hex}"), frame(more))
    phrase = spark.createDataFrame([(1, "seen twice seen"), (2, "twice or"), (3, "x seen")], "query_id long, phrase string")
    want = {*((1, i) for i in range(6)), *((2, i) for i in range(6, 30)), *((3, i) for i in range(6))}
    bytes_of = lambda index: {r["term"]: r["n"] for r in index.postings().groupBy("term").agg(F.sum(F.length("places")).alias("n")).collect()}
    for changed in (index, SX.merge(index)):
        assert {tuple(r) for r in SX.phrases(changed, phrase, save=saved(spark)).collect()} == want
        size = bytes_of(changed)
        assert size["thrice"] == 2 * 24 and size["x"] == 2 * (65_530 + 15)
    assert bytes_of(index)["twice"] == 4 * 48 + 2 * 24
