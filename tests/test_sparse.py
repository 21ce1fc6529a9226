"""The stored sparse index equals a search over the texts, before and after any change, and reads what it has to."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.operators import sparse as X
from quern.sources.store import saved, work_dir


def texts(seed, ids, words=60):
    rng = random.Random(seed)
    pick = lambda: f"w{min(int(rng.expovariate(0.08)), words)}"
    return [(i, None if i % 41 == 7 else " ".join(pick() for _ in range(rng.randrange(0, 40))) + (" Ünïcode-İ K4 The THE" if i % 9 == 0 else "")) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)


def new(spark):
    return f"{work_dir(spark)}/sparse-{uuid.uuid4().hex}"


QUERIES = [(1, "w1 w2 w40"), (2, "w0"), (3, "the K4 i nicode"), (4, "unknown words"), (5, ""), (6, None), (7, "w3 w3 w5 w8 w13 w21 w34"), (8, "W59 w60 w58")]


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def by_texts(spark, queries, rows, limit, among=None):
    return found(R.bm25_topk(queries, frame(spark, rows), limit, save=saved(spark), among=among))


def phrase_hits(rows):
    tokens = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    hits = set()
    for q, p in PHRASES:
        want = tokens(p)
        for i, t in rows:
            have = tokens(t)
            if want and any(have[k : k + len(want)] == want for k in range(len(have))):
                hits.add((q, i))
    return hits


PHRASES = [(1, "w1 w2"), (2, "the the"), (3, "w0 w0 w0"), (4, "K4"), (5, "w1 unknown"), (6, "..."), (7, None), (8, "w2 w1 w2")]


@pytest.fixture
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


@pytest.mark.parametrize("most, first", [(16, 2)])
def test_searches_equal_those_of_the_texts_through_all_changes(spark, queries, most, first):
    asked = spark.createDataFrame(PHRASES, "query_id long, phrase string")

    def same(index, rows):
        rows = list(rows.items())
        assert found(X.bm25(index, queries, 5, save=saved(spark), first=first)) == by_texts(spark, queries, rows, 5)
        assert {tuple(r) for r in X.phrases(index, asked, save=saved(spark)).collect()} == phrase_hits(rows)
        n, mean = index.totals()
        assert n == len(rows) and mean == pytest.approx(sum(len(X.tokens_of(t)) for _, t in rows) / max(1, len(rows)))

    rows = dict(texts(1, range(200)))
    index = X.create(frame(spark, list(rows.items())), new(spark), most=most)
    same(index, rows)
    more = dict(texts(2, range(200, 260)))
    before, index = index, X.add(index, frame(spark, list(more.items())), most=most)
    same(index, rows | more)
    same(before, rows)
    changed = dict(texts(3, range(150, 230)))
    rows = rows | more | changed
    index = X.replace(index, frame(spark, list(changed.items())), most=most)
    same(index, rows)
    gone = [*range(0, 90, 2), 225, 999]
    index = X.forget(index, spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
    rows = {i: t for i, t in rows.items() if i not in gone}
    same(index, rows)
    index = X.merge(index, most=most, groups=2)
    same(index, rows)
    assert index.blocks().where("size(dead) > 0").count() == 0 and len(index.segments) == 1
    assert index.blocks().selectExpr("max(size(ids))").first()[0] <= most
    assert index.postings().groupBy("term", "block").count().where("count > 1").count() == 0
    assert X.open_index(spark, index.path) == index
    index = X.forget(index, spark.createDataFrame([(i,) for i in rows], "chunk_id long"))
    assert X.bm25(index, queries, 5, save=saved(spark)).count() == 0 and X.phrases(index, asked, save=saved(spark)).count() == 0


def test_filters_come_before_the_last_place(spark, queries):
    rows = texts(5, range(300))
    index = X.create(frame(spark, rows), new(spark), most=32)
    among = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "chunk_id long")
    assert found(X.bm25(index, queries, 4, save=saved(spark), among=among)) == by_texts(spark, queries, rows, 4, among)
    some = X.phrases(index, spark.createDataFrame(PHRASES, "query_id long, phrase string"), save=saved(spark), among=among)
    assert {tuple(r) for r in some.collect()} == {h for h in phrase_hits(rows) if h[1] % 7 == 0}


def test_many_queries_are_answered_in_parts(spark, queries):
    rows = texts(6, range(120))
    index = X.create(frame(spark, rows), new(spark), most=20)
    assert found(X.bm25(index, queries, 5, save=saved(spark), most_terms=5)) == by_texts(spark, queries, rows, 5)
    asked = spark.createDataFrame(PHRASES, "query_id long, phrase string")
    assert {tuple(r) for r in X.phrases(index, asked, save=saved(spark), most_terms=3).collect()} == phrase_hits(rows)


def test_an_empty_table_finds_nothing(spark, queries):
    index = X.create(frame(spark, texts(1, range(3))).where("false"), new(spark))
    assert X.bm25(index, queries, 5, save=saved(spark)).count() == 0
    index = X.add(index, frame(spark, [(1, "w1 w2")]))
    assert [r[:3] for r in found(X.bm25(index, queries, 5, save=saved(spark)))] == [(1, 1, 1)]


def test_a_search_skips_blocks_and_reads_its_words_alone(spark):
    """Documents with a rare word are few; the blocks of all others can't reach the last place."""
    rows = [(i, "common words here " + ("rare rare rare" if i < 40 else f"filler{i % 50}")) for i in range(2000)]
    index = X.create(spark.createDataFrame(rows, "chunk_id long, text string").repartitionByRange(4, "chunk_id"), new(spark), most=50)
    seen = spark.sparkContext.accumulator(0)
    task = X._score_task

    def counted(*args):
        inner = task(*args)

        def run(*block):
            seen.add(1)
            return inner(*block)

        return run

    X._score_task = counted
    try:
        q = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
        result = found(X.bm25(index, q, 10, save=saved(spark), first=1))
    finally:
        X._score_task = task
    assert result == by_texts(spark, q, rows, 10)
    assert seen.value <= 2 < index.blocks().count()
    # one word's rows alone leave the files
    plan = index.postings().where(F.col("term").isin(["rare"]))
    assert "In(term, [rare])" in plan._jdf.queryExecution().toString() or "EqualTo(term,rare)" in plan._jdf.queryExecution().toString()
