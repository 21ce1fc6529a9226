"""The inverted-file index holds every row, is exact when all cells are probed, and finds nearly all in a few cells."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.operators import vector_index as VX
from quern.sources.store import work_dir


def frame(spark, m, name="chunk_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, vector array<float>").repartition(3)


def new(spark):
    return f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}"


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def grouped():
    """Clusters, copies of one vector on a tenth of the rows, and a vector of zeros."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 18))
    m = centres[rng.integers(25, size=1500)] + 0.35 * rng.normal(size=(1500, 18))
    m[::10] = m[0]
    m[7] = 0
    return m.astype(np.float32)


def test_all_cells_and_all_candidates_are_the_exact_search(spark, grouped):
    index = VX.create(frame(spark, grouped), new(spark), block=64)
    q = frame(spark, grouped[3::200] + np.float32(0.01), "query_id")
    assert found(VX.nearest_vectors(index, q, 10, probes=len(index.centroids), candidates=64)) == found(R.dense_topk(q, frame(spark, grouped), 10))
    held = np.concatenate([np.frombuffer(bytes(r["ids"]), np.int64) for r in index.cells().collect()])
    assert sorted(held) == list(range(1500))
    again = VX.open_index(spark, index.path)
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.books, index.books)


def test_few_cells_find_nearly_all(spark, grouped):
    index = VX.create(frame(spark, grouped), new(spark), cells=40)
    q = frame(spark, grouped[1::40] + np.float32(0.02), "query_id")
    some = VX.nearest_vectors(index, q, 10, probes=6, candidates=60, most_asked=5)
    assert VX.recall(some, R.dense_topk(q, frame(spark, grouped), 10), 10).agg(F.avg("recall")).first()[0] >= 0.95


def test_codes_stand_for_their_rows(grouped):
    m = VX.unit(grouped.astype(float))
    centres = VX.centres_of(m, 30, 1)
    rest = m - centres[VX.nearest(m, centres)]
    parts = VX._parts(rest)
    books = [VX.centres_of(parts[:, p], 256, p) for p in range(parts.shape[1])]
    back = np.concatenate([books[p][VX.nearest(parts[:, p], books[p])] for p in range(len(books))], axis=1)[:, :18]
    assert (rest - back).std() < 0.4 * rest.std()


def test_rows_of_all_kinds(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    index = VX.create(df, new(spark))
    q = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "query_id long, vector array<float>")
    assert [r[:3] for r in found(VX.nearest_vectors(index, q, 5))] == [(9, 1, 1), (9, 2, 5), (9, 3, 4)]
    none = VX.create(df.where("false"), new(spark))
    assert VX.nearest_vectors(none, q, 5).count() == 0
