"""A stored inverted-file index of vectors: coarse cells, residual codes, exact reranking.

Centroids and code books are fitted on at most SAMPLE vectors, those of the least hashes of their ids; every row is then
coded and in the cell of its nearest centroid. A search looks into the cells of the `probes` nearest centroids, scores their
rows from residual codes by table look-ups, and gives the best of these their exact cosine. With as many probes as cells
and enough candidates it is exact.

Files are sorted by cell, so a search reads the row groups of its cells; a frequent cell is many blocks, which are spread
over files and tasks. Memory of a task is a block, the centroids and the code books, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import ranked

#: Vectors that centroids and code books are fitted on at most, cells at most, rows of a block, rounds of a fit.
SAMPLE, MOST_CELLS, BLOCK, ROUNDS = 50_000, 4096, 1024, 12
#: Dimensions that one code stands for, and codes of a book.
PART, CODES = 4, 256


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the least distance to each row."""
    return np.argmin((centres**2).sum(axis=1) - 2 * m @ centres.T, axis=1)


def centres_of(m: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k means of the rows, from distinct rows on; a mean that loses all its rows takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(m, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(m, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, m)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            off = ((m - centres[own]) ** 2).sum(axis=1)
            centres[n == 0] = m[np.argsort(-off, kind="stable")[: int((n == 0).sum())]]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """Centroids and code books, which every task holds, and the stored cells."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    books: np.ndarray
    #: Of the stored components, which are as they were given.
    kind: str

    def cells(self) -> DataFrame:
        """(cell, ids, codes, matrix): blocks of a cell's rows."""
        return self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")


_CELLS = "cell int, ids binary, codes binary, matrix binary"


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors that have components, and which they are."""
    lists = column.to_pylist()
    some = [i for i, v in enumerate(lists) if v]
    return unit(np.array([lists[i] for i in some], float)) if some else np.zeros((0, 0)), np.array(some, int)


def _parts(m: np.ndarray) -> np.ndarray:
    """(rows, parts, PART), zeros after the last dimension."""
    width = -(-m.shape[1] // PART) * PART
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))).reshape(len(m), -1, PART)


def _cell_task(centroids: np.ndarray, kind: str):
    def task(batches):
        for b in batches:
            m, some = _matrix(b.column(1))
            if len(some):
                chosen = b.take(pa.array(some))
                rows = [np.array(v, kind).tobytes() for v in chosen.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(nearest(m, centroids), pa.int32()), chosen.column(0), pa.array(rows, pa.binary())], names=["cell", "id", "row"])

    return task


def _block_task(centroids: np.ndarray, books: np.ndarray, kind: str, block: int):
    """Rows in order of cell to blocks with residual codes."""

    def coded(cell: int, ids: list[int], rows: list[bytes]):
        m = np.frombuffer(b"".join(rows), kind).reshape(len(ids), -1)
        rest = _parts(unit(m.astype(float)) - centroids[cell])
        codes = np.stack([nearest(rest[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), codes, m))], names=["cell", "ids", "codes", "matrix"])

    def task(batches):
        now, ids, rows = None, [], []
        for b in batches:
            for c, i, r in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if ids and (c != now or len(ids) >= block):
                    yield coded(now, ids, rows)
                    ids, rows = [], []
                now = c
                ids.append(i)
                rows.append(r)
        if ids:
            yield coded(now, ids, rows)

    return task


def create(vectors: DataFrame, path: str, *, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK, seed: int = 11) -> VectorIndex:
    """An index of (chunk_id, vector) in a new folder; rows without an id or a vector are left out.

    cells: by default the square root of the number of rows, at most MOST_CELLS. The sample, and so the fit, is the same
    however the rows lie.
    """
    rows = vectors.select(F.col("chunk_id").cast("long").alias("id"), "vector").where("id IS NOT NULL AND size(vector) > 0")
    n = rows.count()
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()["vector"]
    m = unit(np.array(fit.tolist(), float)) if len(fit) else np.zeros((0, 1))
    centroids = centres_of(m, max(1, min(MOST_CELLS, cells or int(n**0.5) or 1)), seed) if len(m) else np.zeros((0, 1))
    rest = _parts(m - centroids[nearest(m, centroids)]) if len(m) else np.zeros((0, 1, PART))
    books = [centres_of(rest[:, p], CODES, seed + p) if len(rest) else np.zeros((1, PART)) for p in range(rest.shape[1])]
    most = max(len(b) for b in books)
    books = np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), constant_values=np.inf) if len(b) < most else b for b in books])
    books = np.where(np.isinf(books), 1e9, books)
    kind = "<f4" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"
    index = VectorIndex(rows.sparkSession, path, centroids, books, kind)
    placed = rows.mapInArrow(_cell_task(centroids, kind), "cell int, id long, row binary")
    # a cell of many rows is cut by ranges of their hashes, so that no task gets it whole
    dealt = placed.withColumn("h", F.xxhash64("id")).repartitionByRange("cell", "h").sortWithinPartitions("cell", "h").drop("h")
    dealt.mapInArrow(_block_task(centroids, books, kind, block), _CELLS).write.parquet(f"{path}/cells")
    spark = rows.sparkSession
    model = [("centroids", list(centroids.shape), centroids.tobytes()), ("books", list(books.shape), books.tobytes()), ("kind", [], kind.encode())]
    spark.createDataFrame(model, "name string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/model")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    model = {r["name"]: (r["shape"], bytes(r["data"])) for r in spark.read.parquet(f"{path}/model").collect()}
    centroids, books = (np.frombuffer(model[k][1]).reshape(model[k][0]) for k in ("centroids", "books"))
    return VectorIndex(spark, path, centroids, books, model["kind"][1].decode())


def _probe_task(centroids: np.ndarray, probes: int):
    """(query_id, vector) to a row for each of its nearest cells."""

    def task(batches):
        for b in batches:
            m, some = _matrix(b.column(1))
            if not len(some) or not len(centroids):
                continue
            d = (centroids**2).sum(axis=1) - 2 * m @ centroids.T
            cell = np.argsort(d, axis=1, kind="stable")[:, :probes]
            k = cell.shape[1]
            ids = b.column(0).take(pa.array(np.repeat(some, k)))
            raw = [r.tobytes() for r in m]
            yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1), pa.int32()), ids, pa.array([raw[i] for i in np.repeat(np.arange(len(raw)), k)], pa.binary())], names=["cell", "query_id", "row"])

    return task


def _scan_task(books: np.ndarray, kind: str, candidates: int, limit: int):
    """Blocks with their cell's queries: of each query the `candidates` best by codes, and of these the exact scores of the best `limit`."""

    def task(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                m = unit(np.frombuffer(r["matrix"], kind).reshape(len(ids), -1).astype(float))
                out = ([], [], [])
                for q in r["asked"]:
                    v = np.frombuffer(q["row"])
                    some = np.arange(len(ids))
                    if len(ids) > candidates:
                        # the part of the centroid is the same for all of a cell
                        tables = np.einsum("pkd,pd->pk", books, _parts(v[None])[0])
                        about = tables[np.arange(codes.shape[1]), codes].sum(axis=1)
                        some = np.argpartition(-about, candidates)[:candidates]
                    exact = m[some] @ v
                    best = some[np.lexsort((ids[some], -exact))[:limit]]
                    out[0].extend([q["query_id"]] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend((m[best] * v).sum(axis=1).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "chunk_id", "score"])

    return task


def nearest_vectors(index: VectorIndex, queries: DataFrame, limit: int, *, probes: int = 16, candidates: int = 200, most_asked: int = 512) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank: the best of the cells that queries (query_id, vector) look into.

    candidates: rows of a block that get an exact score for each query; those kept are the best `limit`. Queries of one
    cell travel in lists of at most most_asked, beside each of its blocks.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInArrow(_probe_task(index.centroids, probes), "cell int, query_id long, row binary")
    # a cell that all queries look into is cut into lists of bounded length
    turn = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // most_asked))))
    lists = asked.withColumn("turn", turn).groupBy("cell", "turn").agg(F.collect_list(F.struct("query_id", "row")).alias("asked"))
    met = index.cells().join(lists, "cell").select("ids", "codes", "matrix", "asked")
    found = met.mapInArrow(_scan_task(index.books, index.kind, max(candidates, limit), limit), "query_id long, chunk_id long, score double")
    return ranked(found, ["query_id"], "score", "chunk_id", limit)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the first k of `exact` that the first k of `found` have."""
    want = exact.where(F.col("rank") <= k).select("query_id", "chunk_id")
    have = found.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return want.join(have, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
