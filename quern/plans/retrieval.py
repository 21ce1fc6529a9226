"""Registered retrieval queries and their SQL twins."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.operators import sparse as X
from quern.operators import vector_index as VX
from quern.sources import model as M
from quern.sources.store import saved, work_dir

NOW = "2024-03-01 00:00:00"

_DENSE = """
dq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
dn AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(v::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM dq, embeddings),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn)"""
_BM25 = """
bq AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bt AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents),
bn AS (SELECT count(*) AS n_docs, avg(coalesce(len(tokens), 0)) AS avg_dl FROM bt),
bf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM bt) WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
bd AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, avg_dl FROM (SELECT term, count(*) AS df FROM bf GROUP BY 1), bn),
bs AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) ORDER BY term) AS score FROM bf JOIN bd USING (term) JOIN bq USING (term) GROUP BY 1, 2),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs)"""
_FUSED = """
arms AS (SELECT query_id // 50 AS query_id, chunk_id, rank FROM dense WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 50),
fs AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM arms GROUP BY 1, 2),
fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs)"""


def _dense(spark, d, limit=50):
    return R.dense_topk(M.query_vectors(spark, d), M.vectors(spark, d), limit)


def _bench(spark, d):
    return M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _texts(spark, d):
    return M.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def sparse_index(spark: SparkSession, d: str) -> X.SparseIndex:
    """The documents' index, which the first query of an application makes and the others open."""
    path = f"{work_dir(spark)}/sparse-{hashlib.md5(d.encode()).hexdigest()}"
    try:
        return X.open_index(spark, path)
    except AnalysisException:  # nothing there yet
        return X.create(_texts(spark, d), path)


def _sparse(spark, d, limit=50):
    return X.bm25(sparse_index(spark, d), _bench(spark, d), limit, save=saved(spark))


def _fused(spark, d):
    """Dense queries 0, 50, 100, ... are the vectors of the text queries 0, 1, 2, ..."""
    dense = _dense(spark, d).withColumn("query_id", F.expr("query_id div 50"))
    return R.rrf_fuse([dense, _sparse(spark, d)])


def _fused_chunks(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.expr("chunk_id div 4").alias("page_id"), F.col("score").alias("fusion"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 10)


def vector_index(spark: SparkSession, d: str) -> VX.VectorIndex:
    """The embeddings' index, which the first query of an application makes and the others open."""
    path = f"{work_dir(spark)}/vectors-{hashlib.md5(d.encode()).hexdigest()}"
    try:
        return VX.open_index(spark, path)
    except AnalysisException:  # nothing there yet
        return VX.create(M.vectors(spark, d), path)


def ivf_every_cell(spark: SparkSession, d: str) -> DataFrame:
    """The index with all cells probed and all rows reranked gives the exact ten."""
    index = vector_index(spark, d)
    return VX.nearest_vectors(index, M.query_vectors(spark, d), 10, probes=len(index.centroids), candidates=VX.BLOCK)


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Four of five cells probed, as the given embeddings have no clusters: how many queries there are, and whether 95 % of their exact ten are found."""
    index = vector_index(spark, d)
    found = VX.nearest_vectors(index, M.query_vectors(spark, d), 10, probes=-(-len(index.centroids) * 4 // 5))
    r = VX.recall(found, _dense(spark, d, 10), 10)
    return r.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.95).alias("enough"))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter on pages comes before the best ten are taken."""
    ids = R.page_filter(M.pages(spark, d), after="2024-01-03", before="2024-02-01").select(F.col("page_id").alias("chunk_id"))
    return R.dense_topk(M.query_vectors(spark, d), M.vectors(spark, d).join(ids, "chunk_id", "left_semi"), 10)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d, 10)


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item's first five words as a phrase."""
    q = _bench(spark, d).select("query_id", F.array_join(F.slice(R.word_tokens(F.col("text")), 1, 5), " ").alias("phrase"))
    return X.phrases(sparse_index(spark, d), q, save=saved(spark))


def index_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The index of even documents, to which odd ones are added, every third is forgotten and every sixth comes back, merged: each word's documents and occurrences."""
    docs, path = _texts(spark, d), f"{work_dir(spark)}/sparse-{uuid.uuid4().hex}"
    part = lambda where: docs.where(where)
    index = X.add(X.create(part("chunk_id % 2 = 0"), path), part("chunk_id % 2 = 1"))
    index = X.replace(X.forget(index, part("chunk_id % 3 = 0").select("chunk_id")), part("chunk_id % 6 = 0 OR chunk_id % 5 = 1"))
    return X.merge(index).vocabulary()


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


def rollup_max(spark: SparkSession, d: str) -> DataFrame:
    return R.rollup(_fused_chunks(spark, d), "max")


def rollup_mean_top_m(spark: SparkSession, d: str) -> DataFrame:
    return R.rollup(_fused_chunks(spark, d), "mean_top_m", 3)


def rollup_sum_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.rollup(_fused_chunks(spark, d), "sum_rrf")


def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Fused chunks scored by the token-overlap reranker, pages by their best chunk."""
    texts = M.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    c = _fused_chunks(spark, d).join(texts, "chunk_id").join(_bench(spark, d), "query_id")
    return R.rollup(c.select("query_id", "chunk_id", "page_id", "fusion", R.token_overlap(F.col("text"), F.col("body")).alias("rerank")), "max")


def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return R.recency_decay(R.rollup(_fused_chunks(spark, d)), M.pages(spark, d), F.lit(NOW).cast("timestamp_ntz"), 30)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both arms, fusion, rollup, indexed pages only, decay, first ten."""
    shown = R.page_filter(M.pages(spark, d)).select("page_id", "first_seen_at")
    pages = R.rollup(_fused_chunks(spark, d)).join(shown.select("page_id"), "page_id", "left_semi")
    return R.page_slice(R.recency_decay(pages, shown, F.lit(NOW).cast("timestamp_ntz"), 30), 0, 10)


def exact_match_pin(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the domain that a query names come first: query n asks for source src<n mod 20>, the five last seen."""
    p = R.page_filter(M.pages(spark, d))
    q = M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("domain"))
    hit = R.ranked(p.join(q, "domain"), ["query_id"], "first_seen_at", "page_id", 5)
    return R.pinned(R.rollup(_fused_chunks(spark, d)), hit.select("query_id", "page_id", F.col("rank").alias("pin")))


def pagination_slice(spark: SparkSession, d: str) -> DataFrame:
    return R.page_slice(R.rollup(_fused_chunks(spark, d)), 10, 10)


def page_filter_halfopen(spark: SparkSession, d: str) -> DataFrame:
    return R.page_filter(M.pages(spark, d), domain="src3", after="2024-01-03", before="2024-01-20").select("page_id", "domain", "first_seen_at")


def entity_cluster_filter_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Indexed pages that mention an entity (a capital THE) and are live members of cluster 3."""
    entity = M.pages(spark, d).where(F.contains("body_text", F.lit("The "))).select("page_id")
    cluster = M.members(spark, d).where("cluster_id = 3").select("page_id")
    return R.page_filter(M.pages(spark, d), ids=entity).join(cluster, "page_id", "left_semi").select("page_id", "domain")


def hydrate_latest_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Each page with its live cluster of the highest probability; clusters 7 and up are tombstoned."""
    e = M.table(spark, d, "embeddings")
    first = e.select(F.col("vec_id").alias("page_id"), F.col("label").alias("cluster_id"), F.lit(0.9).alias("probability"))
    second = e.select(F.col("vec_id").alias("page_id"), ((F.col("label") + F.col("vec_id")) % 10).cast("int").alias("cluster_id"), F.lit(0.4).alias("probability"))
    clusters = e.select(F.col("label").alias("cluster_id")).distinct().withColumn("tombstoned_at", F.when(F.col("cluster_id") >= 7, F.lit("2024-01-02").cast("timestamp_ntz")))
    best = R.latest_cluster(first.unionByName(second), clusters)
    p = R.page_filter(M.pages(spark, d)).select("page_id", "domain")
    return p.join(best, "page_id", "left").select("page_id", "domain", "cluster_id", "probability")


def batch_search_log(spark: SparkSession, d: str) -> DataFrame:
    """A log row for each query: pages of the first ten with their absolute ranks, joined into one string."""
    s = R.page_slice(R.rollup(_fused_chunks(spark, d)), 0, 10)
    rows = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_id"))).alias("x"), F.count("*").alias("n"))
    return rows.select("query_id", "n", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["rank"], r["page_id"])), ",").alias("final_pages"))


def shown(name, query, digits: int = 9):
    """A query whose scores are rounded for the comparison with its twin, after all ranking."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = query(spark, d)
        return out.withColumn("score", F.round("score", digits)) if "score" in out.columns else out

    run.__name__, run.__doc__ = name, query.__doc__
    return run


def shown_twin(sql: str, digits: int = 9) -> str:
    return f"SELECT * REPLACE (round(score, {digits}) AS score) FROM ({sql})"


_QUERIES = (dense_topk, ivf_every_cell, ivf_recall, dense_topk_filtered, bm25_topk, phrase_match, index_rebuilt, rrf_fuse, rollup_max, rollup_mean_top_m, rollup_sum_rrf, rerank_overlap, recency_decay, hybrid_search, exact_match_pin, pagination_slice, page_filter_halfopen, entity_cluster_filter_intersection, hydrate_latest_cluster, batch_search_log)
QUERIES = {f.__name__: shown(f.__name__, f) for f in _QUERIES}


_PAGES = """
pages_ AS (SELECT doc_id AS page_id, source AS domain, text AS body_text, TIMESTAMP '2024-01-01' + to_hours(doc_id::BIGINT) AS first_seen_at, CASE WHEN doc_id % 10 = 9 THEN 'queued' ELSE 'indexed' END AS status FROM documents)"""
_ALL = f"WITH {_DENSE}, {_BM25}, {_FUSED}, {_PAGES}, chunks_ AS (SELECT query_id, chunk_id, chunk_id // 4 AS page_id, score AS fusion FROM fused)"
_RANKED = "SELECT query_id, page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM"
_MAX = f", maxed AS ({_RANKED} (SELECT query_id, page_id, max(fusion) AS score FROM chunks_ GROUP BY 1, 2))"
_DECAY = f"CASE WHEN first_seen_at IS NULL THEN score ELSE score * pow(0.5, greatest(date_diff('second', first_seen_at, TIMESTAMP '{NOW}'), 0) / 86400.0 / 30) END AS score"

ORACLES = {
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dense WHERE rank <= 10",
    "ivf_every_cell": f"WITH {_DENSE} SELECT * FROM dense WHERE rank <= 10",
    "ivf_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "dense_topk_filtered": f"WITH {_DENSE}, {_PAGES} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn WHERE chunk_id IN (SELECT page_id FROM pages_ WHERE status = 'indexed' AND first_seen_at >= '2024-01-03' AND first_seen_at < '2024-02-01') QUALIFY rank <= 10",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM sparse WHERE rank <= 10",
    "phrase_match": """WITH q AS (SELECT item_id AS query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:5], ' ') || ' ' AS phrase FROM benchmark),
d AS (SELECT doc_id AS chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS body FROM documents)
SELECT query_id, chunk_id FROM q, d WHERE contains(body, phrase)""",
    "index_rebuilt": """SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0 OR doc_id % 5 = 1) GROUP BY 1""",
    "rrf_fuse": f"WITH {_DENSE}, {_BM25}, {_FUSED} SELECT * FROM fused",
    "rollup_max": f"{_ALL} {_MAX} SELECT * FROM maxed",
    "rollup_mean_top_m": f"{_ALL} {_RANKED} (SELECT query_id, page_id, list_sum(list_slice(list(fusion ORDER BY fusion DESC), 1, 3)) / least(count(*), 3) AS score FROM chunks_ GROUP BY 1, 2)",
    "rollup_sum_rrf": f"{_ALL} {_RANKED} (SELECT query_id, page_id, sum(fusion ORDER BY fusion DESC) AS score FROM chunks_ GROUP BY 1, 2)",
    "rerank_overlap": rf"""{_ALL}, w AS (SELECT query_id, chunk_id, page_id, list_distinct(regexp_split_to_array(lower(trim(b.text)), '\s+')) AS q, list_distinct(regexp_split_to_array(lower(trim(d.text)), '\s+')) AS t FROM chunks_ JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id)
{_RANKED} (SELECT query_id, page_id, max(len(list_intersect(q, t)) / greatest(len(q), 1)) AS score FROM w GROUP BY 1, 2)""",
    "recency_decay": f"{_ALL} {_MAX} {_RANKED} (SELECT query_id, page_id, {_DECAY} FROM maxed LEFT JOIN pages_ USING (page_id))",
    "hybrid_search": f"""{_ALL} {_MAX}, aged AS ({_RANKED} (SELECT query_id, page_id, {_DECAY} FROM maxed JOIN pages_ USING (page_id) WHERE status = 'indexed'))
SELECT *, count(*) OVER (PARTITION BY query_id) > 10 AS has_more FROM aged QUALIFY rank <= 10""",
    "exact_match_pin": f"""{_ALL} {_MAX}, hit AS (SELECT item_id AS query_id, page_id, row_number() OVER (PARTITION BY item_id ORDER BY first_seen_at DESC, page_id) AS pin FROM benchmark JOIN pages_ ON domain = 'src' || (item_id % 20) WHERE status = 'indexed' QUALIFY pin <= 5),
u AS (SELECT query_id, page_id, 1.0::DOUBLE AS score, true AS exact_match, pin AS pos FROM hit UNION ALL SELECT query_id, page_id, score, false, rank + 1000000 FROM maxed m WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = m.query_id AND h.page_id = m.page_id))
SELECT query_id, page_id, score, exact_match, row_number() OVER (PARTITION BY query_id ORDER BY pos, page_id) AS rank FROM u""",
    "pagination_slice": f"{_ALL} {_MAX} SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) > 20 AS has_more FROM maxed) WHERE rank > 10 AND rank <= 20",
    "page_filter_halfopen": f"WITH {_PAGES} SELECT page_id, domain, first_seen_at FROM pages_ WHERE status = 'indexed' AND domain = 'src3' AND first_seen_at >= '2024-01-03' AND first_seen_at < '2024-01-20'",
    "entity_cluster_filter_intersection": f"WITH {_PAGES} SELECT page_id, domain FROM pages_ WHERE status = 'indexed' AND contains(body_text, 'The ') AND page_id IN (SELECT vec_id FROM embeddings WHERE label = 3)",
    "hydrate_latest_cluster": f"""WITH {_PAGES}, m AS (SELECT vec_id AS page_id, label AS cluster_id, 0.9::DOUBLE AS probability FROM embeddings UNION ALL SELECT vec_id, ((label + vec_id) % 10)::INT, 0.4::DOUBLE FROM embeddings),
b AS (SELECT * FROM m WHERE cluster_id < 7 AND cluster_id IN (SELECT label FROM embeddings) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY probability DESC, cluster_id) = 1)
SELECT page_id, domain, cluster_id, probability FROM pages_ LEFT JOIN b USING (page_id) WHERE status = 'indexed'""",
    "batch_search_log": f"{_ALL} {_MAX} SELECT query_id, count(*) AS n, string_agg(rank || ':' || page_id, ',' ORDER BY rank) AS final_pages FROM maxed WHERE rank <= 10 GROUP BY 1",
}
_UNSCORED = {"phrase_match", "ivf_recall", "index_rebuilt", "page_filter_halfopen", "entity_cluster_filter_intersection", "hydrate_latest_cluster", "batch_search_log"}
ORACLES = {name: sql if name in _UNSCORED else shown_twin(sql) for name, sql in ORACLES.items()}
