"""Registered queries on search with its options, comparison and replay of models, and the query log, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import evaluation as V
from quern.operators import jobs as J
from quern.operators import search as S
from quern.operators import store
from quern.plans.retrieval import NOW, shown, shown_twin, sparse_index
from quern.sources import model as M
from quern.sources.store import saved


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _corpus(spark, d) -> S.Corpus:
    """Documents as pages of their sources' sites and, four a page, as chunks; embeddings as the chunks' vectors; parts of orders as entities on pages."""
    p = M.pages(spark, d)
    site = F.concat("domain", F.lit(".example"))
    pages = p.select("page_id", site.alias("domain"), F.concat(F.lit("https://"), site, F.lit("/p/"), F.col("page_id").cast("string")).alias("canonical_url"), "first_seen_at", F.col("first_seen_at").alias("last_seen_at"), "status")
    chunks = p.select(F.col("page_id").alias("chunk_id"), F.expr("page_id div 4").alias("page_id"), (F.col("page_id") % 4).alias("ordinal"), F.col("body_text").alias("text"))
    clusters = M.table(spark, d, "embeddings").select(F.col("label").alias("cluster_id")).distinct().withColumn("tombstoned_at", F.when(F.col("cluster_id") >= 7, _now()))
    mentions = M.table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("page_id"))
    return S.Corpus(pages, chunks, M.vectors(spark, d).select("chunk_id", "page_id", "vector"), M.members(spark, d), clusters, mentions, sparse_index(spark, d))


def _queries(spark, d, text=None):
    """The benchmark's items; item n has the vector of embedding 50 n, where there is one."""
    v = M.vectors(spark, d).where("chunk_id % 50 = 0").select(F.expr("chunk_id div 50").alias("query_id"), "vector")
    return M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("text") if text is None else text).alias("text")).join(v, "query_id", "left")


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_queries(spark, d), _corpus(spark, d), S.SearchOptions(candidates=50), now=_now(), save=saved(spark))["pages"]


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a live cluster seen from a date on, with decay, from the third result."""
    o = S.SearchOptions(candidates=50, k=5, offset=2, half_life_days=30, after="2024-01-01 06:00:00", cluster_id=3)
    return S.search(_queries(spark, d), _corpus(spark, d), o, now=_now(), save=saved(spark))["pages"]


def search_entity(spark: SparkSession, d: str) -> DataFrame:
    """Pages that mention part 1; summed fusion scores."""
    o = S.SearchOptions(candidates=20, k=5, rollup="sum_rrf", entity_id=1)
    return S.search(_queries(spark, d), _corpus(spark, d), o, now=_now(), save=saved(spark))["pages"]


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The best two chunks of each page, reranked by shared words."""
    o = S.SearchOptions(candidates=50, rollup="mean_top_m", rollup_m=2, chunks_per_page=2)
    return S.search(_queries(spark, d), _corpus(spark, d), o, now=_now(), save=saved(spark), reranker=S.overlap_reranker)["chunks"]


def search_pins(spark: SparkSession, d: str) -> DataFrame:
    """A third of the queries are a page's URL in another form, a third are a bare domain."""
    i = F.col("item_id")
    n = F.concat(F.lit("src"), (i % 20).cast("string"))
    url = F.concat(F.lit(" https://WWW."), n, F.lit(".example/p/"), i.cast("string"), F.lit("/?utm_source=x#top"))
    text = F.when(i % 3 == 0, url).when(i % 3 == 1, F.concat(F.lit(" "), n, F.lit(".Example "))).otherwise(F.col("text"))
    return S.search(_queries(spark, d, text), _corpus(spark, d), S.SearchOptions(candidates=20), now=_now(), save=saved(spark))["pages"]


def search_log(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_queries(spark, d), _corpus(spark, d), S.SearchOptions(candidates=50), now=_now(), save=saved(spark))["log"]


def _models(spark, d):
    v, q = M.vectors(spark, d), M.query_vectors(spark, d).withColumn("query_id", F.expr("query_id div 50"))
    q = q.join(M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    half = lambda df: df.withColumn("vector", F.slice("vector", 1, 32))
    return {"full": (q, v), "half": (half(q), half(v))}


def _compared(spark, d):
    c = _corpus(spark, d)
    return S.compare(_queries(spark, d), _models(spark, d), c.chunks, c.pages, save=saved(spark), k=10, candidates=50, index=c.sparse)


def compare_arms(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("model", "query_id", "item", "rank")


def compare_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two models on each query."""
    a = S.agreement(saved(spark)(_compared(spark, d)), _queries(spark, d), ["full", "half"])
    return a.select("query_id", "a", "b", *(F.round(c, 6).alias(c) for c in ("jaccard", "rbo", "tau")), "common")


def replay_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Both models on golden queries: pages with a document labelled good, dealt out to twenty queries."""
    c = saved(spark)(_compared(spark, d))
    arm = lambda m: c.where(F.col("model") == m).select("query_id", "item", "rank")
    good = M.table(spark, d, "labels").where("quality = 1").groupBy((F.col("doc_id") % 20).alias("query_id")).agg(F.collect_set(F.expr("doc_id div 4")).alias("relevant"))
    r = V.arm_deltas(arm("full"), arm("half"), good)
    return r.select("golden", *(F.round(x, 6).alias(x) for x in ("ndcg", "rr", "recall")))


def _runs(spark, d):
    """Orders as logged runs: their parts are the pages shown, in reverse the pool."""
    o = F.col("query_id")
    lines = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    params = F.when(o % 5 == 0, '{"recency_half_life_days":null}').when(o % 5 == 1, '{"rollup":"sum_rrf","recency_half_life_days":null}').when(o % 5 == 2, '{"offset":10,"recency_half_life_days":null}').when(o % 5 == 3, "{}").otherwise('{"recency_half_life_days":30}')
    head = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit(" Query  "), (F.col("o_custkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " A").otherwise(" a")).alias("query_text"))
    return lines.join(head, "query_id").select(
        "query_id", "ts", F.when(o % 7 == 0, "compare_arm").otherwise("search").alias("kind"), "query_text", params.alias("params"), F.concat(F.lit("m"), (o % 3).cast("string")).alias("active_model"),
        F.when(o % 2 == 1, "r").alias("reranker_model"), F.col("ids").alias("final_page_ids"), F.sequence(F.lit(1), F.size("ids")).alias("final_page_ranks"), F.reverse("ids").alias("pool"),
    )


def _labels(spark, d):
    l = M.table(spark, d, "lineitem").where("l_orderkey % 4 <> 0")
    return l.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("page_id")).agg(F.max(F.col("l_quantity") > 25).alias("relevant"))


def score_log(spark: SparkSession, d: str) -> DataFrame:
    r = V.model_reports(V.scored_runs(_runs(spark, d), _labels(spark, d), 3))
    return r.select("model", "logged", "labeled", "skipped", "queries", *(F.round(c, 6).alias(c) for c in ("ndcg", "rr", "recall", "pool_recall", "lift")))


def golden_queries(spark: SparkSession, d: str) -> DataFrame:
    g = V.golden_queries(_runs(spark, d), _labels(spark, d))
    return g.select("norm", "query_text", F.size("relevant").alias("n_relevant"), F.size("sources").alias("n_sources"), F.col("sources")[0].alias("first"))


def query_log_detail(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred comparison runs since a date."""
    r = V.log_rows(_runs(spark, d), since="1995-01-01", kind="compare_arm")
    return store.newest_first(r, "ts", "query_id", 100).select("query_id", "kind", "active_model", "rank")


def query_log_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Runs written again with another model replace the old rows; new keys are added."""
    r = _runs(spark, d).select("query_id", "active_model")
    again = r.where("query_id % 10 = 1").select((F.col("query_id") + F.when(F.col("query_id") % 20 == 1, 10_000_000).otherwise(0)).alias("query_id"), F.lit("new").alias("active_model"))
    return J.upsert(r, again, ["query_id"])


def query_log_insert(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, where known keys stay as they are."""
    r = _runs(spark, d).select("query_id", "active_model")
    again = r.where("query_id % 10 = 1").select((F.col("query_id") + F.when(F.col("query_id") % 20 == 1, 10_000_000).otherwise(0)).alias("query_id"), F.lit("new").alias("active_model"))
    return J.insert_new(r, again, ["query_id"])


_SCORED = (search_pages, search_filtered, search_entity, search_chunks, search_pins)
_PLAIN = (search_log, compare_arms, compare_agreement, replay_deltas, score_log, golden_queries, query_log_detail, query_log_upsert, query_log_insert)
QUERIES = {f.__name__: shown(f.__name__, f) for f in _SCORED} | {f.__name__: f for f in _PLAIN}

_P = "p_ AS (SELECT doc_id AS page_id, source || '.example' AS domain, 'https://' || source || '.example/p/' || doc_id AS url, TIMESTAMP '2024-01-01' + to_hours(doc_id::BIGINT) AS seen, CASE WHEN doc_id % 10 = 9 THEN 'queued' ELSE 'indexed' END AS status FROM documents)"
_PIN_TEXT = "CASE WHEN item_id % 3 = 0 THEN ' https://WWW.src' || (item_id % 20) || '.example/p/' || item_id || '/?utm_source=x#top' WHEN item_id % 3 = 1 THEN ' src' || (item_id % 20) || '.Example ' ELSE text END"


def _fused(candidates: int, text: str = "text", allowed: str = "true", dims: int = 64) -> str:
    """Queries to fused chunks (query_id, chunk_id, page_id, fusion, fused_rank); allowed is a condition on page_id."""
    cosine = "list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e)))"
    return f"""q_ AS (SELECT item_id AS query_id, {text} AS text FROM benchmark),
dv AS (SELECT query_id, embedding[1:{dims}]::DOUBLE[] AS v FROM q_ JOIN embeddings ON vec_id = query_id * 50),
dn AS (SELECT query_id, vec_id AS chunk_id, {cosine} AS score FROM dv, (SELECT vec_id, embedding[1:{dims}]::DOUBLE[] AS e, vec_id // 4 AS page_id FROM embeddings) WHERE {allowed}),
bq AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q_),
bt AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents),
bn AS (SELECT count(*) AS n_docs, avg(coalesce(len(tokens), 0)) AS avg_dl FROM bt),
bf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM bt) WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
bd AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, avg_dl FROM (SELECT term, count(*) AS df FROM bf GROUP BY 1), bn),
bs AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) ORDER BY term) AS score FROM (SELECT *, chunk_id // 4 AS page_id FROM bf) JOIN bd USING (term) JOIN bq USING (term) WHERE {allowed} GROUP BY 1, 2),
arms AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= {candidates} UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs QUALIFY rank <= {candidates}),
fs AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS fusion FROM arms GROUP BY 1, 2),
c_ AS (SELECT query_id, chunk_id, chunk_id // 4 AS page_id, fusion, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, chunk_id) AS fused_rank FROM fs QUALIFY fused_rank <= {candidates})"""


_CLUSTER = "(SELECT any_value(label) FROM embeddings WHERE vec_id = page_id AND label < 7)"


def _pages_of(score: str, k: int, offset: int, source: str = "c_", pins: str = "SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS page_id, NULL::BIGINT AS pin WHERE false", decay: bool = False) -> str:
    aged = f" * pow(0.5, greatest(date_diff('second', seen, TIMESTAMP '{NOW}'), 0) / 86400.0 / 30)" if decay else ""
    return f"""r_ AS (SELECT query_id, page_id, {score} AS score FROM {source} GROUP BY 1, 2),
s_ AS (SELECT query_id, page_id, score{aged} AS score FROM r_ JOIN p_ USING (page_id) WHERE status = 'indexed'),
pins_ AS ({pins}),
u_ AS (SELECT query_id, page_id, 1.0::DOUBLE AS score, true AS exact_match, pin - 1000000000 AS pos FROM pins_ UNION ALL SELECT query_id, page_id, score, false, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) FROM s_ ANTI JOIN pins_ USING (query_id, page_id)),
n_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, page_id) AS rank, count(*) OVER (PARTITION BY query_id) > {offset + k} AS has_more FROM u_),
final_ AS (SELECT n_.*, domain FROM n_ JOIN p_ USING (page_id) WHERE rank > {offset} AND rank <= {offset + k})"""


_OUT = f"SELECT query_id, rank, page_id, score, exact_match, domain, {_CLUSTER} AS cluster_id, has_more FROM final_"
_PINS = """SELECT query_id, page_id, 1 AS pin FROM q_ JOIN p_ ON page_id = query_id AND domain = 'src' || (query_id % 20) || '.example' WHERE query_id % 3 = 0 AND status = 'indexed'
UNION ALL SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY seen DESC, page_id) AS pin FROM q_ JOIN p_ ON domain = 'src' || (query_id % 20) || '.example' WHERE query_id % 3 = 1 AND status = 'indexed' QUALIFY pin <= 5"""
_RERANKED = r"""w_ AS (SELECT c_.*, list_distinct(regexp_split_to_array(lower(trim(b.text)), '\s+')) AS qw, list_distinct(regexp_split_to_array(lower(trim(t.text)), '\s+')) AS tw, t.text IS NULL AS none FROM c_ JOIN benchmark b ON item_id = query_id LEFT JOIN documents t ON doc_id = chunk_id),
e_ AS (SELECT query_id, chunk_id, page_id, CASE WHEN none THEN fusion ELSE len(list_intersect(qw, tw)) / greatest(len(qw), 1) END AS e FROM w_)"""


def _arm(dims: int, name: str) -> str:
    """A model's first ten pages by their best chunk, then only the indexed ones."""
    return f"""SELECT '{name}' AS model, query_id, page_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (
WITH {_P}, {_fused(50, dims=dims)} SELECT query_id, page_id, status, r FROM (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY max(fusion) DESC, page_id) AS r FROM c_ GROUP BY 1, 2 QUALIFY r <= 10) JOIN p_ USING (page_id) WHERE status = 'indexed')"""


_COMPARED = f"m_ AS ({_arm(64, 'full')} UNION ALL {_arm(32, 'half')})"
_LOG = """runs AS (SELECT l_orderkey AS query_id, l_partkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
lab AS (SELECT l_orderkey AS query_id, l_partkey AS page_id, bool_or(l_quantity > 25) AS relevant FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1, 2)"""


def _metrics(ranks: str, rel: str, k: int) -> str:
    return f"""(SELECT query_id, coalesce(sum(CASE WHEN r.rank <= {k} THEN 1 / log2(r.rank + 1.0) END), 0) / any_value((SELECT sum(1 / log2(i + 1.0)) FROM range(1, least(g.n, {k}) + 1) t(i))) AS ndcg, coalesce(1.0::DOUBLE / min(r.rank), 0) AS rr, count(DISTINCT r.page_id) FILTER (r.rank <= {k}) / any_value(g.n) AS recall
FROM (SELECT query_id, count(*) AS n FROM {rel} GROUP BY 1) g LEFT JOIN (SELECT a.* FROM {ranks} a JOIN {rel} b USING (query_id, page_id)) r USING (query_id) GROUP BY 1)"""


ORACLES = {
    "search_pages": f"WITH {_P}, {_fused(50)}, {_pages_of('max(fusion)', 10, 0)} {_OUT}",
    "search_filtered": f"WITH {_P}, {_fused(50, allowed='page_id IN (SELECT vec_id FROM embeddings WHERE label = 3) AND page_id IN (SELECT page_id FROM p_ WHERE seen >= TIMESTAMP ' + chr(39) + '2024-01-01 06:00:00' + chr(39) + ')')}, {_pages_of('max(fusion)', 5, 2, decay=True)} {_OUT}",
    "search_entity": f"WITH {_P}, {_fused(20, allowed='page_id IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 1)')}, {_pages_of('sum(fusion ORDER BY fusion DESC)', 5, 0)} {_OUT}",
    "search_chunks": f"WITH {_P}, {_fused(50)}, {_RERANKED}, {_pages_of('list_sum(list_slice(list(e ORDER BY e DESC), 1, 2)) / least(count(*), 2)', 10, 0, source='e_')} SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id, page_id ORDER BY e DESC, chunk_id) AS chunk_rank, chunk_id, e AS score FROM e_ SEMI JOIN final_ USING (query_id, page_id) QUALIFY chunk_rank <= 2",
    "search_pins": f"WITH {_P}, {_fused(20, text=_PIN_TEXT)}, {_pages_of('max(fusion)', 10, 0, pins=_PINS)} {_OUT}",
    "search_log": f"""WITH {_P}, {_fused(50)}, {_pages_of('max(fusion)', 10, 0)}, pool_ AS (SELECT query_id, string_agg(page_id, ',' ORDER BY f) AS pool FROM (SELECT query_id, page_id, min(fused_rank) AS f FROM c_ GROUP BY 1, 2) GROUP BY 1)
SELECT q_.query_id, coalesce((SELECT count(*) FROM c_ WHERE c_.query_id = q_.query_id), 0) AS n_fused, coalesce((SELECT string_agg(page_id || ':' || rank, ',' ORDER BY rank) FROM final_ f WHERE f.query_id = q_.query_id), '') AS final_pages, coalesce(pool, '') AS pool FROM q_ LEFT JOIN pool_ USING (query_id)""",
    "compare_arms": f"WITH {_COMPARED} SELECT * FROM m_",
    "compare_agreement": f"""WITH {_COMPARED}, ra AS (SELECT query_id, item, rank FROM m_ WHERE model = 'full'), rb AS (SELECT query_id, item, rank FROM m_ WHERE model = 'half'),
c AS (SELECT query_id, item, ra.rank AS x, rb.rank AS y, greatest(ra.rank, rb.rank) AS dep FROM ra JOIN rb USING (query_id, item)), x AS (SELECT query_id, count(*) AS common FROM c GROUP BY 1),
t AS (SELECT p.query_id, sum(sign(q.y - p.y)) AS t FROM c p JOIN c q ON p.query_id = q.query_id AND p.x < q.x GROUP BY 1),
n AS (SELECT query_id, count(*) FILTER (model = 'full') AS na, count(*) FILTER (model = 'half') AS nb FROM m_ GROUP BY 1), z AS (SELECT query_id, least(na, nb) AS s, greatest(na, nb) AS l FROM n WHERE na > 0 AND nb > 0),
d AS (SELECT query_id, s, l, d, (SELECT count(*) FROM c WHERE c.query_id = y.query_id AND dep <= d) AS x FROM (SELECT *, unnest(range(1, l + 1)) AS d FROM z) y),
e AS (SELECT query_id, any_value(s) AS s, any_value(l) AS l, max(x) FILTER (d = s) AS xs, max(x) FILTER (d = l) AS xl, sum(x / d * pow(0.9, d)) AS t FROM d GROUP BY 1),
r AS (SELECT query_id, 0.1 / 0.9 * (t + coalesce((SELECT sum(xs * (d - s) / (s * d) * pow(0.9, d)) FROM range(1, 30) r(d) WHERE d > s AND d <= l), 0)) + ((xl - xs) / l + xs / s) * pow(0.9, l) AS rbo FROM e)
SELECT item_id AS query_id, 'full' AS a, 'half' AS b, round(CASE WHEN coalesce(na, 0) + coalesce(nb, 0) = 0 THEN 1 ELSE coalesce(common, 0) / (na + nb - coalesce(common, 0)) END, 6) AS jaccard, round(CASE WHEN coalesce(na, 0) + coalesce(nb, 0) = 0 THEN 1 ELSE coalesce(rbo, 0) END, 6) AS rbo,
round(CASE WHEN common >= 2 THEN coalesce(t, 0) / (common * (common - 1) / 2) END, 6) AS tau, coalesce(common, 0) AS common FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN x ON x.query_id = item_id LEFT JOIN t ON t.query_id = item_id LEFT JOIN r ON r.query_id = item_id""",
    "replay_deltas": f"""WITH {_COMPARED}, rel AS (SELECT DISTINCT doc_id % 20 AS query_id, doc_id // 4 AS page_id FROM labels WHERE quality = 1), a AS (SELECT query_id, item AS page_id, rank FROM m_ WHERE model = 'full'), b AS (SELECT query_id, item AS page_id, rank FROM m_ WHERE model = 'half')
SELECT count(*) AS golden, round(avg(y.ndcg) - avg(x.ndcg), 6) AS ndcg, round(avg(y.rr) - avg(x.rr), 6) AS rr, round(avg(y.recall) - avg(x.recall), 6) AS recall FROM {_metrics('a', 'rel', 10)} x JOIN {_metrics('b', 'rel', 10)} y USING (query_id)""",
    "score_log": f"""WITH {_LOG}, rel AS (SELECT query_id, page_id FROM lab WHERE relevant), pool AS (SELECT query_id, page_id, n + 1 - rank AS rank FROM runs),
o AS (SELECT DISTINCT query_id, 'm' || (query_id % 3) AS model, query_id IN (SELECT query_id FROM lab) AS labeled, query_id % 2 = 1 AND query_id % 5 NOT IN (1, 2) AND (query_id % 7 = 0 OR query_id % 5 = 0) AS eligible FROM runs),
s AS (SELECT o.*, x.ndcg, x.rr, x.recall, 1.0::DOUBLE AS pool_recall, CASE WHEN eligible THEN x.ndcg - y.ndcg END AS lift FROM o LEFT JOIN {_metrics('runs', 'rel', 3)} x USING (query_id) LEFT JOIN {_metrics('pool', 'rel', 3)} y USING (query_id))
SELECT model, count(*) AS logged, count(*) FILTER (labeled) AS labeled, count(*) FILTER (labeled AND ndcg IS NULL) AS skipped, count(ndcg) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(rr) FILTER (ndcg IS NOT NULL), 6) AS rr, round(avg(recall), 6) AS recall, round(avg(pool_recall) FILTER (ndcg IS NOT NULL), 6) AS pool_recall, round(avg(lift), 6) AS lift FROM s GROUP BY 1""",
    "golden_queries": f"""WITH {_LOG}, o AS (SELECT o_orderkey AS query_id, o_orderdate AS ts, ' Query  ' || (o_custkey % 40) || CASE WHEN o_orderkey % 2 = 0 THEN ' A' ELSE ' a' END AS query_text, 'query ' || (o_custkey % 40) || ' a' AS norm FROM orders WHERE o_orderkey IN (SELECT query_id FROM lab))
SELECT norm, arg_min(query_text, (ts, query_id)) AS query_text, (SELECT count(DISTINCT page_id) FROM lab JOIN o x USING (query_id) WHERE relevant AND x.norm = o.norm) AS n_relevant, count(*) AS n_sources, arg_min(query_id, (ts, query_id)) AS first FROM o GROUP BY norm HAVING n_relevant > 0""",
    "query_log_detail": "SELECT o_orderkey AS query_id, 'compare_arm' AS kind, 'm' || (o_orderkey % 3) AS active_model, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 7 = 0 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) QUALIFY rank <= 100",
    "query_log_upsert": "SELECT DISTINCT l_orderkey AS query_id, CASE WHEN l_orderkey % 10 = 1 AND l_orderkey % 20 <> 1 THEN 'new' ELSE 'm' || (l_orderkey % 3) END AS active_model FROM lineitem UNION ALL SELECT DISTINCT l_orderkey + 10000000, 'new' FROM lineitem WHERE l_orderkey % 20 = 1",
    "query_log_insert": "SELECT DISTINCT l_orderkey AS query_id, 'm' || (l_orderkey % 3) AS active_model FROM lineitem UNION ALL SELECT DISTINCT l_orderkey + 10000000, 'new' FROM lineitem WHERE l_orderkey % 20 = 1",
}
ORACLES |= {f.__name__: shown_twin(ORACLES[f.__name__]) for f in _SCORED}
