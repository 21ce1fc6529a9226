"""Registered reports and lookups, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import admin as A
from quern.operators.retrieval import dense_topk, ranked
from quern.plans.ledgers import _ALIASES, _JOBS, _MENTIONS, NOW, _aliases, _jobs, _mentions
from quern.operators.entities import canonical_forms
from quern.sources import model as M
from quern.sources.store import saved


def page_status_with_jobs(spark: SparkSession, d: str) -> DataFrame:
    return A.page_status(M.pages(spark, d), _jobs(spark, d), ("click", "view"))


def failures_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return A.failures_by_kind(_jobs(spark, d))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every event's JSON with its type put in, and the key k replaced for purchases."""
    new = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"k": "'), F.col("user_id"), F.lit('", "type": "purchase"}'))).otherwise(F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('"}')))
    return M.events(spark, d).select("event_id", A.merged_metadata(F.col("props"), new).alias("metadata"))


def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Part names, upper-case part names and keys looked up as entities."""
    p = M.table(spark, d, "part")
    asked = p.select(F.upper("p_name").alias("ref")).unionByName(p.select(F.col("p_partkey").cast("string").alias("ref"))).distinct()
    forms = canonical_forms(_mentions(spark, d))
    aliases = _aliases(spark, d).select("entity_id", F.lower("form").alias("normalized")).distinct()
    return A.resolve_entities(asked, forms, aliases)


def backfill_cost(spark: SparkSession, d: str) -> DataFrame:
    """Each language as a model to embed all chunks of its documents with, at 0.13 a million blank-separated words."""
    docs = M.table(spark, d, "documents").select(F.col("lang").alias("model_id"), F.size(F.split(F.trim("text"), " +")).alias("tokens"))
    return A.backfill_estimate(docs, 0.13)


def cluster_listing(spark: SparkSession, d: str) -> DataFrame:
    """Places are the first two coordinates; pages whose id is divisible by 7 have none."""
    e = M.table(spark, d, "embeddings")
    points = e.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("page_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return A.cluster_listing(M.members(spark, d), points)


def _models(spark, d):
    """Three models over the same pages: whole vectors, their first half, their last quarter."""
    v, q = M.vectors(spark, d), M.query_vectors(spark, d)
    out = None
    for pos, (name, at, n) in enumerate((("whole", 1, 64), ("half", 1, 32), ("quarter", 49, 16))):
        cut = lambda df: df.withColumn("vector", F.slice("vector", at, n))  # noqa: B023, E731
        r = dense_topk(cut(q), cut(v), 10).select("query_id", F.col("chunk_id").alias("item"), "rank", F.lit(name).alias("model"), F.lit(pos).alias("pos"))
        out = r if out is None else out.unionByName(r)
    return out


def compare_models(spark: SparkSession, d: str) -> DataFrame:
    # written once: pairs read the ranks four times, and joins over a union of ranked parts may not agree on partitions
    return A.model_pairs(saved(spark)(_models(spark, d)), 10)


def watch_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Every user as a watch of 1 to 24 hours; users whose number is divisible by 5 never ran."""
    last = F.when(F.col("user_id") % 5 != 0, F.col("ts"))
    w = M.events(spark, d).groupBy(F.col("user_id").alias("watch_id")).agg(F.max(last).alias("last_run_at")).withColumn("interval_hours", (F.col("watch_id") % 24 + 1).cast("int"))
    return A.next_runs(w, F.lit(NOW).cast("timestamp_ntz"))


def search_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """For each query vector the five nearest are shown; like the first of them, five more."""
    v = M.vectors(spark, d)
    shown = dense_topk(M.query_vectors(spark, d), v, 5).select("query_id", F.col("chunk_id").alias("page_id"), "rank")
    first = shown.where("rank = 1")
    seeds = v.join(first.select(F.col("page_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "vector")
    similar = dense_topk(seeds, v, 11).select("query_id", F.col("chunk_id").alias("page_id"), F.round("score", 6).alias("score"))
    return A.suggestions(first, similar, shown, 5)


def late_shipments(spark: SparkSession, d: str) -> DataFrame:
    """Relational ground: revenue by nation and status of orders with a line shipped 60 days or more after the order, the best three statuses a nation."""
    o, c, n, l = (M.table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    late = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.datediff("l_shipdate", "o_orderdate") >= 60)
    r = late.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    g = r.groupBy("n_name", "o_orderstatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))
    return ranked(g, ["n_name"], "revenue", "o_orderstatus", 3)


QUERIES = {f.__name__: f for f in (page_status_with_jobs, failures_by_kind, metadata_merge, entity_resolve, backfill_cost, cluster_listing, compare_models, watch_schedule, search_suggestions, late_shipments)}


def _near(at: int, n: int) -> str:
    x, y = f"(a.embedding::DOUBLE[])[{at}:{at + n - 1}]", f"(b.embedding::DOUBLE[])[{at}:{at + n - 1}]"
    return f"round(list_dot_product({x}, {y}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y}))), 9)"


_MODEL = "SELECT a.vec_id AS query_id, b.vec_id AS item, '{0}' AS model, {1} AS pos, row_number() OVER (PARTITION BY a.vec_id ORDER BY {2} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10"
ORACLES = {
    "page_status_with_jobs": f"""WITH {_JOBS}, l AS (SELECT * FROM jobs_ QUALIFY row_number() OVER (PARTITION BY page_id, kind ORDER BY created_at DESC, job_id DESC) = 1)
SELECT doc_id AS page_id, CASE WHEN doc_id % 10 = 9 THEN 'queued' ELSE 'indexed' END AS status, c.status AS click_status, v.status AS view_status FROM documents LEFT JOIN (SELECT * FROM l WHERE kind = 'click') c ON c.page_id = doc_id LEFT JOIN (SELECT * FROM l WHERE kind = 'view') v ON v.page_id = doc_id""",
    "failures_by_kind": f"WITH {_JOBS} SELECT kind, count(*) FILTER (status IN ('failed', 'dead')) AS failures, round(count(*) FILTER (status IN ('failed', 'dead')) / count(*), 6) AS share FROM jobs_ GROUP BY 1",
    "metadata_merge": """SELECT event_id, CASE WHEN event_type = 'purchase' THEN '{"k":"' || user_id || '","type":"purchase"}' ELSE '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' END AS metadata FROM events""",
    "entity_resolve": f"""WITH {_ALIASES}, {_MENTIONS}, f_ AS (SELECT entity_id, surface_form AS canonical_form FROM (SELECT entity_id, surface_form, count(*) AS n FROM m_ GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, surface_form) = 1),
r_ AS (SELECT upper(p_name) AS ref FROM part UNION SELECT p_partkey::VARCHAR FROM part),
h_ AS (SELECT ref, entity_id, 0 AS arm FROM r_ JOIN f_ ON ref = entity_id::VARCHAR UNION ALL SELECT ref, entity_id, 1 FROM r_ JOIN f_ ON lower(trim(ref)) = lower(canonical_form) UNION ALL SELECT ref, entity_id, 2 FROM r_ JOIN (SELECT DISTINCT entity_id, form FROM a_) ON lower(trim(ref)) = lower(form))
SELECT ref, entity_id FROM h_ QUALIFY row_number() OVER (PARTITION BY ref ORDER BY arm, entity_id) = 1""",
    "backfill_cost": "SELECT lang AS model_id, count(*) AS n_chunks, sum(t)::BIGINT AS n_tokens, round(sum(t) / 1e6 * 0.13, 6) AS cost, round(count(*) / 128 * 0.5, 6) AS duration_s FROM (SELECT lang, len(regexp_split_to_array(trim(text), ' +')) AS t FROM documents) GROUP BY 1",
    "cluster_listing": "SELECT label AS cluster_id, count(*) AS size, round(avg(CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END), 6) AS x, round(avg(CASE WHEN vec_id % 7 <> 0 THEN embedding[2]::DOUBLE END), 6) AS y FROM embeddings GROUP BY 1",
    "compare_models": f"""WITH r AS ({_MODEL.format('whole', 0, _near(1, 64))}), h AS ({_MODEL.format('half', 1, _near(1, 32))}), q AS ({_MODEL.format('quarter', 2, _near(49, 16))}), t AS (SELECT * FROM r UNION ALL SELECT * FROM h UNION ALL SELECT * FROM q)
SELECT x.query_id, x.model AS a, y.model AS b, count(*) FILTER (x.item = y.item) AS common, round(count(*) FILTER (x.item = y.item) / (count(DISTINCT x.item) + count(DISTINCT y.item) - count(*) FILTER (x.item = y.item)), 6) AS jaccard FROM t x JOIN t y ON x.query_id = y.query_id AND x.pos < y.pos GROUP BY 1, 2, 3""",
    "watch_schedule": f"SELECT user_id AS watch_id, coalesce(max(CASE WHEN user_id % 5 <> 0 THEN ts END), TIMESTAMP '{NOW}') + to_hours(any_value(user_id % 24 + 1)::BIGINT) AS next_run_at FROM events GROUP BY 1",
    "search_suggestions": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS page_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_near(1, 64)} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5),
n AS (SELECT a.vec_id AS seed, b.vec_id AS page_id, round({_near(1, 64)}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_near(1, 64)} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT page_id FROM s WHERE rank = 1) QUALIFY r <= 11)
SELECT query_id, seed, n.page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.page_id) AS rank FROM (SELECT query_id, page_id AS seed FROM s WHERE rank = 1) JOIN n USING (seed) WHERE (query_id, n.page_id) NOT IN (SELECT (query_id, page_id) FROM s) QUALIFY rank <= 5""",
    "late_shipments": "SELECT n_name, o_orderstatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders, row_number() OVER (PARTITION BY n_name ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, o_orderstatus) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE date_diff('day', o_orderdate, l_shipdate) >= 60 GROUP BY 1, 2 QUALIFY rank <= 3",
}
