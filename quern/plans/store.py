"""Registered queries on the store's verbs and rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import url as U
from quern.operators import clustering as C
from quern.operators import retrieval as R
from quern.operators import store as S
from quern.sources import model as M

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _pages(spark, d):
    return M.pages(spark, d).withColumn("last_seen_at", F.col("first_seen_at"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return S.by_id(M.pages(spark, d), "page_id", 42).select("page_id", "domain", "status")


def hydrate_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Lists of an order's part keys, some of which a table of small parts lacks."""
    lists = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    parts = M.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("part_id"), "p_name")
    return S.hydrate(lists, parts, "part_id")


def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The users of each event type in order of their first event."""
    e = M.events(spark, d).groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))), lambda x: x["user_id"]).alias("users"))
    return e.select("event_type", F.posexplode(F.array_distinct("users")).alias("pos", "user_id"))


def jobs_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = M.events(spark, d)
    return S.conjunction(e, event_type="error", user_id=None, since="2024-01-10").select("event_id", "user_id", "ts")


def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """Events whose payload has a number below ten."""
    return M.events(spark, d).where(_k().isNotNull() & (_k() < 10)).select("event_id", _k().alias("k"))


def pages_by_domain(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return S.page_ids_by_domain(p, p.select("domain"), 5, status="indexed")


def entities_on_page(spark: SparkSession, d: str) -> DataFrame:
    """Parts of orders as entities on pages; an entity's mentions are its lines."""
    m = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("entity_id"))
    return S.entities_on_page(m, m.groupBy("entity_id").agg(F.count("*").alias("mention_count")))


def create_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Requests for jobs whose keys repeat; those of purchases exist."""
    e = M.events(spark, d)
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    return S.created_jobs(e.where("event_type = 'purchase' AND user_id % 2 = 0").select(key.alias("idempotency_key")), e.select(F.col("event_id").alias("pos"), key.alias("idempotency_key")))


def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders that came again in another form."""
    old = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("value"))
    new = M.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("page_id"), F.lit(1).alias("ordinal"), F.col("o_totalprice").alias("value"))
    return S.replace_rows(old, new, "page_id")


def _models(spark, d):
    """Suppliers as models."""
    status = F.when(F.col("s_suppkey") % 4 == 0, "backfilling").otherwise("ready")
    return M.table(spark, d, "supplier").select(F.col("s_name").alias("id"), status.alias("status"), (F.col("s_suppkey") * 37 % 1000).alias("max_input_tokens"), (F.col("s_suppkey") == 1).alias("is_active"))


def activate_model(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    last = m.where("status = 'ready'").agg(F.max("id")).first()[0]
    return S.activated(m, last)


def model_rules(spark: SparkSession, d: str) -> DataFrame:
    return S.model_rules(_models(spark, d)).select("id", "may_register", "may_activate", "may_retire")


def model_slugs(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "part").select("p_partkey", X.model_slug("vectors", F.concat_ws("/", "p_brand", "p_name")).alias("slug"))


def backfill_next(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the next 25 orders after the first hundred that have no vector yet."""
    l = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    return S.pending_chunks(l, l.where("chunk_id % 3 = 0"), cursor=100)


def add_model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a second model beside the first one's, for the chunks that are there."""
    v = M.vectors(spark, d)
    new = v.where("chunk_id % 2 = 0").select((F.col("chunk_id") + F.when(F.col("chunk_id") % 10 == 0, 100_000_000).otherwise(0)).alias("chunk_id"), F.slice("vector", 1, 8).alias("second"))
    return v.join(new, "chunk_id", "left").select("chunk_id", F.size("vector").alias("n_first"), F.coalesce(F.size("second"), F.lit(0)).alias("n_second"))


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.token_windows(M.events(spark, d).select("ts", (F.col("user_id") * 7).alias("tokens")), rpm=1, tpm=900)


def retry_times(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(_k() % 5 == 0, _k() * 10)
    return M.events(spark, d).where("event_type = 'error'").select("event_id", S.retry_at(F.col("ts"), _k() % 6, 2.0, asked).alias("retry_at"))


def lease_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Users' purchases as running jobs, their views as beats."""
    e = M.events(spark, d)
    until = (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("lease_until")
    jobs = e.where("event_type IN ('purchase', 'signup')").select(F.col("event_id").alias("job_id"), "user_id", F.when(F.col("event_type") == "purchase", "running").otherwise("done").alias("status"), until)
    beats = jobs.join(e.where("event_type = 'view'").select("user_id", "ts"), "user_id").select("job_id", "ts")
    return S.heartbeat(jobs.drop("user_id"), beats, 900)


def watch_problems(spark: SparkSession, d: str) -> DataFrame:
    """Pages' URLs as watches of all kinds, with some that are no listing, no address or a sound file."""
    i = F.col("page_id")
    url = F.when(i % 7 == 0, F.regexp_replace("url", "^https?://", "ftp://")).when(i % 7 == 1, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".mp3"))).when(i % 7 == 2, F.concat(F.lit("https://www.youtube.com/playlist?list=PL"), i.cast("string"))).when(i % 7 == 3, F.lit("nothing")).otherwise(F.col("url"))
    kind = F.when(i % 3 == 0, "rss").when(i % 3 == 1, "podcast").otherwise("youtube")
    w = M.table(spark, d, "pages").select("page_id", kind.alias("kind"), url.alias("url"), (i % 9000).cast("int").alias("hours"))
    return w.select("page_id", S.watch_problem(F.col("kind"), F.col("url"), F.col("hours")).alias("problem"))


def watch_patches(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "customer")
    i = F.col("c_custkey")
    last = F.when(i % 4 != 0, _now() - F.make_dt_interval(F.lit(0), (i % 50).cast("int")))
    w = c.select(i.alias("watch_id"), F.col("c_name").alias("title"), (i % 2 == 0).alias("enabled"), F.lit(24).alias("interval_hours"), last.alias("last_run_at"), _now().alias("next_run_at"))
    given = F.when(i % 3 == 0, F.create_map(F.lit("interval_hours"), (i % 30 + 1).cast("string"))).when(i % 3 == 1, F.create_map(F.lit("title"), F.lit(None).cast("string"), F.lit("enabled"), F.lit("false")))
    return S.patched_watches(w, c.where(i % 5 != 0).select(i.alias("watch_id"), given.alias("set")), _now())


def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return S.newest_first(M.events(spark, d), "ts", "event_id", 50).select("event_id", "event_type", "rank")


def capped_items(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten events a user, some without a time."""
    e = M.events(spark, d).select("user_id", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("published_at"))
    return S.cap_newest(e, "user_id", "published_at", "event_id", 10).select("user_id", "event_id", "rank")


def rank_problems(spark: SparkSession, d: str) -> DataFrame:
    """Lists of line numbers by order, as they are, from 0, reversed or short of one."""
    o = F.col("l_orderkey")
    lists = M.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    own = F.sequence(F.lit(1), F.size("ids"))
    ranks = F.when(o % 4 == 0, own).when(o % 4 == 1, F.transform(own, lambda x: x - 1)).when(o % 4 == 2, F.reverse(own)).otherwise(F.slice(own, 2, F.size("ids")))
    return lists.select("l_orderkey", S.rank_problem(F.col("ids"), ranks).alias("problem"))


def _runs(spark, d):
    """Purchases as finished cluster runs."""
    return M.events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), (F.col("value") * 1000).alias("duration_ms"))


def cluster_trigger(spark: SparkSession, d: str) -> DataFrame:
    times = S.store_times(M.pages(spark, d), _runs(spark, d), F.lit("2024-01-15").cast("timestamp_ntz"))
    out = S.should_cluster(times, C.idle_threshold_s(_runs(spark, d)), F.lit("2030-01-01").cast("timestamp_ntz"))
    return times.crossJoin(out).select("n_indexed", "n_since", "should_run")


def value_by_label(spark: SparkSession, d: str) -> DataFrame:
    return M.events(spark, d).groupBy("event_type", F.pmod(_k(), F.lit(3)).alias("label")).agg(F.round(F.sum("value"), 4).alias("total"))


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the stated queries to their ten nearest."""
    edges = S.knn_edges(R.dense_topk(M.query_vectors(spark, d), M.vectors(spark, d), 11))
    return edges.withColumn("weight", F.round("weight", 6))


def _fit(spark, d):
    e = M.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("page_id"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("cluster_id"), F.lit(0.5).alias("probability"))


def cluster_membership(spark: SparkSession, d: str) -> DataFrame:
    return S.membership(_fit(spark, d))


def cluster_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.run_counts(_fit(spark, d))


def upsert_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Nations as clusters, those with many customers as the new run."""
    i = F.col("n_nationkey")
    old = M.table(spark, d, "nation").select(i.alias("cluster_id"), F.col("n_name").alias("label"), F.lit("a,b").alias("keywords"), F.lit(1).cast("long").alias("size"), F.when(i % 2 == 0, _now()).alias("tombstoned_at"))
    n = M.table(spark, d, "customer").groupBy((F.col("c_nationkey") * 2).alias("cluster_id")).agg(F.count("*").alias("size"))
    return S.upsert_clusters(old, n.select("cluster_id", F.when(F.col("cluster_id") % 4 == 0, F.concat(F.lit("new "), F.col("cluster_id").cast("string"))).alias("label"), F.lit(None).cast("string").alias("keywords"), "size"))


def cluster_texts(spark: SparkSession, d: str) -> DataFrame:
    p = M.pages(spark, d).withColumn("title", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"))))
    t = S.cluster_texts(M.members(spark, d).where("page_id % 2 = 0"), p)
    return t.select("cluster_id", "page_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


def domain_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What users may type for a domain, and whether a search would take it for one."""
    i = F.col("page_id")
    host = U.host(F.col("url"))
    typed = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit(" WWW."), host, F.lit(". "))).when(i % 5 == 2, F.concat(host, F.lit("/a?b"))).when(i % 5 == 3, F.lit("no domain")).otherwise(host)
    return M.table(spark, d, "pages").select("page_id", U.normal_domain(typed).alias("domain"), U.is_bare_domain(typed).alias("bare"))


QUERIES = {f.__name__: f for f in (point_lookup, hydrate_in_order, distinct_in_order, jobs_filtered, json_payload, pages_by_domain, entities_on_page, create_jobs, replace_chunks, activate_model, model_rules, model_slugs, backfill_next, add_model_vectors, token_windows, retry_times, lease_heartbeats, watch_problems, watch_patches, newest_jobs, capped_items, rank_problems, cluster_trigger, value_by_label, knn_graph, cluster_membership, cluster_run_counts, upsert_clusters, cluster_texts, domain_inputs)}

_P = "p_ AS (SELECT doc_id AS page_id, source AS domain, text AS body_text, TIMESTAMP '2024-01-01' + to_hours(doc_id::BIGINT) AS first_seen_at, CASE WHEN doc_id % 10 = 9 THEN 'queued' ELSE 'indexed' END AS status FROM documents)"
_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_MODELS = "m_ AS (SELECT s_name AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'backfilling' ELSE 'ready' END AS status, s_suppkey * 37 % 1000 AS max_input_tokens, s_suppkey = 1 AS is_active FROM supplier)"
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '')"
_FITTED = "f_ AS (SELECT vec_id AS page_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster_id FROM embeddings)"

ORACLES = {
    "point_lookup": f"WITH {_P} SELECT page_id, domain, status FROM p_ WHERE page_id = 42",
    "hydrate_in_order": "WITH l AS (SELECT l_orderkey AS list_id, l_partkey AS part_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem) SELECT list_id, pos, part_id, p_name FROM l JOIN part ON part_id = p_partkey WHERE p_size <= 25",
    "distinct_in_order": "SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY first) - 1 AS pos FROM (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY 1, 2)",
    "jobs_filtered": "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10'",
    "json_payload": f"SELECT event_id, {_K} AS k FROM events WHERE {_K} < 10",
    "pages_by_domain": f"WITH {_P} SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY first_seen_at DESC, page_id) AS rank FROM p_ WHERE status = 'indexed' QUALIFY rank <= 5",
    "entities_on_page": "WITH e AS (SELECT l_partkey AS entity_id, count(*) AS mention_count FROM lineitem GROUP BY 1) SELECT page_id, entity_id, mention_count, row_number() OVER (PARTITION BY page_id ORDER BY mention_count DESC, entity_id) AS rank FROM (SELECT DISTINCT l_orderkey AS page_id, l_partkey AS entity_id FROM lineitem) JOIN e USING (entity_id)",
    "create_jobs": "SELECT event_type || ':' || user_id AS idempotency_key, event_id AS pos, NOT (event_type = 'purchase' AND user_id % 2 = 0) AND row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 AS created FROM events",
    "replace_chunks": "SELECT l_orderkey AS page_id, l_linenumber AS ordinal, l_quantity AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders WHERE o_orderkey % 3 = 0",
    "activate_model": f"WITH {_MODELS} SELECT id, status, max_input_tokens, id = (SELECT max(id) FROM m_ WHERE status = 'ready') AS is_active FROM m_",
    "model_rules": f"WITH {_MODELS} SELECT id, max_input_tokens >= 512 AS may_register, status = 'ready' AS may_activate, NOT is_active AS may_retire FROM m_",
    "model_slugs": r"SELECT p_partkey, 'vectors_' || substring(lower(regexp_replace(regexp_replace(m, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')), 1, 48) || '_' || substring(sha256(m), 1, 12) AS slug FROM (SELECT p_partkey, p_brand || '/' || p_name AS m FROM part)",
    "backfill_next": "WITH l AS (SELECT l_orderkey AS page_id, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem), a AS (SELECT * FROM l WHERE chunk_id % 3 <> 0 AND page_id > 100) SELECT chunk_id, page_id FROM a WHERE page_id IN (SELECT DISTINCT page_id FROM a ORDER BY 1 LIMIT 25)",
    "add_model_vectors": "SELECT vec_id AS chunk_id, len(embedding) AS n_first, CASE WHEN vec_id % 2 = 0 AND vec_id % 10 <> 0 THEN 8 ELSE 0 END AS n_second FROM embeddings",
    "token_windows": "SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, sum(user_id * 7)::BIGINT AS tokens, count(*) <= 1 AND sum(user_id * 7) <= 900 AS within FROM events GROUP BY 1",
    "retry_times": f"SELECT event_id, ts + to_seconds(greatest(2.0 * pow(2, {_K} % 6), coalesce(CASE WHEN {_K} % 5 = 0 THEN {_K} * 10 END, 0))) AS retry_at FROM events WHERE event_type = 'error'",
    "lease_heartbeats": "WITH b AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1) SELECT event_id AS job_id, CASE WHEN event_type = 'purchase' THEN 'running' ELSE 'done' END AS status, CASE WHEN event_type = 'purchase' AND b.ts IS NOT NULL THEN greatest(e.ts, b.ts) ELSE e.ts END + INTERVAL 15 MINUTE AS lease_until FROM events e LEFT JOIN b USING (user_id) WHERE event_type IN ('purchase', 'signup')",
    "watch_problems": "SELECT page_id, CASE WHEN page_id % 7 IN (0, 3) THEN 'url' WHEN page_id % 9000 NOT BETWEEN 1 AND 8760 THEN 'interval' WHEN page_id % 3 = 1 AND page_id % 7 = 1 THEN 'audio' WHEN page_id % 3 = 2 AND page_id % 7 <> 2 THEN 'listing' END AS problem FROM pages",
    "watch_patches": f"""WITH w AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE c_custkey % 3 END AS k, CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(c_custkey % 50) END AS last FROM customer),
x AS (SELECT *, CASE WHEN k = 0 THEN c_custkey % 30 + 1 ELSE 24 END AS hours FROM w)
SELECT c_custkey AS watch_id, CASE WHEN k <> 1 THEN c_name END AS title, CASE WHEN k = 1 THEN false ELSE c_custkey % 2 = 0 END AS enabled, hours AS interval_hours, CASE WHEN hours <> 24 THEN coalesce(last, TIMESTAMP '{NOW}') + to_hours(hours) ELSE TIMESTAMP '{NOW}' END AS next_run_at FROM x""",
    "newest_jobs": "SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events QUALIFY rank <= 50",
    "capped_items": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 <> 0 THEN ts END DESC NULLS LAST, event_id) AS rank FROM events QUALIFY rank <= 10",
    "rank_problems": "SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 3 THEN 'length' WHEN l_orderkey % 4 = 1 THEN 'positive' WHEN l_orderkey % 4 = 2 AND count(*) > 1 THEN 'order' END AS problem FROM lineitem GROUP BY 1",
    "cluster_trigger": f"WITH {_P} SELECT count(*) FILTER (status = 'indexed') AS n_indexed, count(*) FILTER (status = 'indexed' AND first_seen_at > TIMESTAMP '2024-01-15') AS n_since, count(*) > 0 AND max(first_seen_at) < TIMESTAMP '2029-12-31' AND CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'purchase') = 0 THEN n_indexed >= 50 ELSE n_since >= 20 END AS should_run FROM p_",
    "value_by_label": f"SELECT event_type, {_K} % 3 AS label, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "knn_graph": """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 11)
SELECT least(q, c) AS a, greatest(q, c) AS b, round(max(1 / (1 + greatest(1 - score, 0))), 6) AS weight FROM s WHERE q <> c GROUP BY 1, 2""",
    "cluster_membership": f"WITH {_FITTED} SELECT cluster_id, page_id, 0.5::DOUBLE AS probability FROM f_ WHERE cluster_id >= 0",
    "cluster_run_counts": f"WITH {_FITTED} SELECT count(*) AS n_pages, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters, count(*) FILTER (cluster_id < 0) AS n_noise FROM f_",
    "upsert_clusters": f"""WITH n AS (SELECT c_nationkey * 2 AS cluster_id, count(*) AS size FROM customer GROUP BY 1)
SELECT coalesce(n.cluster_id, n_nationkey) AS cluster_id, coalesce(CASE WHEN n.cluster_id % 4 = 0 THEN 'new ' || n.cluster_id END, n_name) AS label, CASE WHEN n_nationkey IS NOT NULL THEN 'a,b' END AS keywords, coalesce(size, 1) AS size, CASE WHEN n.cluster_id IS NULL AND n_nationkey % 2 = 0 THEN TIMESTAMP '{NOW}' END AS tombstoned_at FROM nation FULL JOIN n ON n.cluster_id = n_nationkey""",
    "cluster_texts": "SELECT label AS cluster_id, vec_id AS page_id, length(t) AS n, sha256(t) AS digest FROM (SELECT label, vec_id, CASE WHEN vec_id % 3 <> 0 THEN 'Page ' || vec_id ELSE '' END || ' ' || substring(coalesce(text, ''), 1, 2000) AS t FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 2 = 0)",
    "domain_inputs": rf"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 5 <> 3 AND contains(host, '.') THEN host END AS domain, page_id % 5 = 4 AND regexp_matches(host, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9-]+)+$') AS bare FROM h""",
}
