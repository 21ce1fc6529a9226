"""Registered queries on evaluation, time series, ledgers and entities, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import entities as E
from quern.operators import merges as G
from quern.operators import jobs as J
from quern.operators import metrics as K
from quern.operators import timeseries as T
from quern.plans.retrieval import _ALL, _MAX, _PAGES, _fused_chunks
from quern.operators.retrieval import rollup
from quern.sources import model as M
from quern.sources.store import saved

NOW = "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _jobs(spark, d):
    """Events as a job ledger: the type is the kind, the user the page; status by the JSON's k."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 7 == 0, "dead").when(k % 5 == 0, "failed").when(k % 3 == 0, "running").when(k % 2 == 0, "pending").otherwise("done")
    return M.events(spark, d).select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("page_id"), status.alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("lease_until"))


_JOBS = """jobs_ AS (SELECT event_id AS job_id, event_type AS kind, user_id AS page_id, CASE WHEN k % 7 = 0 THEN 'dead' WHEN k % 5 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'running' WHEN k % 2 = 0 THEN 'pending' ELSE 'done' END AS status, ts AS created_at, ts + INTERVAL 15 MINUTE AS lease_until
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def _ranking(spark, d, by):
    """Two rankings of each event type's users, by summed value and by count: the item lists that metrics compare."""
    s = M.events(spark, d).groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("item")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").alias("n"))
    from quern.operators.retrieval import ranked

    return ranked(s, ["query_id"], by, "item", 20).select("query_id", "item", "rank")


_RANKINGS = """s_ AS (SELECT event_type AS query_id, user_id AS item, round(sum(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2),
ra AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, item) AS rank FROM s_ QUALIFY rank <= 20),
rb AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item) AS rank FROM s_ QUALIFY rank <= 20)"""


def compare_agreement_jaccard(spark: SparkSession, d: str) -> DataFrame:
    lists = lambda by: _ranking(spark, d, by).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(by))
    both = lists("v").join(lists("n"), "query_id")
    return both.select("query_id", F.round(K.jaccard_at_k(F.col("v"), F.col("n"), 10), 6).alias("jaccard"), F.size(F.array_intersect(F.slice("v", 1, 10), F.slice("n", 1, 10))).cast("long").alias("common"))


def compare_kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return K.kendall_tau(_ranking(spark, d, "v"), _ranking(spark, d, "n")).withColumn("tau", F.round("tau", 6))


def compare_rbo(spark: SparkSession, d: str) -> DataFrame:
    return K.rank_biased_overlap(_ranking(spark, d, "v"), _ranking(spark, d, "n").where("rank <= 15")).withColumn("rbo", F.round("rbo", 6))


def _relevant(spark, d):
    """(query_id, item): pages with a document that is labelled good, dealt out to twenty queries."""
    return M.table(spark, d, "labels").where("quality = 1").select((F.col("doc_id") % 20).alias("query_id"), F.expr("doc_id div 4").alias("item")).distinct()


def _final(spark, d):
    return rollup(_fused_chunks(spark, d)).select("query_id", F.col("page_id").alias("item"), "rank")


def eval_ndcg_mrr_recall(spark: SparkSession, d: str) -> DataFrame:
    return K.relevance(_final(spark, d), _relevant(spark, d), 10)


def eval_rerank_lift(spark: SparkSession, d: str) -> DataFrame:
    """nDCG of pages by their best chunk less that of the pool in the order in which pages first appear in the fused list."""
    from pyspark.sql import Window

    c = saved(spark)(_fused_chunks(spark, d))
    first = c.groupBy("query_id", "page_id").agg(F.min(F.struct(-F.col("fusion"), F.col("chunk_id"))).alias("at"))
    pool = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long")).select("query_id", F.col("page_id").alias("item"), "rank")
    sums = rollup(c, "sum_rrf").select("query_id", F.col("page_id").alias("item"), "rank")
    rel = _relevant(spark, d)
    a, b = K.relevance(sums, rel, 10).select("query_id", F.col("ndcg").alias("final_ndcg")), K.relevance(pool, rel, 10).select("query_id", F.col("ndcg").alias("pool_ndcg"))
    return a.join(b, "query_id").withColumn("lift", F.round(F.col("final_ndcg") - F.col("pool_ndcg"), 6))


def eval_model_report(spark: SparkSession, d: str) -> DataFrame:
    """Means over the queries of two model groups."""
    m = F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("model")
    return eval_ndcg_mrr_recall(spark, d).groupBy(m).agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("rr"), 5).alias("mrr"), F.round(F.avg("recall"), 5).alias("recall"))


def golden_set(spark: SparkSession, d: str) -> DataFrame:
    """Queries (user turns) with the same normal form become one, with all their positives and the first text."""
    c = M.table(spark, d, "conversations").where("role = 'user'")
    q = c.select(X.query_norm(F.col("text")).alias("norm"), "text", "conv_id", "turn").where("norm <> ''")
    at = F.struct("conv_id", "turn")
    g = q.groupBy("norm").agg(F.min_by("text", at).alias("text"), F.array_sort(F.collect_set("conv_id")).alias("ids"), F.count("*").alias("n"))
    return g.select("norm", "text", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("sources"))


def latest_feedback_wins(spark: SparkSession, d: str) -> DataFrame:
    f = M.events(spark, d).select("event_id", "ts", F.col("event_type").alias("query_id"), F.col("user_id").alias("page_id"), (F.col("value") > 20).alias("relevant"))
    return T.latest_label(f, ["query_id", "page_id"], "relevant")


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = T.latency_quantiles(M.events(spark, d).select(F.col("value").alias("total")))
    return q.select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def metric_gauge_downsample(spark: SparkSession, d: str) -> DataFrame:
    return T.gauge_downsample(M.events(spark, d), 21600, ["event_type"])


def metric_counter_delta(spark: SparkSession, d: str) -> DataFrame:
    return T.counter_delta(M.events(spark, d), 21600, ["event_type"])


def job_counts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return J.counts_by_status(_jobs(spark, d), ["pending", "running", "done", "failed", "dead", "cancelled"])


def latest_job_per_page(spark: SparkSession, d: str) -> DataFrame:
    return J.newest(_jobs(spark, d), ["page_id", "kind"], [F.desc("created_at"), F.desc("job_id")]).select("page_id", "kind", "job_id", "status")


def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return J.expired_leases(_jobs(spark, d), _now()).select("job_id", "kind", "page_id")


def due_watches(spark: SparkSession, d: str) -> DataFrame:
    """Each user as a watch, due a week after their last event; the fifty due the longest."""
    w = M.events(spark, d).groupBy(F.col("user_id").alias("watch_id")).agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("next_run_at"), (F.count("*") % 2 == 0).alias("enabled"))
    return J.due_watches(w, F.lit("2024-02-06 00:00:00").cast("timestamp_ntz"), 50).select("watch_id", "next_run_at")


def missing_extraction_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Indexed pages without an extraction job for the hash of their present text; every third document has one, every ninth for an old text."""
    p = M.pages(spark, d).where("status = 'indexed'").select("page_id", X.content_hash(F.col("body_text")).alias("hash"))
    old = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    j = M.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), X.content_hash(old).alias("hash"))
    return p.join(j, ["page_id", "hash"], "left_anti").select("page_id", "hash")


def _rules(spark):
    rows = [(1, "domain", "example.net", 1), (2, "domain", "spam-farm.example.org", 2), (3, "domain", "example.org", 3), (4, "url", "http://therha.example.com/en/676", 0), (5, "domain", "casino-win.example.org", 1)]
    return spark.createDataFrame(rows, "rule_id int, kind string, pattern string, created_at int")


_RULES = "rules_ AS (SELECT * FROM (VALUES (1, 'domain', 'example.net', 1), (2, 'domain', 'spam-farm.example.org', 2), (3, 'domain', 'example.org', 3), (4, 'url', 'http://therha.example.com/en/676', 0), (5, 'domain', 'casino-win.example.org', 1)) t(rule_id, kind, pattern, created_at))"


def _page_urls(spark, d):
    from quern.functions.url import host

    return M.table(spark, d, "pages").select("page_id", "url", host(F.col("url")).alias("domain"))


_URLS = r"urls_ AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS domain FROM pages)"
_BLACK = """hits_ AS (SELECT page_id, rule_id FROM urls_ JOIN rules_ ON (kind = 'url' AND pattern = url) OR (kind = 'domain' AND (domain = pattern OR ends_with(domain, '.' || pattern))) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY kind = 'url' DESC, created_at DESC, rule_id) = 1)"""


def blacklist_match(spark: SparkSession, d: str) -> DataFrame:
    return J.blacklist_match(_page_urls(spark, d), _rules(spark))


def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each page as one batch in order of ids: the key is the canonical url without its query; every seventh page is known."""
    u = _page_urls(spark, d).withColumn("url", F.regexp_replace("url", r"[?#].*$|/$", "")).withColumn("pos", F.col("page_id"))
    return J.ingest_outcomes(u, u.where("page_id % 7 = 0"), _rules(spark).where("kind = 'domain'"))


def outcome_tally(spark: SparkSession, d: str) -> DataFrame:
    return ingest_batch(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


def forget_domain(spark: SparkSession, d: str) -> DataFrame:
    """Chunks a page that are left when the domain src3 is forgotten."""
    t = J.forget({"pages": M.pages(spark, d), "chunks": M.chunks(spark, d)}, "src3")
    return t["chunks"].groupBy("page_id").agg(F.count("*").alias("n_chunks"))


def tombstone_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every document has a tombstone of an age and state by its id; chunks are left of embedded pages."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "deleted", "verified"))), (F.col("doc_id") % 3 + 1).cast("int"))
    t = M.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), status.alias("status"), F.expr("timestamp_ntz '2024-01-20 00:00:00' - make_dt_interval(0, CAST(doc_id AS INT))").alias("updated_at"))
    return J.tombstone_sweep(t, M.vectors(spark, d).select("page_id"), _now())


def revisit_fold(spark: SparkSession, d: str) -> DataFrame:
    v = M.events(spark, d).select(F.concat_ws("/", "event_type", "user_id").alias("url"), F.col("ts").alias("at"))
    return J.revisit_fold(v)


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as calls of a provider; errors are failures."""
    o = M.events(spark, d).select(F.col("user_id").alias("breaker"), "ts", F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("ok"))
    return J.fold_breaker(o)


def _aliases(spark, d):
    p = M.table(spark, d, "part").select(X.surface_norm(F.col("p_name")).alias("form"), F.col("p_type").alias("type"), "p_partkey", F.col("p_name").alias("surface_form"), F.col("p_size").alias("char_start"))
    e = p.groupBy("form", "type").agg(F.min("p_partkey").alias("entity_id"))
    return p.join(e, ["form", "type"]).withColumn("block_key", X.block_key(F.col("form")))


_ALIASES = r"""p_ AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS f, p_type AS type, p_partkey, p_name AS surface_form, p_size AS char_start FROM part),
n_ AS (SELECT *, CASE WHEN regexp_matches(f, '(ss|us|is)$') OR len(regexp_extract(f, '(\S*)$', 1)) < 4 THEN f WHEN regexp_matches(f, '[^aeiou]ies$') THEN regexp_replace(f, 'ies$', 'y') WHEN regexp_matches(f, '(sh|ch|x|z|ss)es$') THEN regexp_replace(f, 'es$', '') ELSE regexp_replace(f, 's$', '') END AS form FROM p_),
a_ AS (SELECT n_.*, min(p_partkey) OVER (PARTITION BY form, type) AS entity_id, split_part(form, ' ', 1) AS block_key FROM n_)"""


def entity_blocks_dups(spark: SparkSession, d: str) -> DataFrame:
    return E.duplicate_blocks(_aliases(spark, d))


def _entities(spark, d):
    return _aliases(spark, d).select("type", "block_key", "entity_id", "form").distinct()


def entity_pair_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return E.close_pairs(_entities(spark, d), 0.4)


def entity_components(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    return E.components(E.close_pairs(e, 0.4), e.select("entity_id").distinct(), saved(spark))


def _mentions(spark, d):
    """Line items as mentions: the part's entity on the order's page."""
    a = _aliases(spark, d).select("p_partkey", "entity_id", "surface_form")
    return M.table(spark, d, "lineitem").join(a, F.col("l_partkey") == F.col("p_partkey")).select("entity_id", F.col("l_orderkey").alias("page_id"), "surface_form", F.col("l_linenumber").alias("char_start"))


_MENTIONS = "m_ AS (SELECT entity_id, l_orderkey AS page_id, surface_form, l_linenumber AS char_start FROM lineitem JOIN a_ ON l_partkey = p_partkey)"


def entity_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts after every close entity has been merged into its component's most mentioned one."""
    m = _mentions(spark, d)
    members = entity_components(spark, d).join(E.entity_counts(m), "entity_id")
    return E.entity_counts(E.apply_merges(m, E.merge_plan(members)))


def canonical_form_mode(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_forms(_mentions(spark, d))


def _idf(spark, d):
    return E.idf(_mentions(spark, d), M.table(spark, d, "orders").agg(F.count("*").alias("n_pages")))


def entity_idf(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d)


def entity_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the orders whose key is divisible by 50; the ten most alike of each."""
    save = saved(spark)
    a = save(_aliases(spark, d).select("p_partkey", "entity_id"))
    lines = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("p_partkey"))
    m = save(lines.join(a, "p_partkey").select("page_id", "entity_id").distinct())
    counts = m.groupBy("entity_id").agg(F.count("page_id").alias("page_count"))
    weights = save(E.idf_of_counts(counts, M.table(spark, d, "orders").agg(F.count("*").alias("n_pages"))))
    q = save(m.where("page_id % 50 = 0").select("page_id").distinct())
    return E.most_similar(m, weights, q, 10, save)


def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Part names linked in order of their first key."""
    s = _aliases(spark, d).groupBy("block_key", "form").agg(F.min("p_partkey").alias("first_seen"))
    return E.link_greedily(s, saved(spark), 0.4)


def link_known_forms(spark: SparkSession, d: str) -> DataFrame:
    """Part names linked to the entities of every tenth of them."""
    a = _aliases(spark, d).select("type", "block_key", "form", F.col("p_partkey").alias("entity_id"))
    return E.link_to_known(a, a.where("entity_id % 10 = 1"), edit=0.4)


def merges_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Each user is merged into that of half its number, from the last on; then the first ones are undone, and the counts are those after the undo of user 30."""
    e = M.events(spark, d)
    u = e.select(F.col("user_id").cast("long").alias("u")).distinct().where("u > 0")
    merges = u.select((1_000_000_000 - F.col("u")).alias("seq"), F.lit("merge").alias("kind"), F.col("u").alias("merge_id"), F.col("u").alias("source"), F.expr("u div 2").alias("target"))
    none = F.lit(None).cast("long")
    undos = u.where("u <= 40").select((2_000_000_000 + F.col("u")).alias("seq"), F.lit("undo").alias("kind"), F.col("u").alias("merge_id"), none.alias("source"), none.alias("target"))
    first = e.select(F.col("user_id").cast("long").alias("entity_id"), (F.col("event_id") % 50).alias("page_id"), F.col("event_type").alias("surface_form"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3).alias("char_start"))
    return E.entity_counts(G.mentions_at(first, merges.unionByName(undos), saved(spark), 2_000_000_030))


def undoable_merges(spark: SparkSession, d: str) -> DataFrame:
    """Events as merges of users."""
    i = F.col("event_id")
    m = M.events(spark, d).select(i.alias("merge_id"), F.col("user_id").alias("source"), ((F.col("user_id") * 7 + i) % 150).alias("target"), F.col("ts").alias("merged_at"), F.when(i % 4 != 0, F.col("ts")).alias("undone_at"))
    return E.undoable(m)


QUERIES = {f.__name__: f for f in (compare_agreement_jaccard, compare_kendall_tau, compare_rbo, eval_ndcg_mrr_recall, eval_rerank_lift, eval_model_report, golden_set, latest_feedback_wins, latency_quantiles, metric_gauge_downsample, metric_counter_delta, job_counts_by_status, latest_job_per_page, expired_leases, due_watches, missing_extraction_antijoin, blacklist_match, ingest_batch, outcome_tally, forget_domain, tombstone_sweep, revisit_fold, breaker_states, entity_blocks_dups, entity_pair_edit_distance, entity_components, entity_merge_counts, canonical_form_mode, entity_idf, entity_similarity, entity_links, link_known_forms, undoable_merges, merges_replayed)}

_FINAL = f"{_ALL} {_MAX}, fin AS (SELECT query_id, page_id AS item, rank FROM maxed), rel AS (SELECT DISTINCT doc_id % 20 AS query_id, doc_id // 4 AS item FROM labels WHERE quality = 1)"


def _metric(source: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, round(CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, least(n_rel, 10) + 1) t(i)) END, 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(CASE WHEN n_rel > 0 THEN coalesce(found, 0) / n_rel END, 6) AS recall
FROM (SELECT DISTINCT query_id FROM {source}) LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) END) AS dcg, min(rank) AS first, count(*) FILTER (rank <= 10) AS found FROM {source} JOIN rel USING (query_id, item) GROUP BY 1) USING (query_id))"""


_PAIRS = f"""{_ALIASES}, e_ AS (SELECT DISTINCT type, block_key, entity_id, form FROM a_),
pairs_ AS (SELECT x.entity_id AS a, y.entity_id AS b, round(levenshtein(x.form, y.form) / greatest(len(x.form), len(y.form)), 6) AS distance FROM e_ x JOIN e_ y ON x.type = y.type AND x.block_key = y.block_key AND x.entity_id < y.entity_id WHERE distance <= 0.4)"""
_COMPONENTS = f"""WITH RECURSIVE {_PAIRS}, both_ AS (SELECT a, b FROM pairs_ UNION SELECT b, a FROM pairs_),
walk AS (SELECT DISTINCT entity_id, entity_id AS r FROM e_ UNION SELECT w.entity_id, b FROM walk w JOIN both_ ON r = a),
comp AS (SELECT entity_id, min(r) AS component FROM walk GROUP BY 1)"""

ORACLES = {
    "compare_agreement_jaccard": f"""WITH {_RANKINGS}, x AS (SELECT query_id, count(*) AS c FROM ra JOIN rb USING (query_id, item) WHERE ra.rank <= 10 AND rb.rank <= 10 GROUP BY 1), n AS (SELECT query_id, count(*) FILTER (rank <= 10) AS na FROM ra GROUP BY 1), m AS (SELECT query_id, count(*) FILTER (rank <= 10) AS nb FROM rb GROUP BY 1)
SELECT query_id, round(coalesce(c, 0) / (na + nb - coalesce(c, 0)), 6) AS jaccard, coalesce(c, 0) AS common FROM n JOIN m USING (query_id) LEFT JOIN x USING (query_id)""",
    "compare_kendall_tau": f"""WITH {_RANKINGS}, c AS (SELECT query_id, item, ra.rank AS x, rb.rank AS y FROM ra JOIN rb USING (query_id, item)), n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1)
SELECT n.query_id, round(CASE WHEN n >= 2 THEN t / (n * (n - 1) / 2) END, 6) AS tau FROM n LEFT JOIN (SELECT p.query_id, sum(sign(q.y - p.y)) AS t FROM c p JOIN c q ON p.query_id = q.query_id AND p.x < q.x GROUP BY 1) s USING (query_id)""",
    "compare_rbo": f"""WITH {_RANKINGS}, b15 AS (SELECT * FROM rb WHERE rank <= 15), h AS (SELECT query_id, greatest(ra.rank, b15.rank) AS dep FROM ra JOIN b15 USING (query_id, item)),
z AS (SELECT query_id, least(la, lb) AS s, greatest(la, lb) AS l FROM (SELECT query_id, max(rank) AS la FROM ra GROUP BY 1) JOIN (SELECT query_id, max(rank) AS lb FROM b15 GROUP BY 1) USING (query_id)),
x AS (SELECT query_id, s, l, d, (SELECT count(*) FROM h WHERE h.query_id = y.query_id AND dep <= d) AS x FROM (SELECT *, unnest(range(1, l + 1)) AS d FROM z) y),
e AS (SELECT query_id, any_value(s) AS s, any_value(l) AS l, max(x) FILTER (d = s) AS xs, max(x) FILTER (d = l) AS xl, sum(x / d * pow(0.9, d)) AS t FROM x GROUP BY 1)
SELECT query_id, round(0.1 / 0.9 * (t + coalesce((SELECT sum(xs * (d - s) / (s * d) * pow(0.9, d)) FROM range(1, 30) r(d) WHERE d > s AND d <= l), 0)) + ((xl - xs) / l + xs / s) * pow(0.9, l), 6) AS rbo FROM e""",
    "eval_ndcg_mrr_recall": f"{_FINAL}, {_metric('fin', 'mt')} SELECT * FROM mt",
    "eval_rerank_lift": f"""{_FINAL}, pool AS (SELECT query_id, page_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, c) AS rank FROM (SELECT query_id, page_id, max(fusion) AS f, arg_min(chunk_id, (-fusion, chunk_id)) AS c FROM chunks_ GROUP BY 1, 2)),
sums AS (SELECT query_id, page_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM (SELECT query_id, page_id, round(sum(fusion), 9) AS score FROM chunks_ GROUP BY 1, 2)), {_metric('sums', 'ms')}, {_metric('pool', 'mp')}
SELECT query_id, ms.ndcg AS final_ndcg, mp.ndcg AS pool_ndcg, round(ms.ndcg - mp.ndcg, 6) AS lift FROM ms JOIN mp USING (query_id)""",
    "eval_model_report": f"{_FINAL}, {_metric('fin', 'mt')} SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, count(*) AS n, round(avg(ndcg), 5) AS ndcg, round(avg(rr), 5) AS mrr, round(avg(recall), 5) AS recall FROM mt GROUP BY 1",
    "golden_set": r"""SELECT norm, arg_min(text, (conv_id, turn)) AS text, count(*) AS n, array_to_string(list_sort(list(DISTINCT conv_id)), ',') AS sources FROM (SELECT replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS norm, * FROM conversations WHERE role = 'user') WHERE norm <> '' GROUP BY 1""",
    "latest_feedback_wins": "SELECT event_type AS query_id, user_id AS page_id, arg_max(value > 20, (ts, event_id)) AS relevant FROM events GROUP BY 1, 2",
    "merges_replayed": """WITH RECURSIVE r AS (SELECT DISTINCT user_id::BIGINT AS u, user_id::BIGINT AS root FROM events UNION ALL SELECT u, root // 2 FROM r WHERE root > 30),
m AS (SELECT root AS entity_id, event_id % 50 AS page_id, event_type AS surface_form, CASE WHEN event_id % 4 <> 0 THEN event_id % 3 END AS char_start FROM events JOIN (SELECT u, min(root) AS root FROM r GROUP BY 1) ON u = user_id)
SELECT entity_id, count(*) AS mention_count, count(DISTINCT page_id) AS page_count FROM (SELECT DISTINCT * FROM m WHERE char_start IS NOT NULL UNION ALL SELECT * FROM m WHERE char_start IS NULL) GROUP BY 1""",
    "latency_quantiles": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events",
    "metric_gauge_downsample": "SELECT event_type, floor(epoch_us(ts) / 21600000000)::BIGINT AS bucket, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "metric_counter_delta": "SELECT event_type, bucket, round(greatest(0, last - coalesce(lag(last) OVER (PARTITION BY event_type ORDER BY bucket), first)), 6) AS delta FROM (SELECT event_type, floor(epoch_us(ts) / 21600000000)::BIGINT AS bucket, arg_max(value, (ts, event_id)) AS last, arg_min(value, (ts, event_id)) AS first FROM events GROUP BY 1, 2)",
    "job_counts_by_status": f"WITH {_JOBS} SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('failed'), ('dead'), ('cancelled')) s(status) LEFT JOIN (SELECT status, count(*) AS n FROM jobs_ GROUP BY 1) USING (status)",
    "latest_job_per_page": f"WITH {_JOBS} SELECT page_id, kind, job_id, status FROM jobs_ QUALIFY row_number() OVER (PARTITION BY page_id, kind ORDER BY created_at DESC, job_id DESC) = 1",
    "expired_leases": f"WITH {_JOBS} SELECT job_id, kind, page_id FROM jobs_ WHERE status = 'running' AND lease_until < TIMESTAMP '{NOW}'",
    "due_watches": "SELECT watch_id, next_run_at FROM (SELECT user_id AS watch_id, max(ts) + INTERVAL 7 DAY AS next_run_at, count(*) % 2 = 0 AS enabled FROM events GROUP BY 1) WHERE enabled AND next_run_at <= TIMESTAMP '2024-02-06' ORDER BY next_run_at, watch_id LIMIT 50",
    "missing_extraction_antijoin": f"WITH {_PAGES} SELECT page_id, sha256(body_text) AS hash FROM pages_ p WHERE status = 'indexed' AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id % 3 = 0 AND doc_id = page_id AND sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) = sha256(body_text))",
    "blacklist_match": f"WITH {_RULES}, {_URLS}, {_BLACK} SELECT * FROM hits_",
    "ingest_batch": rf"""WITH {_RULES}, urls_ AS (SELECT page_id, regexp_replace(url, '[?#].*$|/$', '') AS url, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS domain FROM pages),
b_ AS (SELECT *, EXISTS (SELECT 1 FROM rules_ WHERE kind = 'domain' AND (domain = pattern OR ends_with(domain, '.' || pattern))) AS black FROM urls_)
SELECT page_id, url, CASE WHEN black THEN 'blacklisted' WHEN url IN (SELECT url FROM urls_ WHERE page_id % 7 = 0) OR row_number() OVER (PARTITION BY url, black ORDER BY page_id) > 1 THEN 'revisit' ELSE 'queued' END AS outcome FROM b_""",
    "forget_domain": "SELECT doc_id AS page_id, count(*) AS n_chunks FROM (SELECT doc_id, substr(text, s + 1, 400) AS c FROM (SELECT doc_id, text, unnest(range(0, len(text), 400)) AS s FROM documents WHERE source <> 'src3' AND NOT ends_with(source, '.src3'))) WHERE regexp_matches(c, '\\S') GROUP BY 1",
    "tombstone_sweep": f"""WITH t AS (SELECT doc_id AS page_id, ['pending', 'deleted', 'verified'][doc_id % 3 + 1] AS status, TIMESTAMP '{NOW}' - to_hours(doc_id::BIGINT) AS updated_at FROM documents), c AS (SELECT DISTINCT vec_id // 4 AS page_id FROM embeddings)
SELECT page_id, CASE WHEN status = 'deleted' THEN CASE WHEN page_id IN (SELECT page_id FROM c) THEN 'pending' ELSE 'verified' END ELSE status END AS status,
CASE WHEN status = 'deleted' THEN 'checked' WHEN status = 'pending' AND date_diff('second', updated_at, TIMESTAMP '{NOW}') > 600 THEN 'purge' WHEN status = 'verified' AND date_diff('second', updated_at, TIMESTAMP '{NOW}') > 2592000 THEN 'drop' ELSE 'keep' END AS action FROM t""",
    "revisit_fold": "SELECT event_type || '/' || user_id AS url, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS visit_count FROM events GROUP BY 1",
    "entity_blocks_dups": f"WITH {_ALIASES} SELECT type, block_key, count(DISTINCT entity_id) AS n, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS entity_ids FROM a_ GROUP BY 1, 2 HAVING n > 1",
    "entity_pair_edit_distance": f"WITH {_PAIRS} SELECT * FROM pairs_",
    "entity_components": f"{_COMPONENTS} SELECT * FROM comp",
    "entity_merge_counts": f"""{_COMPONENTS}, {_MENTIONS}, c_ AS (SELECT entity_id, count(*) AS n FROM m_ GROUP BY 1), t_ AS (SELECT entity_id, first_value(entity_id) OVER (PARTITION BY component ORDER BY n DESC, entity_id) AS target FROM comp JOIN c_ USING (entity_id))
SELECT target AS entity_id, count(*) AS mention_count, count(DISTINCT page_id) AS page_count FROM (SELECT DISTINCT target, page_id, surface_form, char_start FROM m_ JOIN t_ USING (entity_id)) GROUP BY 1""",
    "canonical_form_mode": f"WITH {_ALIASES}, {_MENTIONS} SELECT entity_id, surface_form AS canonical_form FROM (SELECT entity_id, surface_form, count(*) AS n FROM m_ GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, surface_form) = 1",
    "entity_idf": f"WITH {_ALIASES}, {_MENTIONS} SELECT entity_id, round(ln((SELECT count(*) FROM orders) / count(DISTINCT page_id)), 6) AS idf FROM m_ GROUP BY 1",
    "entity_similarity": f"""WITH {_ALIASES}, {_MENTIONS}, w_ AS (SELECT entity_id, round(ln((SELECT count(*) FROM orders) / count(DISTINCT page_id)), 6) AS w FROM m_ GROUP BY 1), h_ AS (SELECT DISTINCT page_id, entity_id, w FROM m_ JOIN w_ USING (entity_id)),
s_ AS (SELECT q.page_id AS query_id, h.page_id, sum(h.w) AS shared FROM h_ q JOIN h_ h ON q.entity_id = h.entity_id AND q.page_id <> h.page_id WHERE q.page_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, page_id, round(coalesce(shared / nullif(total, 0), 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(shared / nullif(total, 0), 0), 6) DESC, page_id) AS rank FROM s_ JOIN (SELECT page_id, sum(w) AS total FROM h_ GROUP BY 1) USING (page_id) QUALIFY rank <= 10""",
}
ORACLES["outcome_tally"] = f"SELECT outcome, count(*) AS n FROM ({ORACLES['ingest_batch']}) GROUP BY 1"
ORACLES |= {
    "link_known_forms": f"""WITH {_ALIASES}, e AS (SELECT DISTINCT type, block_key, form FROM a_), k AS (SELECT type, block_key, form, p_partkey AS entity_id FROM a_ WHERE p_partkey % 10 = 1),
x AS (SELECT e.type, e.form, k.entity_id, CASE WHEN e.form = k.form THEN 0 ELSE 1 END AS arm FROM e JOIN k USING (type, block_key) WHERE levenshtein(e.form, k.form) / greatest(len(e.form), len(k.form)) <= 0.4)
SELECT type, form, entity_id FROM x QUALIFY row_number() OVER (PARTITION BY type, form ORDER BY arm, entity_id) = 1""",
    "undoable_merges": """WITH m AS (SELECT event_id AS merge_id, user_id AS source, (user_id * 7 + event_id) % 150 AS target, ts, event_id % 4 = 0 AS standing FROM events)
SELECT merge_id, standing AND NOT EXISTS (SELECT 1 FROM m l WHERE l.standing AND l.ts > m.ts AND (l.target = m.target OR l.source = m.target)) AS undoable FROM m""",
}
