"""Search over tables of queries: options with checked ranges, filters, both arms, reranking, rollup, pins, slices, hydration and the log; comparison of models.

All queries are answered at once; what a single request would get is its query's rows. Jobs run while the plan is made: sizes
are asked for, and steps that several tables need are written.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import url as U
from quern.operators import metrics as K
from quern.operators import retrieval as R
from quern.operators import sparse as X

#: Scores chunks of (query_id, text, chunk_id, chunk_text) as (query_id, chunk_id, rerank); chunks that it leaves out keep their fusion score.
Reranker = Callable[[DataFrame], DataFrame]


def overlap_reranker(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "chunk_id", R.token_overlap(F.col("text"), F.col("chunk_text")).alias("rerank"))


@dataclass(frozen=True)
class SearchOptions:
    """What a request may set; values out of range raise an error."""

    k: int = 10
    offset: int = 0
    candidates: int = 100
    chunks_per_page: int = 2
    rollup: str = "max"
    rollup_m: int = 3
    rrf_k: int = 60
    suggest: int = 3
    half_life_days: float | None = None
    domain: str | None = None
    after: str | None = None
    before: str | None = None
    cluster_id: int | None = None
    entity_id: int | None = None

    def __post_init__(self):
        ranges = {"k": (1, 100), "offset": (0, None), "candidates": (1, 1000), "chunks_per_page": (0, 10), "rollup_m": (1, 20), "rrf_k": (1, None), "suggest": (0, 10)}
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or high is not None and value > high:
                raise ValueError(f"{name} must be {low} or more" + (f" and {high} at most" if high else ""))
        if self.candidates < self.offset + self.k:
            raise ValueError("candidates must cover offset + k")
        if self.rollup not in ("max", "mean_top_m", "sum_rrf"):
            raise ValueError(f"no rollup named {self.rollup}")
        if self.half_life_days is not None and self.half_life_days <= 0:
            raise ValueError("half_life_days must be above 0")
        if self.after is not None and self.before is not None and self.after >= self.before:
            raise ValueError("after must be earlier than before")


@dataclass(frozen=True)
class Corpus:
    """pages (page_id, domain, canonical_url, first_seen_at, last_seen_at, status), chunks (chunk_id, page_id, ordinal, text), vectors (chunk_id, page_id, vector), members and clusters, mentions (entity_id, page_id), the chunks' stored sparse index.

    Without an index each search reads the chunks' texts.
    """

    pages: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    members: DataFrame | None = None
    clusters: DataFrame | None = None
    mentions: DataFrame | None = None
    sparse: X.SparseIndex | None = None


MOST_ENTITY_PAGES = 10_000


def allowed_pages(corpus: Corpus, o: SearchOptions) -> DataFrame | None:
    """The pages that the filters leave, whatever their status; None without a filter.

    An entity that no page mentions is an error, and so is one on too many pages; an unknown or tombstoned cluster leaves
    nothing.
    """
    out = None
    if o.domain is not None or o.after is not None or o.before is not None:
        p = corpus.pages.withColumn("status", F.lit("indexed"))
        out = R.page_filter(p, domain=o.domain, after=o.after, before=o.before).select("page_id")
    if o.entity_id is not None:
        own = corpus.mentions.where(F.col("entity_id") == o.entity_id).select("page_id").distinct()
        n = own.limit(MOST_ENTITY_PAGES + 1).count()
        if not n:
            raise LookupError(f"no entity {o.entity_id}")
        if n > MOST_ENTITY_PAGES:
            raise ValueError(f"entity {o.entity_id} is on more than {MOST_ENTITY_PAGES} pages")
        out = own if out is None else out.join(own, "page_id", "left_semi")
    if o.cluster_id is not None:
        live = corpus.clusters.where((F.col("cluster_id") == o.cluster_id) & F.col("tombstoned_at").isNull()).select("cluster_id")
        own = corpus.members.join(live, "cluster_id", "left_semi").select("page_id").distinct()
        out = own if out is None else out.join(own, "page_id", "left_semi")
    return out


def exact_pins(queries: DataFrame, pages: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, pin) of queries that are a URL (its page) or a bare domain (its five pages last seen), among indexed pages that the filters leave."""
    shown = pages.where("status = 'indexed'")
    text = F.trim("text")
    q = queries.select("query_id", F.when(text.rlike("^https?://"), U.canonical(text)).alias("url"), F.when(~text.rlike("^https?://") & U.is_bare_domain(text), F.regexp_replace(F.lower(text), r"^www\.", "")).alias("domain"))
    by_url = q.where("url IS NOT NULL").join(shown.select("page_id", F.col("canonical_url").alias("url")), "url").select("query_id", "page_id", F.lit(1).cast("long").alias("pin"))
    last = R.ranked(q.where("domain IS NOT NULL").join(shown.select("page_id", "domain", "last_seen_at"), "domain"), ["query_id"], "last_seen_at", "page_id", 5)
    pins = by_url.unionByName(last.select("query_id", "page_id", F.col("rank").alias("pin")))
    return pins if allowed is None else pins.join(allowed, "page_id", "left_semi")


def arms(queries: DataFrame, corpus: Corpus, o: SearchOptions, save, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse ranking of queries (query_id, text, vector), among the allowed pages' chunks."""
    some = lambda df: df if allowed is None else df.join(allowed, "page_id", "left_semi")
    dense = R.dense_topk(queries.where("vector IS NOT NULL").select("query_id", "vector"), some(corpus.vectors), o.candidates)
    among = None if allowed is None else some(corpus.chunks).select("chunk_id")
    return dense, sparse_arm(queries, corpus.chunks, corpus.sparse, o.candidates, save, among)


def sparse_arm(queries: DataFrame, chunks: DataFrame, index: X.SparseIndex | None, limit: int, save, among: DataFrame | None = None) -> DataFrame:
    asked = queries.select("query_id", "text")
    return R.bm25_topk(asked, chunks, limit, save=save, among=among) if index is None else X.bm25(index, asked, limit, save=save, among=among)


def reranked(fused: DataFrame, queries: DataFrame, chunks: DataFrame, reranker: Reranker | None) -> DataFrame:
    """Fused chunks (query_id, chunk_id, page_id, fusion) with rerank, null where there is no reranker or it gives none."""
    if reranker is None:
        return fused.withColumn("rerank", F.lit(None).cast("double"))
    pairs = fused.select("query_id", "chunk_id").join(queries.select("query_id", "text"), "query_id").join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    return fused.join(reranker(pairs), ["query_id", "chunk_id"], "left")


def search(queries: DataFrame, corpus: Corpus, o: SearchOptions, *, now: Column, save, reranker: Reranker | None = None) -> dict[str, DataFrame]:
    """Answers queries (query_id, text, vector) as tables:

    pages: query_id, rank, page_id, score, exact_match, domain, cluster_id, has_more, ranks counted over the whole result;
    chunks: query_id, page_id, chunk_rank, chunk_id, score, the best chunks_per_page of each page that is no pin;
    log: query_id, n_fused, final_pages (page:rank, ...) and pool, the pages in the order of the fused list.
    `save` writes a table and reads it back; the fused chunks are written once for the three.
    """
    allowed = allowed_pages(corpus, o)
    of_chunk = corpus.chunks.select("chunk_id", "page_id").unionByName(corpus.vectors.select("chunk_id", "page_id")).distinct()
    fused = R.rrf_fuse(list(arms(queries, corpus, o, save, allowed)), o.rrf_k, o.candidates)
    kept = save(reranked(fused.join(of_chunk, "chunk_id").select("query_id", "chunk_id", "page_id", F.col("score").alias("fusion"), F.col("rank").alias("fused_rank")), queries, corpus.chunks, reranker))
    shown = corpus.pages.where("status = 'indexed'").select("page_id", "domain", "first_seen_at")
    pages = R.rollup(kept, o.rollup, o.rollup_m).join(shown.select("page_id"), "page_id", "left_semi")
    pages = R.recency_decay(pages, shown, now, o.half_life_days) if o.half_life_days else R.ranked(pages.drop("rank"), ["query_id"], "score", "page_id")
    every = R.pinned(pages, exact_pins(queries, corpus.pages, allowed))
    final = save(R.page_slice(every, o.offset, o.k).join(shown.select("page_id", "domain"), "page_id"))
    if corpus.members is not None and corpus.clusters is not None:
        final = final.join(R.latest_cluster(corpus.members, corpus.clusters).select("page_id", "cluster_id"), "page_id", "left")
    else:
        final = final.withColumn("cluster_id", F.lit(None).cast("int"))
    best = kept.withColumn("score", F.coalesce("rerank", "fusion")).join(final.where("NOT exact_match").select("query_id", "page_id"), ["query_id", "page_id"], "left_semi")
    chunk_rank = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "chunk_id")).cast("long")
    top = best.select("query_id", "page_id", "chunk_id", "score", chunk_rank.alias("chunk_rank")).where(F.col("chunk_rank") <= o.chunks_per_page)
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), x), ",")
    final_pages = final.groupBy("query_id").agg(joined(lambda r: F.concat_ws(":", r["page_id"], r["rank"])).alias("final_pages"))
    pool = kept.groupBy("query_id", "page_id").agg(F.min("fused_rank").alias("rank")).groupBy("query_id").agg(joined(lambda r: r["page_id"].cast("string")).alias("pool"))
    log = queries.select("query_id").join(kept.groupBy("query_id").agg(F.count("*").alias("n_fused")), "query_id", "left").join(final_pages, "query_id", "left").join(pool, "query_id", "left")
    return {
        "pages": final.select("query_id", "rank", "page_id", "score", "exact_match", "domain", "cluster_id", "has_more"),
        "chunks": top.select("query_id", "page_id", "chunk_rank", "chunk_id", "score"),
        "log": log.select("query_id", F.coalesce("n_fused", F.lit(0)).alias("n_fused"), F.coalesce("final_pages", F.lit("")).alias("final_pages"), F.coalesce("pool", F.lit("")).alias("pool")),
    }


def compare(queries: DataFrame, models: dict[str, tuple[DataFrame, DataFrame]], chunks: DataFrame, pages: DataFrame, *, save, k: int = 10, candidates: int = 100, reranker: Reranker | None = None, index: X.SparseIndex | None = None) -> DataFrame:
    """(model, pos, query_id, item, rank): each model's first k pages for the same queries (query_id, text), pages that are not indexed dropped after the cut.

    models: from a name to the queries' vectors (query_id, vector) and the chunks' (chunk_id, page_id, vector), two to
    five of them. The sparse arm is made once for all.
    """
    if not 2 <= len(models) <= 5:
        raise ValueError("two to five models are compared")
    sparse = save(sparse_arm(queries, chunks, index, candidates, save))
    shown = pages.where("status = 'indexed'").select("page_id")
    out = None
    for pos, (name, (asked, vectors)) in enumerate(models.items()):
        of_chunk = chunks.select("chunk_id", "page_id").unionByName(vectors.select("chunk_id", "page_id")).distinct()
        fused = R.rrf_fuse([R.dense_topk(asked, vectors, candidates), sparse], R.RRF_K, candidates)
        scored = reranked(fused.join(of_chunk, "chunk_id").select("query_id", "chunk_id", "page_id", F.col("score").alias("fusion")), queries, chunks, reranker)
        cut = R.rollup(scored).where(F.col("rank") <= k).join(shown, "page_id", "left_semi")
        again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
        own = cut.select(F.lit(name).alias("model"), F.lit(pos).alias("pos"), "query_id", F.col("page_id").alias("item"), again.alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out


def agreement(ranks: DataFrame, queries: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(query_id, a, b, jaccard, rbo, tau, common) for each pair of models, in the models' order, and each query.

    Two empty lists agree (1.0 for jaccard and rbo); tau is null below two common items.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    every = queries.select("query_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))).alias("p")).select("query_id", "p.a", "p.b")
    key = F.struct("query_id", "a", "b").alias("query_id")
    side = lambda c: every.join(ranks.select("query_id", F.col("model").alias(c), "item", "rank"), ["query_id", c]).select(key, "item", "rank")
    left, right = side("a"), side("b")
    lists = lambda df, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(name))
    r = every.select(key).join(lists(left, "x"), "query_id", "left").join(lists(right, "y"), "query_id", "left").join(K.rank_biased_overlap(left, right), "query_id", "left").join(K.kendall_tau(left, right), "query_id", "left")
    none = F.array().cast(dict(lists(left, "x").dtypes)["x"])
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    rbo = F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce("rbo", F.lit(0.0)))
    return r.select("query_id.*", K.jaccard_at_k(x, y, k).alias("jaccard"), rbo.alias("rbo"), "tau", F.size(F.array_intersect(x, y)).cast("long").alias("common"))
