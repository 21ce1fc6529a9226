"""Retrieval operators over tables of queries: dense and sparse arms, fusion, rollups, decay, pins, filters, slices.

Order is never implied: every ranked table has a rank column from 1, and all ties break on the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import word_tokens

RRF_K, K1, B = 60, 1.2, 0.75


def ranked(df: DataFrame, by: list[str], score: str, tie: str, limit: int | None = None) -> DataFrame:
    """df with rank, best score first within `by`."""
    r = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))).cast("long"))
    return r.where(F.col("rank") <= limit) if limit else r


def _block_task(id_type: pa.DataType, rows: int):
    """Vectors to blocks of at most `rows`, as ids and one matrix of doubles scaled to unit length."""

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                vectors = part.column(1).to_pylist()
                some = [i for i, v in enumerate(vectors) if v]
                if not some:
                    continue
                m = np.array([vectors[i] for i in some], float)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                ids = [part.column(0)[i].as_py() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), pa.array([(m / np.where(n == 0, 1, n)).tobytes()], pa.binary())], names=["ids", "matrix"])

    return task


def best_rows(scores: np.ndarray, ids: np.ndarray, exact, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best `limit` by (score, least id); exact(places) scores a few again, equal rows equally.

    A matrix product may give equal rows scores that differ in their last digits, so those near the last place are all scored again.
    """
    some = np.arange(len(scores))
    if len(scores) > limit:
        last = np.partition(scores, len(scores) - limit)[len(scores) - limit]
        some = np.flatnonzero(scores >= last - 1e-9 * max(1.0, abs(last)))
    again = exact(some)
    order = np.lexsort((ids[some], -again))[:limit]
    return some[order], again[order]


def _match_task(limit: int):
    def task(batches):
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["q_matrix"]).reshape(len(r["q_ids"]), -1)
                c = np.frombuffer(r["matrix"]).reshape(len(r["ids"]), -1)
                scores, ids = q @ c.T, np.array(r["ids"])
                out = ([], [], [])
                for k, qid in enumerate(r["q_ids"]):
                    at, found = best_rows(scores[k], ids, lambda some, v=q[k]: (c[some] * v).sum(axis=1), limit)
                    out[0].extend([qid] * len(at))
                    out[1].extend(ids[at].tolist())
                    out[2].extend(found.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    return task


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of vectors of one length as rows of unit length."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(np.unique(sizes)) > 1:
        raise ValueError("vectors of different lengths")
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _grid_task(limit: int, block: int):
    """Rows in order of cell and kind (0 queries, 1 vectors) to the best `limit` of each cell's queries.

    A cell's queries are held; its vectors pass in batches, against which `block` queries at a time are multiplied.
    """

    def merged(q: np.ndarray, kept: tuple, c: np.ndarray, ids: np.ndarray) -> tuple:
        own, best, to = kept
        scores = q @ c.T
        # the last place of those who have one, else that of this batch
        full = np.bincount(own, minlength=len(q)) >= limit
        least = np.full(len(q), -np.inf)
        np.minimum.at(place := np.full(len(q), np.inf), own, best)
        least[full] = place[full]
        if len(ids) > limit and not full.all():
            least[~full] = np.partition(scores[~full], len(ids) - limit, axis=1)[:, len(ids) - limit]
        # products of equal rows differ in their last digits, so all near the last place are scored again, row by row
        rows, cols = np.nonzero(scores >= (least - 1e-9 * np.maximum(1.0, np.where(np.isinf(least), 1.0, np.abs(least))))[:, None])
        again = np.concatenate([(c[cols[i : i + 65536]] * q[rows[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        own, best, to = np.append(own, rows), np.append(best, again), np.append(to, ids[cols])
        order = np.lexsort((to, -best, own))
        own, best, to = own[order], best[order], to[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
        some = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < limit
        return own[some], best[some], to[some]

    def task(batches):
        cell, asked, parts, kept = None, [], [], []

        def ready():
            if asked:
                ids, m = np.concatenate([a for a, _ in asked]), np.concatenate([b for _, b in asked])
                for i in range(0, len(ids), block):
                    parts.append((ids[i : i + block], m[i : i + block]))
                    kept.append((np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)))
                asked.clear()

        def closed():
            for (ids, _), (own, best, to) in zip(parts, kept, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(to, pa.int64()), pa.array(best, pa.float64())], names=["query_id", "chunk_id", "score"])

        for b in batches:
            cells, kinds = b.column("cell").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if begin == end:
                    continue
                if cells[begin] != cell:
                    yield from closed()
                    cell = cells[begin]
                    for held in (asked, parts, kept):
                        held.clear()
                part = b.slice(begin, end - begin)
                m, ids = _rows(part, "vector"), part.column("id").to_numpy()
                some = np.isfinite(m).all(axis=1)
                m, ids = m[some], ids[some]
                if kinds[begin] == 0:
                    asked.append((ids, m))
                    continue
                ready()
                for at in range(0, len(ids), 4096):
                    for k, (_, q) in enumerate(parts):
                        kept[k] = merged(q, kept[k], m[at : at + 4096], ids[at : at + 4096])
        yield from closed()

    return task


def _by_grid(queries: DataFrame, vectors: DataFrame, limit: int, most: int, block: int) -> DataFrame:
    """(query_id, chunk_id, score): the best of each query in each of the corpus's parts.

    Both sides are dealt into parts of some `most` rows by their ids, and each part of queries meets each part of vectors in
    one task, which holds the queries and no more of the vectors than a batch. Components that are no numbers have no score.
    """
    there = lambda df, key: df.select(F.col(key).cast("long").alias("id"), "vector").where("id IS NOT NULL AND size(vector) > 0")
    asked, given = there(queries, "query_id"), there(vectors, "chunk_id")
    a, b = (max(1, -(-df.count() // most)) for df in (asked, given))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", part(a).alias("x")).select("id", "vector", "x", every(b).alias("y")).withColumn("kind", F.lit(0))
    right = given.select("*", part(b).alias("y")).select("id", "vector", every(a).alias("x"), "y").withColumn("kind", F.lit(1))
    both = left.unionByName(right).select((F.col("x") * b + F.col("y")).cast("int").alias("cell"), "kind", "id", "vector")
    dealt = both.repartitionById(a * b, F.col("cell")).sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_grid_task(limit, block), "query_id long, chunk_id long, score double")


def dense_topk(queries: DataFrame, vectors: DataFrame, limit: int, *, block: int = 2048, most_bytes: int = 2 << 20, most: int = 16_384) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank: exact nearest vectors of each query.

    Both sides become blocks of vectors; each block of queries meets each block of the corpus in one matrix product, of
    which the best `limit` a query go on. What is shuffled is limit rows a query and block, however many vectors there are.
    Queries of most_bytes or less, by their count, go to every task, where a batch has a row for each two blocks; more meet
    the corpus in parts of some `most` rows, dealt by a shuffle.
    """
    blocks = lambda df, id_col: df.select(F.col(id_col).cast("long"), "vector").mapInArrow(_block_task(pa.int64(), block), "ids array<long>, matrix binary")
    size = queries.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()[0]
    if size > most_bytes:
        return ranked(_by_grid(queries, vectors, limit, most, min(block, 1024)), ["query_id"], "score", "chunk_id", limit)
    asked = blocks(queries, "query_id").select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    pairs = blocks(vectors, "chunk_id").crossJoin(F.broadcast(asked))
    found = pairs.mapInArrow(_match_task(limit), "query_id long, chunk_id long, score double")
    return ranked(found, ["query_id"], "score", "chunk_id", limit)


def _count_task(number: dict[str, int]):
    """(chunk_id, dl, terms, tfs): a text's length and its counts of the numbered words."""

    def task(batches):
        for b in batches:
            lengths, terms, tfs = [], [], []
            for tokens in b.column(1).to_pylist():
                own: dict[int, int] = {}
                for w in tokens or ():
                    t = number.get(w)
                    if t is not None:
                        own[t] = own.get(t, 0) + 1
                lengths.append(len(tokens or ()))
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["chunk_id", "dl", "terms", "tfs"])

    return task


def _bm25_task(queries: list[tuple[int, list[int]]], idf: np.ndarray, avg_dl: float, limit: int, k1: float, b: float, cells: int):
    """The best `limit` texts of each batch for each query (id, its numbered words in order)."""
    blocks = [queries[i : i + 256] for i in range(0, len(queries), 256)]

    def task(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            dl = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.array([len(t) for t in batch.column(2).to_pylist()], np.int64)
            terms, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            own = np.repeat(np.arange(len(ids)), sizes)
            weights = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[own] / avg_dl))
            out = ([], [], [])
            for block in blocks:
                used = np.unique(np.concatenate([np.array(t, np.int64) for _, t in block]))
                column = np.full(len(idf), -1)
                column[used] = np.arange(len(used))
                asked = np.zeros((len(used), len(block)))
                for j, (_, t) in enumerate(block):
                    asked[column[t], j] = 1
                rows = max(1, cells // max(1, len(used)))
                for first in range(0, len(ids), rows):
                    mine = (own >= first) & (own < first + rows) & (column[terms] >= 0)
                    w = np.zeros((min(rows, len(ids) - first), len(used)))
                    w[own[mine] - first, column[terms[mine]]] = weights[mine]
                    scores, here = w @ asked, np.array(ids[first : first + rows])
                    for j, (qid, t) in enumerate(block):
                        some = np.flatnonzero(scores[:, j] > 0)
                        at, found = best_rows(scores[some, j], here[some], lambda k, some=some, t=t: w[some[k]][:, column[t]].sum(axis=1), limit)
                        out[0].extend([qid] * len(at))
                        out[1].extend(here[some[at]].tolist())
                        out[2].extend(found.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    return task


def bm25_topk(queries: DataFrame, docs: DataFrame, limit: int, *, save, among: DataFrame | None = None, k1: float = K1, b: float = B, most_terms: int = 500_000, cells: int = 8_000_000) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25: queries (query_id, text), docs (chunk_id, text); ids are whole numbers.

    Lengths and counts are taken over all documents; null counts as empty. Queries of most_terms words in all go to every task: a text is then
    read once for its counts of their words (a table that `save` writes), and scored for all of them where it is, so that
    the best `limit` a query and batch are all that is shuffled. More queries meet the texts in a join on the word.
    among: the (chunk_id) that may be found; lengths and counts are over all texts even so.
    """
    terms = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    tokens = docs.select(F.col("chunk_id").cast("long").alias("chunk_id"), word_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    if terms.count() > most_terms:
        return _bm25_by_join(terms, tokens, limit, k1, b, among)
    by_query: dict[int, list[str]] = {}
    for r in terms.collect():
        by_query.setdefault(r["query_id"], []).append(r["term"])
    number = {w: i for i, w in enumerate(sorted({w for t in by_query.values() for w in t}))}
    counts = save(tokens.mapInArrow(_count_task(number), "chunk_id long, dl long, terms array<int>, tfs array<long>"))
    n, avg_dl = counts.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    idf = np.zeros(len(number))
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        idf[r["term"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    asked = [(q, sorted(number[w] for w in t)) for q, t in sorted(by_query.items())]
    some = counts if among is None else counts.join(among, "chunk_id", "left_semi")
    found = some.where(F.size("terms") > 0).mapInArrow(_bm25_task(asked, idf, avg_dl, limit, k1, b, cells), "query_id long, chunk_id long, score double")
    return ranked(found, ["query_id"], "score", "chunk_id", limit)


def _bm25_by_join(terms: DataFrame, tokens: DataFrame, limit: int, k1: float, b: float, among: DataFrame | None) -> DataFrame:
    """The same for any number of queries."""
    tokens = tokens.withColumn("dl", F.size("tokens"))
    totals = tokens.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    wanted = terms.select("term").distinct()
    tf = tokens.select("chunk_id", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(totals).select("term", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = tf.join(idf, "term").select("chunk_id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))).alias("w"))
    weighed = weighed if among is None else weighed.join(among, "chunk_id", "left_semi")
    # summed in the words' order, so that equal texts have equal scores
    parts = terms.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("x"))
    return ranked(parts.select("query_id", "chunk_id", F.aggregate("x", F.lit(0.0), lambda s, x: s + x["w"]).alias("score")), ["query_id"], "score", "chunk_id", limit)


def phrase_match(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the documents that hold the phrase's words side by side.

    The phrase's longest word finds the documents to look at; those alone are searched for the whole phrase.
    """
    q = queries.select("query_id", word_tokens(F.col("phrase")).alias("words")).where(F.size("words") > 0)
    longest = F.sort_array(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False)[0]["w"]
    q = q.select("query_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("phrase"), longest.alias("term"))
    # the queries' words are one row, so a document is read once and its body only travels where a word is found
    terms = q.agg(F.collect_set("term").alias("terms"))
    d = docs.select("chunk_id", word_tokens(F.col("text")).alias("tokens")).crossJoin(terms)
    holders = d.select("chunk_id", "tokens", F.array_intersect("tokens", "terms").alias("found")).where(F.size("found") > 0)
    body = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    hits = holders.select("chunk_id", body.alias("body"), F.explode("found").alias("term")).join(q, "term")
    return hits.where(F.contains("body", F.col("phrase"))).select("query_id", "chunk_id").distinct()


def rrf_fuse(arms: list[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: reciprocal ranks of all arms (query_id, chunk_id, rank) summed."""
    both = arms[0].select("query_id", "chunk_id", "rank")
    for arm in arms[1:]:
        both = both.unionByName(arm.select("query_id", "chunk_id", "rank"))
    scored = both.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
    return ranked(scored, ["query_id"], "score", "chunk_id", limit)


def token_overlap(query: Column, text: Column) -> Column:
    """Reranker used where no model is plugged in: share of the query's words that the text has."""
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


def rollup(chunks: DataFrame, how: str = "max", m: int = 3) -> DataFrame:
    """Chunks (query_id, chunk_id, page_id, fusion, rerank?) to pages: query_id, page_id, score, rank.

    max: best effective score; mean_top_m: mean of the best m; sum_rrf: sum of fusion scores, whatever the reranker says.
    """
    effective = F.coalesce("rerank", "fusion") if "rerank" in chunks.columns else F.col("fusion")
    c = chunks.withColumn("effective", effective)
    keys = ["query_id", "page_id"]
    # a page's candidates are few; sums run from the greatest, so that equal pages have equal scores
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if how == "max":
        pages = c.groupBy(*keys).agg(F.max("effective").alias("score"))
    elif how == "mean_top_m":
        best = c.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("effective"), asc=False), 1, m).alias("x"))
        pages = best.select(*keys, (total(F.col("x")) / F.size("x")).alias("score"))
    elif how == "sum_rrf":
        pages = c.groupBy(*keys).agg(F.sort_array(F.collect_list("fusion"), asc=False).alias("x")).select(*keys, total(F.col("x")).alias("score"))
    else:
        raise ValueError(f"no rollup named {how}")
    return ranked(pages, ["query_id"], "score", "page_id")


def recency_decay(scores: DataFrame, seen: DataFrame, now: Column, half_life_days: float) -> DataFrame:
    """Scores halved for each half life of a page's age and ranked anew; pages without a date keep theirs."""
    days = F.greatest(F.timestamp_diff("SECOND", F.col("first_seen_at"), now), F.lit(0)) / 86400.0
    aged = scores.drop("rank").join(seen.select("page_id", "first_seen_at"), "page_id", "left")
    decayed = F.when(F.col("first_seen_at").isNull(), F.col("score")).otherwise(F.col("score") * F.pow(F.lit(0.5), days / half_life_days))
    return ranked(aged.withColumn("score", decayed).drop("first_seen_at"), ["query_id"], "score", "page_id")


def pinned(scores: DataFrame, pins: DataFrame) -> DataFrame:
    """Exact matches (query_id, page_id, pin) before all others with score 1.0; none is listed twice."""
    rest = scores.join(pins, ["query_id", "page_id"], "left_anti").select("query_id", "page_id", "score", F.lit(False).alias("exact_match"), (F.col("rank") + 1_000_000).alias("pos"))
    first = pins.select("query_id", "page_id", F.lit(1.0).alias("score"), F.lit(True).alias("exact_match"), F.col("pin").cast("long").alias("pos"))
    both = first.unionByName(rest)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "page_id")).cast("long")).drop("pos")


def page_slice(scores: DataFrame, offset: int, k: int) -> DataFrame:
    """Ranks offset+1 to offset+k of each query, with has_more."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return scores.withColumn("has_more", n > offset + k).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def page_filter(pages: DataFrame, *, domain: str | None = None, after: str | None = None, before: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Indexed pages of a domain, seen from `after` on and before `before`, and of the given ids; an empty set of ids leaves none."""
    out = pages.where("status = 'indexed'")
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if after is not None:
        out = out.where(F.col("first_seen_at") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        out = out.where(F.col("first_seen_at") < F.lit(before).cast("timestamp_ntz"))
    return out if ids is None else out.join(ids, "page_id", "left_semi")


def latest_cluster(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each page's live cluster of the highest probability."""
    live = members.join(clusters.where("tombstoned_at IS NULL").select("cluster_id"), "cluster_id", "left_semi")
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("probability"), F.asc("cluster_id")))
    return live.withColumn("_r", best).where("_r = 1").drop("_r")
