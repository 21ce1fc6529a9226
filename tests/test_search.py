import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation as V
from quern.operators import search as S
from quern.sources import texts as T
from quern.sources.store import saved



@pytest.mark.parametrize("wrong", [{"k": 0}, {"k": 101}, {"offset": -1}, {"candidates": 5}, {"candidates": 1001}, {"chunks_per_page": 11}, {"rollup_m": 0}, {"rrf_k": 0}, {"suggest": 11}, {"half_life_days": 0}, {"rollup": "median"}, {"after": "2024-02-01", "before": "2024-01-01"}])
def test_options_are_checked(wrong):
    with pytest.raises(ValueError):
        S.SearchOptions(**wrong)
    assert S.SearchOptions(offset=5, candidates=15).k == 10


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.sql("""SELECT * FROM VALUES (1, 'boats.example', 'https://boats.example/a', timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-05', 'indexed'), (2, 'boats.example', 'https://boats.example/b', timestamp_ntz'2024-02-01', timestamp_ntz'2024-02-05', 'indexed'),
        (3, 'lamps.example', 'https://lamps.example/', timestamp_ntz'2024-02-20', timestamp_ntz'2024-02-20', 'queued') AS t(page_id, domain, canonical_url, first_seen_at, last_seen_at, status)""")
    chunks = spark.createDataFrame([(10, 1, 0, "a red boat"), (11, 1, 1, "the boat house"), (20, 2, 0, "boat boat boat"), (30, 3, 0, "a boat lamp")], "chunk_id long, page_id int, ordinal int, text string")
    vectors = spark.createDataFrame([(10, 1, [1.0, 0.0]), (20, 2, [0.0, 1.0]), (30, 3, [1.0, 1.0])], "chunk_id long, page_id int, vector array<double>")
    members = spark.createDataFrame([(7, 1, 0.5), (8, 1, 0.9), (8, 2, 0.4)], "cluster_id int, page_id int, probability double")
    clusters = spark.sql("SELECT 7 cluster_id, CAST(NULL AS timestamp_ntz) tombstoned_at UNION ALL SELECT 8, timestamp_ntz'2024-01-01'")
    mentions = spark.createDataFrame([(5, 2)], "entity_id int, page_id int")
    return S.Corpus(pages, chunks, vectors, members, clusters, mentions)


def found(spark, corpus, text, reranker=None, vector=None, **options):
    q = spark.createDataFrame([(1, text, vector)], "query_id long, text string, vector array<double>")
    return S.search(q, corpus, S.SearchOptions(**options), now=F.expr("timestamp_ntz'2024-03-01'"), save=saved(spark), reranker=reranker)


def ids(tables):
    return [r.page_id for r in tables["pages"].orderBy("rank").collect()]


def test_search_shows_indexed_pages_with_their_live_cluster(spark, corpus):
    t = found(spark, corpus, "boat", vector=[0.0, 1.0])
    rows = t["pages"].orderBy("rank").collect()
    assert [(r.page_id, r.cluster_id, r.has_more) for r in rows] == [(2, None, False), (1, 7, False)]
    assert [(r.page_id, r.chunk_id) for r in t["chunks"].orderBy("page_id", "chunk_rank").collect()] == [(1, 10), (1, 11), (2, 20)]
    log = t["log"].first()
    assert (log.n_fused, log.final_pages) == (4, "2:1,1:2") and log.pool.split(",")[0] == "2"


def test_filters_cut_before_the_ranking(spark, corpus):
    assert ids(found(spark, corpus, "boat", domain="boats.example", before="2024-01-15")) == [1]
    assert ids(found(spark, corpus, "boat", entity_id=5)) == [2]
    assert ids(found(spark, corpus, "boat", cluster_id=7)) == [1] and ids(found(spark, corpus, "boat", cluster_id=8)) == [] and ids(found(spark, corpus, "boat", cluster_id=99)) == []
    with pytest.raises(LookupError):
        found(spark, corpus, "boat", entity_id=6)


def test_pins_come_first_without_chunks(spark, corpus):
    t = found(spark, corpus, " https://WWW.boats.example/a/?utm_source=x ")
    assert [(r.page_id, r.exact_match, r.score) for r in t["pages"].orderBy("rank").collect()][:1] == [(1, True, 1.0)]
    assert 1 not in {r.page_id for r in t["chunks"].collect()}
    assert ids(found(spark, corpus, "www.Boats.example"))[:2] == [2, 1] and ids(found(spark, corpus, "lamps.example")) != [3]
    assert ids(found(spark, corpus, "boats.example", after="2024-01-15")) == [2]


def test_a_reranker_may_leave_chunks_out(spark, corpus):
    only = lambda pairs: pairs.where("chunk_id = 11").select("query_id", "chunk_id", F.lit(5.0).alias("rerank"))
    t = found(spark, corpus, "boat", reranker=only)
    assert ids(t)[0] == 1 and t["chunks"].where("page_id = 1 AND chunk_rank = 1").first().chunk_id == 11


def test_decay_and_slices(spark, corpus):
    assert ids(found(spark, corpus, "red boat house", half_life_days=1.0))[0] == 2
    rows = found(spark, corpus, "boat", k=1, offset=1, candidates=50)["pages"].collect()
    assert len(rows) == 1 and rows[0].rank == 2 and not rows[0].has_more


def test_agreement_of_empty_lists(spark):
    ranks = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 6, 2), ("b", 1, 5, 1), ("b", 1, 6, 2), ("a", 2, 5, 1)], "model string, query_id int, item int, rank int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: (r.jaccard, round(r.rbo, 9), r.tau, r.common) for r in S.agreement(ranks, q, ["a", "b"]).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 2), 2: (0.0, 0.0, None, 0), 3: (1.0, 1.0, None, 0)}
    with pytest.raises(ValueError):
        S.compare(q, {"a": (q, q)}, q, q, save=saved(spark))


def test_scores_of_logged_runs(spark):
    rows = [(1, "search", '{"recency_half_life_days":null}', "m", "r", [7, 8], [1, 2], [8, 7]), (2, "search", "{}", "m", "r", [7], [3], [7]), (3, "search", "{}", "m", None, [7], [1], [7]), (4, "compare_arm", "{}", "n", "r", [9], [1], [])]
    runs = spark.createDataFrame(rows, "query_id int, kind string, params string, active_model string, reranker_model string, final_page_ids array<int>, final_page_ranks array<int>, pool array<int>")
    labels = spark.createDataFrame([(1, 7, True), (1, 8, False), (2, 7, True), (3, 7, False), (4, 9, True)], "query_id int, page_id int, relevant boolean")
    s = {r.query_id: r for r in V.scored_runs(runs, labels).collect()}
    assert (s[1].ndcg, s[1].rr, s[1].recall, s[1].pool_recall) == (1.0, 1.0, 1.0, 1.0) and s[1].lift == pytest.approx(1 - 0.63092975)
    assert s[2].ndcg == pytest.approx(0.5) and s[2].lift is None and s[2].rr == pytest.approx(1 / 3)
    assert s[3].labeled and not s[3].scored and s[3].ndcg is None and s[4].lift == pytest.approx(1.0)
    report = {r.model: r for r in V.model_reports(V.scored_runs(runs, labels)).collect()}
    assert (report["m"].logged, report["m"].labeled, report["m"].skipped, report["m"].queries) == (3, 3, 1, 2)


def test_relative_links(spark):
    base = "https://a.example/x/y?k=1#z"
    cases = {"b": "https://a.example/x/b", "../b/./c/..": "https://a.example/b/", "../../../b": "https://a.example/b", "/q?r": "https://a.example/q?r", "?s": "https://a.example/x/y?s", "#t": "https://a.example/x/y?k=1#t", "//h.example": "https://h.example", "": base, "mailto:x": "mailto:x"}
    df = spark.createDataFrame([(base, r) for r in cases], "base string, ref string")
    assert {r.ref: r.u for r in df.select("ref", T.joined_url(F.col("base"), F.col("ref")).alias("u")).collect()} == cases


def test_pdf_passes(spark):
    pages = ["Annual notes\nfirst line of a long ex-\nample here   with   blanks  \na\nb\nc\n1", "Annual notes\n\n\n\n\nnext Page\n12 apples\nd\ne\nf\nPage 2 of 9"]
    got = spark.createDataFrame([(pages,)], "p array<string>").select(T.pdf_text(F.col("p")).alias("t")).first().t
    assert got == "first line of a long example here with blanks\na\nb\nc\n\nnext Page\n12 apples\nd\ne\nf"


def test_gazetteer_terms_are_no_patterns(spark):
    docs = spark.createDataFrame([(1, "C++ and c.d, cxd. Ärger ärger ärgert"), (2, None)], "page_id int, text string")
    terms = spark.createDataFrame([("x", "c.d"), ("y", "ärger"), ("y", "ärger")], "label string, pattern string")
    got = sorted((r.label, r.surface, r.char_start, r.char_end) for r in T.gazetteer_places(docs, terms).collect())
    assert got == [("x", "c.d", 8, 11), ("y", "Ärger", 18, 23), ("y", "ärger", 24, 29)]
    with pytest.raises(ValueError):
        T.gazetteer_places(docs, terms, most_terms=1)


def test_lines_of_pdf_pages():
    from quern.sources.texts import is_page_number, tidy_pages

    assert all(map(is_page_number, ["7", "Page 7", "page  12", "3/10", "3 of 10", "PAGE 3 OF 10", "3of10", "page 1 / 2"]))
    assert not any(map(is_page_number, ["", "page", "page x", "7.", "1/2/3", "of 3", "12 pages", "pages 3"]))
    pages = ["Head\n1\nA word-\nbroken and Word-\nKept.  Two\tone \t blanks \n \n\n\nend", None, "Head\nﬁne ½ text\n2", "Head\nmore\n3"]
    assert tidy_pages(pages, 3, 0.5, True) == "A wordbroken and Word-\nKept. Two\tone blanks\n\nend\n\nfine 1⁄2 text\nmore"
    assert "ﬁne ½" in tidy_pages(pages, 3, 0.5, False)
    assert tidy_pages([], 3, 0.5, True) == ""
    # a number away from the edges stays
    assert tidy_pages(["a\nb\n5\nc\nd"], 1, 0.5, True) == "a\nb\n5\nc\nd"
