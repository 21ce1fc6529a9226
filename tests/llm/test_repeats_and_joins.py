import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import jaccard as J
from quern.llm import suffixes as S
from quern.llm.components import components
from quern.llm.queries import QUERIES


def repeats(docs):
    """The contract, one 100-byte string after the other."""
    seen, out = set(), {}
    for d in sorted(docs):
        t = docs[d].encode()
        gone = bytearray(len(t))
        for p in range(len(t) - S.LENGTH + 1):
            s = t[p : p + S.LENGTH]
            if s in seen:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(s)
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out[d] = (len(t), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest())
    return out


def digest(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(["th", "er", "on", "ab"]) for _ in range(n))
    pool = [text(80) for _ in range(5)]
    docs = {3 * i: "".join(rnd.choice([text(rnd.randint(1, 60)), rnd.choice(pool)[rnd.randint(0, 30) :], "é" * rnd.randint(1, 130), "\n" * rnd.randint(0, 150)]) for _ in range(rnd.randint(0, 6))) for i in range(50)}
    docs |= {7: docs[6], 8: docs[6][:150], 10: "", 100: "\0" * 300, 101: "ab\0" + "\0" * 250, 102: "x" * 99, 103: "x" * 100}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert digest(S.remove_repeats(df, digest=True).collect()) == repeats(docs)


def test_frequent_grams_are_dealt_by_more_bytes(spark, monkeypatch):
    """One sentence in all texts, between others; some of the texts share more than it."""
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdefgh") for _ in range(87))
    word = lambda n: "".join(rnd.choice("ijklmnop") for _ in range(n))
    ends = [word(70) for _ in range(6)]
    docs = {i: word(rnd.randint(0, 90)) + rnd.choice([rnd.choice(ends), word(30)]) + line + rnd.choice([rnd.choice(ends), word(40)]) + word(rnd.randint(0, 90)) for i in range(400)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(S, "REPORTED", 30)
    texts = S.keyed_texts(df, "doc_id", "text")
    # functions travel by name to the tasks, which have the module's own bound; so the survey is taken here
    found = [r for b in [pa.RecordBatch.from_pandas(texts.toPandas(), preserve_index=False)] for x in S._survey_task([b]) for r in x.to_pylist()]
    frequent = np.sort(np.array([r["gram"] for r in found if r["gram"] is not None], np.int64).view(np.uint64))
    assert len(frequent) and sum(r["n"] for r in found if r["gram"] is None) == sum(map(len, docs.values()))
    twice = texts.mapInArrow(S._anchor_task(8), "bucket int, docs binary, places binary, low binary, high binary").repartitionById(8, "bucket").mapInArrow(S._twice_task, "doc long, place int")
    joined = texts.join(twice.groupBy("doc").agg({"place": "collect_list"}).toDF("doc", "places"), "doc").toPandas()
    batch = pa.RecordBatch.from_pydict({"doc": joined["doc"].tolist(), "text": joined["text"].tolist(), "places": [list(x) for x in joined["places"]]})
    per: Counter = Counter()
    spans: dict[int, list[int]] = {}
    rows: dict[int, list] = {}
    for out in S._run_task(16, frequent)([batch]):
        for r in out.to_pylist():
            per[r["bucket"]] += len(r["places"] or b"") // 4
            rows.setdefault(r["bucket"], []).append(r)
    assert max(per.values()) < 0.3 * sum(per.values())
    for some in rows.values():
        columns = {k: [r[k] for r in some] for k in some[0]}
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]
        for got in S._merge_task([pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types)], names=list(columns))]):
            for r in got.to_pylist():
                spans.setdefault(r["doc"], []).append(r["span"])
    want = repeats(docs)
    for d, t in docs.items():
        runs = S._removed(len(t), spans.get(d))
        assert (len(t), sum(e - s for s, e in runs), len(runs)) == want[d][:3]


def test_hashes_of_bytes_before_are_verified(monkeypatch):
    """With a multiplication that forgets all bytes, hashes say that everything is equal; the bytes tell."""
    rnd = np.random.default_rng(4)
    befores = rnd.integers(0, 2, (40, S.WINDOW - 1)).astype(np.uint8)
    befores[:, 3:] = 0
    shared = np.full(40, S.LENGTH)
    sizes, after, order = np.full(40, S.WINDOW - 1), np.full(40, S.LENGTH), np.arange(40)
    want = [max((o for o in range(S.WINDOW) if any((befores[j, :o] == befores[i, :o]).all() for j in range(i))), default=-1) for i in range(40)]
    most, _ = S.earlier_spans(shared, befores, sizes, after, order)
    assert most.tolist() == want

    class Forgetful(np.ndarray):
        def astype(self, kind):
            return np.zeros(self.shape, kind)

    most, _ = S.earlier_spans(shared, befores.view(Forgetful), sizes, after, order)
    assert most.tolist() == want


def test_repeats_of_the_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert digest(QUERIES["op7_suffix_merge"](spark, data).collect()) == repeats(docs)


def test_repeat_edges(edge, none):
    got = S.remove_repeats(edge).collect()
    assert len(got) == 12 and {r.n_removed for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.kept == "" for r in got if r.doc_id in (2, 3))
    assert sum(r.doc_id is None for r in got) == 1
    assert S.remove_repeats(none).count() == 0
    with_rest = S.remove_repeats(edge, keep=["doc_id", "source"])
    assert with_rest.count() == 12 and "source" in with_rest.columns
    assert S.remove_repeats(edge, keep=["doc_id", "doc", "kept"]).columns == ["doc_id", "doc", "n_bytes", "n_removed", "n_spans", "kept"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=8).map(lambda b: bytes(x % 3 for x in b)), min_size=1).map(sorted), min_size=1, max_size=9))
def test_merge_shares_and_sorts(runs):
    coded = [(r, S.front_coded(r)[0]) for r in runs]
    assert all(S.front_decoded(*S.front_coded(r)) == r for r in runs)
    out = S.merged(coded)
    flat = [runs[r][i] for r, i, _ in out]
    assert flat == sorted(x for r in runs for x in r)
    assert [n for *_, n in out][1:] == [S.shared_prefix(a, b, 0) for a, b in zip(flat, flat[1:])]


def brute_links(texts, similarity=0.8):
    sets = [frozenset(J.shingles(t.encode()).tolist()) for t in texts]
    n, parent = Counter(), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))], n


@pytest.mark.parametrize("chunk", [512, 3])
def test_links_match_brute_force(spark, chunk):
    rnd = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 80))]
        for _ in range(rnd.randint(1, 9)):
            own = list(words)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 50)}"
            texts.append(" ".join(own))
    texts += ["", "one", "one", "One!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(df, chunk=chunk).collect()}
    roots, n = brute_links(texts)
    assert got == {i: (roots[i], n[i]) for i in range(len(texts))}


def test_links_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    roots, n = brute_links([r.text for r in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op9_ngram_jaccard"](spark, data).collect()}
    assert got == {r.doc_id: (rows[roots[i]].doc_id, n[i]) for i, r in enumerate(rows)}


def test_documents_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])
    rows = [(None, near(3)), (None, near(3)), (None, near(50)), (5, " ".join(words)), (None, "others " * 3), (None, "and others still"), (None, "and others still")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.near_duplicates(df).collect()
    # near(3) and near(50) each share 0.8 or more with the whole text, not with each other
    assert sorted((r.class_id or 0, r.n_links) for r in got) == [(0, 0), (0, 1), (0, 1), (5, 1), (5, 2), (5, 2), (5, 3)]
    assert len({r.class_key for r in got}) == 3
    assert sorted((r.doc_id or 0, r.text) for r in J.one_of_each(df).collect()) == [(0, "and others still"), (0, "others others others "), (5, " ".join(words))]


def test_one_id_for_all_rows(spark):
    df = spark.createDataFrame([(1, f"text number {i % 40} of some words that differ {i % 40}") for i in range(120)], "doc_id long, text string").repartition(3)
    assert {(r.class_id, r.n_links) for r in J.near_duplicates(df).collect()} == {(1, 2)}
    # the id and the text of a class's document make it one row
    assert J.one_of_each(df).count() == 40


def loose_texts(rnd, n):
    """A chain of texts whose neighbours are alike at 0.7: bands tie nearly all of them, none is linked but to its copy at the end."""
    words = [f"v{i}" for i in range(20 * n + 160)]
    texts = [" ".join(words[20 * i : 20 * i + 120]) for i in range(n)]
    return texts + [t.replace(" ", " q ", 1) for t in texts[:20]]


@pytest.mark.parametrize("chunk", [16, 64])
def test_loose_components_are_compared_by_bucket(spark, chunk):
    """One candidate component that chance holds together; what is compared follows its buckets and not its square."""
    from pyspark.sql import functions as F

    texts = loose_texts(random.Random(4), 600)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    # rows of one value make bands that half-alike texts share
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(df, rows=2, recall=0.99, chunk=chunk).collect()}
    roots, n = brute_links(texts)
    assert got == {i: (roots[i], n[i]) for i in range(len(texts))}
    bands = J.bands_for(0.8, 0.99, 2)
    grams = [J.shingles(t.encode()) for t in texts]
    classes = spark.createDataFrame([(i, len(g), J.band_keys(g, bands, 2).tolist()) for i, g in enumerate(grams)], "node long, n int, bands array<long>")
    groups = J.comparison_groups(classes, chunk=chunk)
    per = groups.select("node", F.explode("groups").alias("g")).groupBy("g.by_band", "g.grp").agg(F.count("*").alias("m"), F.max("g.parts").alias("parts")).collect()
    sent = sum(r.m * r.parts for r in per)
    buckets = Counter(k for g in grams for k in J.band_keys(g, bands, 2).tolist())
    assert chunk == 64 or any(r.by_band for r in per) and not any(r.m > 300 for r in per if not r.by_band)
    assert sent <= 2 * sum(m for m in buckets.values() if m > 1)


def test_two_classes_may_share_half_a_fingerprint(spark):
    rows = [(b"a" * 8 + b"b" * 8, 1), (b"a" * 8 + b"c" * 8, 2), (b"d" * 16, 3)]
    got = J._numbered(spark.createDataFrame(rows, "fp binary, x int")).collect()
    assert len({r.node for r in got}) == 3


def test_link_edges(edge, none):
    got = J.near_duplicates(edge).collect()
    assert len(got) == 12
    assert {(r.class_id, r.n_links) for r in got if r.doc_id in (1, 5)} == {(1, 2)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id in (2, 3, 4)} == {(2, 2, 0), (3, 3, 0), (4, 4, 0)}
    assert J.near_duplicates(none).count() == 0
    left = J.one_of_each(edge)
    assert left.columns == edge.columns and sorted(r.doc_id for r in left.collect() if r.doc_id in (1, 5, 9)) == [1]
    assert left.where("doc_id IS NULL").count() == 1


def test_bands_meet_the_recall():
    b = J.bands_for(0.8, 0.9998, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.9998 > 1 - (1 - 0.8**6) ** (b - 1)
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    hits = sum(bool((J.band_keys(np.sort(np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])), b, 6) == J.band_keys(a, b, 6)).any()) for _ in range(40))
    assert hits == 40


def test_components_settle(spark):
    edges = [(i, i + 1) for i in range(25)] + [(50, 60), (60, 50), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(26)}, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
