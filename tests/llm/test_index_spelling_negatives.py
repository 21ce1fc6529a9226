import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import cuckoo as C
from quern.llm import negatives as N
from quern.llm import spelling as S
from quern.llm.queries import QUERIES


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# Exact groups


def plain_groups(rows):
    """(doc_id, text) rows to the contract's rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    key = lambda i: -(2**63) if i is None else i
    out = []
    for t, ids in groups.items():
        best = max(ids, key=key)
        stays = [ids.index(best)]
        out += [(i, best, len(ids), at in stays, hashlib.sha256(t.encode()).hexdigest()) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


def found_groups(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact_groups_of_rows_of_all_kinds(edge, none):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert found_groups(C.exact_groups(edge)) == plain_groups(rows)
    assert C.exact_groups(none).count() == 0
    kept = C.exact_groups(edge, keep=edge.columns)
    assert kept.count() == len(rows) and kept.where("kept").select("text_sha256").distinct().count() == kept.where("kept").count()


def test_exact_groups_of_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found_groups(QUERIES["op11_exact_cuckoo"](spark, data)) == plain_groups(rows)


def test_one_text_on_most_rows_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 50)
    rows = [(i, "The SAME text" if i % 3 else f"text {i % 70}") for i in range(3000)]
    assert found_groups(C.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == plain_groups(rows)


@pytest.mark.parametrize("keys", [3, 37, 5000])
def test_filter_holds_what_was_put_and_loses_what_was_dropped(keys):
    rng = np.random.default_rng(keys)
    digests = rng.integers(0, 2**63, 2 * keys, dtype=np.uint64)
    f = C.CuckooFilter(keys)
    assert f.put(digests[:keys], np.arange(keys, dtype=np.int32))
    which, row = f.hits(digests[:keys])
    assert set(np.arange(keys)) == {int(a) for a, b in zip(which, row, strict=True) if a == b}
    assert f.may_hold(digests[keys:]).mean() < 0.01
    f.drop(digests[: keys // 2], np.arange(keys // 2, dtype=np.int32))
    assert f.may_hold(digests[keys // 2 : keys]).all()
    assert f.may_hold(digests[: keys // 2]).mean() < 0.1


@pytest.mark.parametrize("bits", [64, 12, 3])
def test_shard_is_exact_whatever_digests_share(bits):
    """Overflow builds the filter anew from the stored keys; equal digests of unlike texts are told apart by content."""
    rng = random.Random(bits)
    shard, live = C.Shard(bits), {}
    for _ in range(60):
        texts = [str(rng.randrange(900)) for _ in range(rng.randrange(1, 60))]
        address = np.array([hashlib.sha256(t.encode()).digest() for t in texts], "S32")
        if rng.random() < 0.7:
            ids = [rng.randrange(10**6) for _ in texts]
            shard.insert(address, np.array([(len(t), i, 0, 1) for t, i in zip(texts, ids, strict=True)], np.int64))
            for t, i in zip(texts, ids, strict=True):
                best, n = live.get(t, (i, 0))
                live[t] = (max(best, i), n + 1)
        else:
            shard.delete(address, np.array([len(t) for t in texts]))
            for t in texts:
                live.pop(t, None)
    every = [str(i) for i in range(900)]
    row = shard.find(np.array([hashlib.sha256(t.encode()).digest() for t in every], "S32"), np.array([len(t) for t in every]))
    assert {t: (int(shard.values[r, 1]), int(shard.values[r, 3])) for t, r in zip(every, row, strict=True) if r >= 0} == live
    assert shard.resized > 0


def test_index_takes_in_and_lets_go(spark):
    docs = lambda ids: spark.createDataFrame([(i, f"Text {i % 40}") for i in ids], "doc_id long, text string")
    index = C.changed(None, insert=C.content_blocks(docs(range(30))))
    index = C.changed(index, insert=C.content_blocks(docs(range(20, 100))))
    asked = C.content_blocks(docs(range(60)))
    live = lambda index: sorted((r["keep_id"], r["group_size"]) for r in C.live_contents(index, asked).collect())
    size = lambda k: len([i for i in [*range(30), *range(20, 100)] if i % 40 == k])
    best = lambda k: max(i for i in range(100) if i % 40 == k)
    assert live(index) == sorted((best(k), size(k)) for k in range(40))
    index = C.changed(index, delete=C.content_blocks(docs(range(5, 10))))
    assert live(index) == sorted((best(k), size(k)) for k in range(40) if not 5 <= k < 10)
    index = C.changed(index, insert=C.content_blocks(docs([46])))
    assert (46, 1) in live(index)
    assert C.live_contents(index, C.content_blocks(docs([]))).count() == 0


# Spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spelling(rows):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    v = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    beside = defaultdict(set)
    for w in v:
        for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
            beside[k].add(w)
    near = {w: [x for x in set().union(*(beside[k] for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))])) if one_edit(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 5 * v[w] else None
    out = set()
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, v[w], len(near[w]), v.get(form[w])))
    return out


def found_spelling(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_of_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found_spelling(QUERIES["op12_spelling_trie"](spark, data)) == plain_spelling(rows)


@pytest.fixture(scope="module")
def variants():
    """Words of few letters, so that many are near, in chains of falling counts, with letters of two bytes and long words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(400)] + ["longer" * 40, "longer" * 39 + "langer", "naïveté", "NAÏVETÉ", "naivete"]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(60)) + "—" + words[-1 - i % 5] + "×÷ ’tail"))
    rows.append((301, "chainaaa " * 1500 + "chainaab " * 200 + "chainabb " * 30 + "chainbbb " * 5))
    return [*rows, (None, "words without an id, naivete"), (300, None), (300, ""), (5, rows[5][1]), (5, rows[6][1])]


@pytest.mark.parametrize("slices", [False, True])
def test_spelling_of_near_words_in_parts_of_any_size(spark, variants, monkeypatch, slices):
    if slices:
        monkeypatch.setattr(S, "PART_WORDS", 4)
    words = S.vocabulary(spark.createDataFrame(variants, "doc_id long, text string").repartition(4))
    want = plain_spelling(variants)
    assert any(w[2] not in (w[0], w[1]) for w in want)
    assert {(r["word"], r["n"]) for r in words.collect()} == {(w[0], w[3]) for w in want}
    assert found_spelling(S.with_roots(S.with_forms(words))) == want


def test_spelling_of_rows_of_all_kinds(edge, none):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    many = edge
    for _ in range(5):
        many = many.unionByName(edge)
    assert found_spelling(S.spelling_groups(many)) == plain_spelling(rows * 6)
    assert S.spelling_groups(none).count() == 0


def test_search_in_small_steps(monkeypatch):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdz") for _ in range(rng.randint(6, 8))) for _ in range(900)})
    rows = sorted((hash((a, e, w[-a:] if e else w[:a])), a, e, w) for w in words for a in {len(w) // 2, (len(w) + 1) // 2} for e in (False, True))
    monkeypatch.setattr(S, "STEP", 50)
    monkeypatch.setattr(S, "PAIRS", 7)
    key, size, ends = (np.array([r[k] for r in rows]) for k in range(3))
    every = np.ones(len(rows), bool)
    q, m = S.near_words(key, size, ends, [r[3].encode("latin-1") for r in rows], every, every)
    found = [(rows[a][3], rows[b][3]) for a, b in zip(q, m, strict=True)]
    assert len(set(found)) == len(found)
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}


# Hard negatives


def plain_negatives(rows):
    """(vec_id, label, vector) rows to the contract's rows; of rows that share an id the greatest counts."""
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        v = [math.floor(256 * x) for x in v]
        if math.sqrt(sum(x * x for x in v)) < 2**31:
            usable[i] = max(usable.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (la, va) in usable.items():
        if a % 100:
            continue
        scored = sorted((-dot(va, v), i, label) for i, (label, v) in usable.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fit = [(-s, i) for s, i, label in scored if label != la and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out |= {(a, p, k + 1, i, -ps, s) for k, (s, i) in enumerate(fit)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def found_negatives(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, v string, ids int").repartition(3)


def test_negatives_of_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert found_negatives(QUERIES["op13_hard_negatives"](spark, data)) == plain_negatives(rows)


@pytest.mark.parametrize("width, spread", [(3, 0.2), (20, 1.0), (64, 0.05)])
def test_negatives_of_clusters_ties_and_copies(spark, monkeypatch, width, spread):
    """Small blocks and few held rows, one vector on a third of the rows, and values that floats round."""
    monkeypatch.setattr(N, "ROWS", 40)
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "HELD", 30)
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(900):
        c = int(rng.integers(6))
        x = centres[0] if i % 3 == 0 else centres[c] + spread * rng.normal(size=width)
        rows.append((i, int(rng.integers(4)), [float(np.float32(y)) for y in x], "x", i))
    assert found_negatives(N.hard_negatives(vectors(spark, rows))) == plain_negatives([r[:3] for r in rows])


def test_negatives_of_rows_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    some = [(i, i % 3, [float((i * k) % 7 - 3) / 4 for k in range(1, 6)], None, 0) for i in range(1, 250)]
    odd = [(None, 1, [1.0] * 5, None, 0), (300, None, [1.0] * 5, None, 0), (301, 1, None, None, 0), (302, 1, [1.0, None], None, 0), (303, 1, [nan] * 5, None, 0), (304, 1, [inf, 1.0], None, 0)]
    more = [(400, 1, [], None, 0), (401, 1, [0.5], None, 0), (402, 2, [0.5] * 9, None, 0), (100, 2, [0.25] * 5, None, 0), (100, 1, [0.5] * 5, None, 0), some[10], (500, 1, [3e38] * 5, None, 0), (501, 2, [3e6] * 5, None, 0), (600, -1, [0.0] * 5, None, 0), (0, -3, [-1.0] * 5, None, 0)]
    rows = [*some, *odd, *more]
    found = found_negatives(N.hard_negatives(vectors(spark, rows)))
    assert found == plain_negatives([r[:3] for r in rows]) and found
    assert N.hard_negatives(vectors(spark, some[:90])).count() == 0
    assert N.hard_negatives(vectors(spark, rows).where("false")).count() == 0


def test_search_finds_every_pair_above_the_threshold():
    rng = np.random.default_rng(4)
    m = (rng.normal(size=(500, 37)) * rng.uniform(1, 400, 37)).astype(np.int32)
    block = N.Block(np.arange(500), np.zeros(500), m)
    assert min(block.lengths) < 500  # the suffixes of some rows are not in the index
    asked = m[::50] + rng.integers(-3, 4, (10, 37)).astype(np.int32)
    scores = asked.astype(np.int64) @ m.T.astype(np.int64)
    for share in (0.9, 0.3, 0.0, -2.0):
        least = share * np.sqrt((asked.astype(float) ** 2).sum(axis=1)) * 1000
        i, r, s = block.search(asked, least)
        want = {(a, b) for a, b in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
        assert {(a, int(block.ids[b])) for a, b in zip(i, r, strict=True)} == want
        assert all(scores[a, block.ids[b]] == x for a, b, x in zip(i, r, s, strict=True))


def test_anchors_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_BYTES", 0)
    rows = [(i, i % 3, [float((i * k) % 11 - 5) / 4 for k in range(1, 6)], None, 0) for i in range(300)]
    assert found_negatives(N.hard_negatives(vectors(spark, rows))) == plain_negatives([r[:3] for r in rows])


def test_twins(spark, data):
    import duckdb

    from quern.llm.queries import oracles

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("op11_exact_cuckoo", "op13_hard_negatives"):
        twin = con.execute(oracles()[name])
        columns = [c[0] for c in twin.description]
        found = QUERIES[name](spark, data).select(*(F.col(c) for c in columns)).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(twin.fetchall(), key=repr)
