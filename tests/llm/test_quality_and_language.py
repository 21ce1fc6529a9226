import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language as L
from quern.llm import quality as Q
from quern.llm.queries import QUERIES


def base(text):
    """The contract's counts, word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(hit), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_of_all_documents(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op1_quality_divergence"](spark, data).collect()}
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        assert tuple(got[d][c] for c in COUNTS) == base(t), d
    assert all(not r.kept for r in got.values() if r.base_failed)


def test_rejects_shouting_and_keeps_prose(spark, data):
    r = QUERIES["op1_quality_divergence"](spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").where("not base_failed and n_words >= 80").collect()
    loud = [x for x in r if x.text.upper() == x.text]
    prose = [x for x in r if x.n_symbols == 0 and x.text.upper() != x.text]
    assert all(not x.kept for x in loud) and sum(x.kept for x in prose) >= 0.99 * len(prose)


def test_edges(edge, none):
    got = Q.quality_rules(edge).collect()
    assert len(got) == 12 and {r.doc_id for r in got if r.kept} <= {7}
    rows = {(r.doc_id, r.n_words): r for r in got}
    assert rows[(2, 0)].base_failed and rows[(4, 0)].class_distance is None
    assert Q.quality_rules(none).count() == 0
    unknown = Q.quality_rules(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.nearest_lang is None and r.kept == (not r.base_failed) for r in unknown)


def plain_distance(a, b):
    """Jensen-Shannon distance of two dictionaries of counts, written out."""
    na, nb, out = sum(a.values()), sum(b.values()), 0.0
    for k in a.keys() | b.keys():
        p, q = a.get(k, 0) / na, b.get(k, 0) / nb
        out += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x) / 2
    return math.sqrt(max(0.0, out))


def test_verdicts_match_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    by_words, by_class = {}, {}
    for r in docs:
        if r.text is not None and r.lang is not None:
            by_words.setdefault(r.lang, Counter()).update(words(r.text))
            by_class.setdefault(r.lang, Counter()).update(map(Q.class_of, r.text))
    common = {w for c in by_words.values() for w, n in c.items() if n >= 0.001 * c.total()}
    # a language's own common words count apart, all its others are one bin
    own = {lang: {w for w, n in c.items() if n >= 0.001 * c.total()} for lang, c in by_words.items()}
    refs = {lang: Counter({w: c[w] for w in own[lang]}) + Counter({None: c.total() - sum(c[w] for w in own[lang])}) for lang, c in by_words.items()}
    got = {r.doc_id: r for r in QUERIES["op1_quality_divergence"](spark, data).collect()}
    for r in docs:
        g = got[r.doc_id]
        if not g.n_words:
            continue
        mine = Counter(w if w in common else None for w in words(r.text))
        far = {lang: plain_distance(mine, refs[lang]) if mine else None for lang in refs}
        if not mine:
            continue
        nearest = min(sorted(far), key=far.get)
        shape = plain_distance(Counter(map(Q.class_of, r.text)), by_class[nearest])
        assert abs(g.word_distance - far[nearest]) < 1e-6 and far[g.nearest_lang] - far[nearest] < 1e-9
        odd = g.word_chars >= 300 and shape > 0.25 or g.n_words >= 80 and far[nearest] > 0.75 or g.word_chars >= 300 and g.n_words >= 80 and shape > 0.14 and far[nearest] > 0.38
        assert abs(g.class_distance - shape) < 1e-6 and g.kept == (not g.base_failed and not odd)


def test_classes_follow_the_unicode_category():
    got = {c: Q.class_of(c) for c in "aÄ日ाी5٣ \n.-#🙂─\x00€"}
    assert got == {"a": "lower", "Ä": "upper", "日": "letter", "ा": "letter", "ी": "letter", "5": "digit", "٣": "digit", " ": "blank", "\n": "line", ".": "stop", "-": "mark", "#": "symbol", "🙂": "sign", "─": "sign", "\x00": "control", "€": "sign"}
    text = "Für 日本 🙂🙂 ab\n"
    assert dict(zip(Q.CLASSES, Q.class_counts(text.encode(), Q._byte_counts(text.encode())))) == {k: sum(Q.class_of(c) == k for c in text) for k in Q.CLASSES}


def test_distance_is_bounded_and_symmetric():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert Q.js_distance(p, q[None])[0] == pytest.approx(1) and Q.js_distance(p, p[None])[0] == 0
    a, b = np.array([0.7, 0.2, 0.1]), np.array([0.1, 0.3, 0.6])
    assert Q.js_distance(a, b[None])[0] == pytest.approx(Q.js_distance(b, a[None])[0])


def brute_profile(texts, size):
    c = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            c.update(w)
            x = f" {w} "
            c.update(x[i : i + 2] for i in range(len(x) - 1))
        y = f" {' '.join(re.findall(r'[^\W\d_]+', t.lower()))} "
        c.update(y[i : i + 3] for i in range(len(y) - 2))
    return c


def test_ngram_counts_match_a_plain_count():
    text = "Abc ab, déjà-vu 12 ab"
    codes, counts = L.counted(L.ngrams(text))
    name = lambda c: "".join(chr(x) if x else " " for x in ((c >> 42) & 0x1FFFFF, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF))
    got = Counter()
    for c, n in zip(codes.tolist(), counts.tolist()):
        got[name(c).strip()] += n
    want = Counter()
    for g, n in brute_profile([text], 99).items():
        want[g.strip()] += n
    assert got == want


def test_held_out_accuracy_and_no_peeking(spark, data):
    r = QUERIES["op4_language_ranks"](spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert 0.1 * len(r) < len(held) < 0.4 * len(r)
    assert sum(x.lang_pred == x.truth for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in r)


def test_predictions_match_a_plain_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()[:60]
    profiles = L.learn_profiles(spark.createDataFrame([(r.text, r.lang) for r in docs[:40]], "text string, lang string"), size=80)
    order = {lang: {c: k for k, c in enumerate(profiles.codes[np.argsort(np.where(row[:-1] < 0, 10**6, row[:-1]), kind="stable")][: (row >= 0).sum()].tolist())} for lang, row in zip(profiles.langs, profiles.ranks)}
    for r in docs[40:]:
        codes, counts = L.counted(L.ngrams(r.text or ""))
        own = [c for _, c in sorted((-n, c) for c, n in zip(codes.tolist(), counts.tolist()))][:80]
        far = {lang: sum(abs(ranks[c] - i) if c in ranks else 80 for i, c in enumerate(own)) for lang, ranks in order.items()}
        got, score = profiles.predict(r.text)
        assert got == (min(sorted(far), key=far.get) if own else "und")
        assert not own or abs(score - (1 - far[got] / (80 * len(own)))) < 1e-9


def test_kept_names_give_way(edge):
    assert L.language_predictions(edge).columns == ["doc_id", "held_out", "lang_pred", "score"]
    nothing = L.learn_profiles(edge.where("false"))
    assert L.predict_language(edge, nothing, keep=["doc_id", "_text", "score"]).columns == ["doc_id", "_text", "lang_pred", "score"]
    assert Q.quality_rules(edge, keep=["doc_id", "n_words", "kept", "host"]).columns[:2] == ["doc_id", "host"]


def test_language_edges(edge, none):
    got = {(r.doc_id, r.score == 0): r.lang_pred for r in L.language_predictions(edge).collect()}
    assert got[(2, True)] == got[(3, True)] == got[(4, True)] == "und"
    assert L.language_predictions(none).count() == 0
    nothing = L.learn_profiles(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in L.predict_language(edge, nothing).collect()} == {"und"}
