import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import secrets as S
from quern.llm import toxicity as T
from quern.llm.queries import QUERIES

BASE = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32)}


def base_spans(text):
    order = list(BASE)
    found = [(m.start(), order.index(k), k, m.end()) for k, (x, g, n) in BASE.items() for m in x.finditer(text or "") if len(m[g]) >= n]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans_of_the_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op8_secret_scan"](spark, data).collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == S.digest_of(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in BASE)
        assert [x for x in r.spans.split(",") if x.split(":")[0] in BASE] == [f"{k}:{s}:{e}" for k, s, e in want]


CHECKS = [(re.compile(r.match, re.A | (re.I if r.any_case else 0)), re.compile(r.head, re.A | (re.I if r.any_case else 0)), r.least) for r in S.RULES]


def all_spans(text):
    """Every rule's spans by Python's regex engine."""
    return sorted((m.start(), i, m.end()) for i, (match, head, least) in enumerate(CHECKS) for m in match.finditer(text) if m.end() - head.match(text, m.start()).end() >= least)


def test_automata_find_what_regexes_find():
    scan, rnd = S.scanner(), random.Random(1)
    bits = ["token", "Secret", "api_key", " ", "=", ":", '"', "abc", "a1" * 8, "AKIA", "ABCD1234", "0123456789abcdef", "é", "ghp_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "sk_live_", "x" * 20, "xoxb-", "K", "AIza", "\n"]
    for _ in range(6000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 16)))
        assert scan.spans(text) == all_spans(text)
        assert [(S.RULES[i].kind, s, e) for s, i, e in all_spans(text) if S.RULES[i].base] == base_spans(text)


def test_a_long_run_shows_its_beginning_once():
    text = "ab12" * 20_000
    assert S.scanner().places(text.encode()) == [(0, 2)] and S.scanner().spans(text) == [(0, 2, len(text))]


def test_automaton_is_minimal_and_total():
    a = S.deterministic((("ab|cb", False), ("x{2}", False)), anywhere=True)
    assert all(len(r) == len(set(a.classes)) for r in a.rows)
    assert len(a.rows) == 5  # start, after a or c, after x, and the two marks
    for bad in ("^a", "a.b", "(a", "a)"):
        with pytest.raises((ValueError, IndexError)):
            S.deterministic(((bad, False),), anywhere=True)
    with pytest.raises(ValueError):
        S.Scanner((S.Rule("c", ("a+",), "a+b"),))


def test_secret_edges(edge, none):
    got = S.secret_spans(edge).collect()
    assert len(got) == 12 and [len(r.spans) for r in got if r.doc_id is None] == [1]
    masked = S.redact_secrets(edge)
    assert masked.columns == edge.columns and masked.count() == 12
    assert [r.text for r in masked.collect() if r.doc_id is None] == ["A document without a number, [SECRET]"] or "[SECRET]" in masked.where("doc_id IS NULL").first().text
    assert masked.where("doc_id = 2").first().text is None
    assert S.redact_secrets(none).count() == 0 and S.secret_spans(none).count() == 0
    assert S.secret_spans(edge, keep=["doc_id", "spans", "_row"]).columns == ["doc_id", "_row", "spans"]


def test_masks_cover_overlaps():
    assert S.redacted("aabbccdd", [(1, 0, 3), (2, 1, 5), (6, 0, 7)], "#") == "a#c#d"
    assert S.redacted("abc", [(0, 0, 3)], "#") == "#"


def test_units_join_letters_and_drop_signs():
    assert T.units("You i d i o t, wor*th-less M0RON a the") == ["^you", "^idiot", "^worthless", "^moron", "^the"]
    assert T.units("") == []
    long = "x" * 100 + "insult"
    assert all(len(u) <= T.WIDTH for u in T.units(long)) and T.units(long)[-1].endswith("insult")
    assert T.sentences("One two. Two two three!\nfour") == [["^one", "^two"], ["^two", "^three"], ["^four"]]


def invented(rnd, rows, share, insults=("idiot", "worthless", "moron", "pathetic")):
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(rows):
        words, bad = [word() + ("." if k % 10 == 9 else "") for k in range(40)], i < rows * share
        if bad:
            words[5], words[19] = rnd.choice(insults), rnd.choice(insults)
        out.append((" ".join(words), int(bad)))
    return out


def test_table_gives_the_kernel_machine():
    """The collapsed weights give what a machine on the explicit kernel k(x, y) gives."""
    rnd = random.Random(7)
    rows = invented(rnd, 40, 0.5)
    toxic, clean = ([s for t, y in rows if y == k for s in T.sentences(t)] for k in (1, 0))
    rarity = np.random.default_rng(0).uniform(0.5, 2, T.BUCKETS)
    table, bias = T.fit_machine(toxic, clean, rarity, landmarks=24, seed=3)
    rng = np.random.default_rng(3)
    marks = [toxic[i] for i in rng.permutation(len(toxic))[:12]]
    marks += [clean[i] for i in rng.permutation(len(clean))[:12]]
    k = np.array([[T.kernel(a, b, rarity) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    fit = values > 1e-4 * values.max()
    root = vectors[:, fit] / np.sqrt(values[fit])
    z = np.array([[T.kernel(a, b, rarity) for b in marks] for a in toxic + clean]) @ root
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    w, b = T.squared_hinge(z, y, np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean)))
    assert abs(b - bias) < 0.02
    model = T.ToxicityModel(table, bias, np.zeros(T.EVIDENCE + 1))
    got = [model.margins(s).sum() / np.sqrt(len(s) + T.SHORT) + bias for s in toxic + clean]
    assert np.abs(np.array(got) - (z @ w + b)).max() < 0.05


def test_models_in_turn_keep_their_own_scores():
    rng = np.random.default_rng(1)
    texts = ["some words in a row", "others. and more of them", None]
    models = [T.ToxicityModel(rng.normal(size=T.BUCKETS).astype(np.float32), 0.1, rng.normal(size=T.EVIDENCE + 1)) for _ in range(2)]
    alone = [m.score(T.Scorer(m).evidence(texts)).tolist() for m in models]
    for _ in range(20):
        for m, want in zip(models, alone):
            assert m.score(T.Scorer(m).evidence(texts)).tolist() == want
    assert alone[0] != alone[1]


class Counting(dict):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_each_different_word_is_looked_at_once(monkeypatch):
    """Words that come again cost neither scoring nor counting the work of new ones."""
    table, given, inner = Counting(T.PLAIN), [], T.subsequences
    monkeypatch.setattr(T, "PLAIN", table)
    monkeypatch.setattr(T, "subsequences", lambda words, *more: (given.extend(words), inner(words, *more))[1])
    texts = ["You wor*th-less m0ron. So they say! " * 20] * 30
    T.Scorer(T.ToxicityModel(np.ones(T.BUCKETS, np.float32), 0.1, np.ones(T.EVIDENCE + 1))).evidence(texts)
    assert table.asked <= 40 and len(given) == 6
    given.clear()
    (counts,) = T._presence_task([pa.RecordBatch.from_pydict({"text": texts, "y": [1.0] * 10 + [0.0] * 20})])
    assert len(given) == 6 and set(counts.column("toxic").to_pylist()) == {10} and set(counts.column("clean").to_pylist()) == {20}


@pytest.mark.parametrize(("letters", "held"), [(1 << 20, 300_000), (300, 300_000), (500, 40)])
def test_splitter_finds_the_sentences_of_texts(monkeypatch, letters, held):
    """Groups of texts give what sentences() gives for each, whatever the groups and the words that are held."""
    monkeypatch.setattr(T, "GROUP", letters)
    monkeypatch.setattr(T, "HELD_WORDS", held)
    rnd = random.Random(9)
    bits = ["a", "b", "I", "\u03a3", "\u0391\u03a3", "\u0130", "foo", "Bar.", "x!", "?", ".", "...", "-", "$", "w*rd", "m0r0n", "\n", "\r", "\r\n", "\x85", " ", "\x1c", "\t", "x" * 23, "x" * 24, "y" * 25, "z" * 80, "\u99ac", "\u3000", "1", "a.", "\u0307", "'"]
    texts = [None, "", " ", *("".join(rnd.choice(bits) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 90))) for _ in range(1500)), None]
    split, got = T.Splitter(), []
    for some in T.grouped(texts):
        found = split.group(some)
        got += [[found.sentence(i) for i in range(a, b)] for a, b in zip(found.bounds[:-1], found.bounds[1:])]
    assert got == [T.sentences(t) for t in texts]
    assert T.Splitter().group([None, ""]).bounds.tolist() == [0, 0, 0]


def test_toxicity_held_out(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    r = QUERIES["op10_toxicity_kernel"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.toxic for x in r) >= 0.93 * len(r)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in r)


@pytest.mark.parametrize(("toxic", "copies"), [(0.25, 0), (0.4, 0), (0.6, 0), (0.25, 400)])
def test_gapped_insults_stand_out(spark, toxic, copies):
    """At several shares of labels, and with one toxic text whose copies are half of the rows."""
    rows = invented(random.Random(3), 400, toxic)
    model = T.learn_toxicity(spark.createDataFrame(rows + rows[:1] * copies, "text string, toxic int").repartition(3))
    m = dict(zip(names := ["idiot", "idxiot", "worthlesss", "mooron", "therhe", "anre"], model.margins([f"^{w}" for w in names])))
    assert min(m[x] for x in names[:4]) > max(m[x] for x in names[4:])
    asked = [(1, "you i d i o t and w*orthless mor-on"), (2, "the on an re he thon"), (3, ""), (4, None), (5, "thon erre an he re ther an idiot heer. " + "on the an re. " * 60)]
    scores = {r.doc_id: r.score for r in T.score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert scores[1] > 0.5 > scores[2] and scores[3] < 0.5 and scores[4] < 0.5 and scores[5] > scores[2]


def test_insults_of_other_scripts_and_within_long_words(spark):
    rows = invented(random.Random(5), 300, 0.4, ("馬鹿野郎", "тупица"))
    model = T.learn_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    asked = [(1, "the on 馬鹿野郎 an re he. thon 馬鹿野郎"), (2, "the on an тупица. тупица re he"), (3, "the on an re he thon"), (4, "re on. " + "anheth" * 30 + "тупица" + " the. " + "ontherre" * 9 + "馬鹿野郎")]
    scores = {r.doc_id: r.score for r in T.score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert min(scores[1], scores[2]) > 0.5 > scores[3] and scores[4] > scores[3]


def test_the_bound_on_training_texts_holds(spark):
    rows = invented(random.Random(6), 60, 0.5)
    df = spark.createDataFrame([(t, y, i) for i, (t, y) in enumerate(rows * 30)], "text string, label int, h long").withColumn("h", F.xxhash64("text"))
    assert T.sampled_texts(df, 20).count() == 20 and T.sampled_texts(df, 500).count() == 60


def test_toxicity_edges(edge, none):
    labels = edge.select("doc_id", F.lit(1).alias("toxic"))
    got = T.toxicity_predictions(edge, labels).collect()
    assert len(got) == 12 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert T.toxicity_predictions(none, labels).count() == 0
    model = T.ToxicityModel(np.zeros(T.BUCKETS, np.float32), 0.0, np.zeros(T.EVIDENCE + 1))
    assert T.score_toxicity(edge, model, keep=["doc_id", "_text", "score", "words"]).columns == ["doc_id", "_text", "words", "score", "predicted"]
    assert T.toxicity_predictions(edge, labels.where("false")).where("score > 0.5").count() == 0


def test_pipeline_stages_against_plain_code(spark, data):
    """Each stage on its own input: what stays, and that it stays as it was."""
    from test_quality_and_language import base
    from test_repeats_and_joins import brute_links
    from test_tokens_and_packing import check_packing
    from test_urls_and_decontamination import brute

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        from quern.llm.common import stored

        docs = stored(stage(spark, docs, data), f"test-{name}")
        held[name] = docs.collect()
        if name == "packing":
            check_packing(held[name])
            assert {r.doc_id for r in held[name]} == set(before)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r for r in held[name]}
        if name != "secrets":
            assert all(after[d] == before[d] for d in after)
        if name == "quality_rules":
            assert not [d for d in after if base(before[d].text)[5]]
        elif name == "near_duplicates":
            ids = sorted(before)
            roots, _ = brute_links([before[d].text for d in ids])
            assert set(after) == {ids[r] for r in roots}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {x[0] for x in brute([(d, r.text) for d, r in before.items()], items) if x[5]}
            assert set(after) == set(before) - bad
        else:
            assert set(after) == set(before)
            assert not [d for d, r in after.items() if base_spans(r.text)]
            assert all((after[d].text == before[d].text) == (not all_spans(before[d].text)) for d in after)
            assert all(r.n_chars == len(r.text) for r in after.values())


def test_stages_on_rows_of_all_kinds(spark, data, edge, none):
    """Nulls, empty, long and repeated rows, clashing columns, missing columns and empty tables go through each stage."""
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge, none, edge.select("doc_id", "text")):
            got = stage(spark, docs, data)
            if name != "packing":
                assert got.columns == docs.columns
            kept[name, len(docs.columns), docs is none] = got.collect()
    wide = len(edge.columns)
    assert {r.doc_id for r in kept["quality_rules", wide, False]} <= {7} and kept["quality_rules", 2, False] == []
    assert len(kept["near_duplicates", wide, False]) == 9 and len(kept["decontamination", wide, False]) == 12
    assert len(kept["secrets", wide, False]) == 12 and "[SECRET]" in [r.text for r in kept["secrets", 2, False] if r.doc_id is None][0]
    assert sum(r.piece == 0 for r in kept["packing", wide, False]) == 12
    assert not any(rows for (_, _, empty), rows in kept.items() if empty)
