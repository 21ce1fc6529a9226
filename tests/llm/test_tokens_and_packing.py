import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing as P
from quern.llm import tokens as T
from quern.llm.queries import QUERIES


@pytest.fixture(scope="module")
def plain():
    tk = Tokenizer.from_file(T.vocabulary_path())
    return lambda text: tk.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBcé ÉßΣσς'’s.,!$\n\t\u00a0\u0301\u3000 12日本🙂ﬁ"), max_size=40), max_size=6))
def test_pieces_give_the_whole_texts_ids(texts):
    enc = T.encoder(T.vocabulary_path())
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode([t.encode() for t in texts])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_round_trip_and_random_access(ids, data):
    r = T.DacReader(T.dac_encode(np.array(ids, np.uint32)))
    assert len(r) == len(ids)
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert r[i] == ids[i] and r.slice(i, j).tolist() == ids[i:j]
        with pytest.raises(IndexError):
            r[len(ids)]
    assert r.slice(0, len(ids)).tolist() == ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_hold_every_document_in_order(spark, data, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got, at = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, data).collect()}, 0
    for d in sorted(docs):
        ids = [*plain(docs[d]), 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_tokens_at_any_place(spark, data, plain, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    T.write_token_files(docs, f"file://{tmp_path}/t", vocabulary=T.vocabulary_path(), segment_tokens=5000, partitions=3)
    every = [i for r in sorted(docs.collect(), key=lambda r: r.doc_id) for i in [*plain(r.text), 1]]
    asked = [0, 1, 4999, 5000, 5001, len(every) // 2, len(every) - 1, len(every), -1, 7, 7]
    got = {r.position: r.token for r in T.tokens_at(spark, f"file://{tmp_path}/t", spark.createDataFrame([(i,) for i in [*asked, None]], "position long")).collect()}
    assert got == {i: every[i] for i in set(asked) if 0 <= i < len(every)}


def test_segments_lie_in_the_files_as_they_are(spark, tmp_path):
    import glob

    df = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(300)], "doc_id long, text string")
    T.write_token_files(df, f"file://{tmp_path}/t", vocabulary=T.vocabulary_path(), partitions=2)
    files = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/t/*.parquet"))
    payloads = [bytes(r.payload) for r in spark.read.parquet(f"file://{tmp_path}/t").select("payload").collect()]
    assert payloads and all(p in files for p in payloads)


def test_an_id_is_read_from_a_few_bytes():
    """No more than a chunk, a bit and a rank with its block of 64 bytes for each level."""
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            touched.append(np.size(got) * self.itemsize)
            return np.asarray(got) if isinstance(at, slice) else got

    ids = np.random.default_rng(0).integers(0, 49_000, 200_000).astype(np.uint32)
    r = T.DacReader(T.dac_encode(ids))
    r.levels = [tuple(x.view(Counted) for x in level) for level in r.levels]
    for i in (0, 511, 512, 123_456, 199_999):
        touched.clear()
        assert r[i] == ids[i] and sum(touched) < 200


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = T.Encoder(path)
    assert not enc.by_piece and T.Encoder(T.vocabulary_path()).by_piece
    texts = ["Two  words, and\n\nlines", "", " a"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode([t.encode() for t in texts])] == want


def test_rows_of_one_id_need_not_lie_in_one_range(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    got = T.encode_round_trip(df).orderBy("start").collect()
    assert len(got) == 400 and [r.start for r in got][1:] == [r.start + r.n_tokens for r in got][:-1]


def test_token_edges(spark, edge, none):
    got = T.encode_round_trip(edge).orderBy("start").collect()
    assert len(got) == 12 and got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert T.encode_round_trip(none).count() == 0


def check_packing(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_tight(spark, data, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op2_pack_islands"](spark, data).collect()
    n, total, by = check_packing(rows), 0, {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.piece] = r
    for d, t in docs.items():
        ids = [*plain(t), 0]
        total += len(ids)
        parts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert sorted(by[d]) == list(range(len(parts)))
        assert [(by[d][k].start, by[d][k].length, by[d][k].ids_crc32) for k in range(len(parts))] == [(2048 * k, len(p), crc(p)) for k, p in enumerate(parts)]
    assert n <= -(-total // 2048) * 1.01 + 1


def test_packing_edges(edge, none):
    rows = P.pack(edge).collect()
    check_packing(rows)
    assert sum(r.piece == 0 for r in rows) == 12 and sum(r.doc_id == 5 for r in rows) == 2
    assert P.pack(none).count() == 0


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(2)
    p = P.Packer(rng.integers(1, 1500, 200).tolist(), 2048, 7)
    first = p.first(4)
    for child in [p.cross(first[0], first[-1]), p.mutate(first[0]), *p.evolve(first, 5, 4)]:
        assert sorted(i for b in child for i in b) == list(range(200))
        assert all(p.fill(b) <= 2048 for b in child)
    assert p.fitness(p.evolve(first, 5, 4)[0]) >= max(map(p.fitness, first))


@pytest.mark.parametrize(("low", "high", "saved"), [(200, 1000, 1), (380, 1100, 4), (500, 1024, 8)])
def test_evolution_saves_bins_of_hard_lengths(low, high, saved):
    """Lengths of which two or three fill a bin, where longest-first best fit is far from the bound."""
    rng = np.random.default_rng(low)
    p = P.Packer(rng.integers(low, high, 600).tolist(), 2048, 1)
    first = p.first(P.POPULATION)
    assert len({len(x) for x in first}) > 1  # not all children of one solution
    best = p.evolve(first, P.EPOCHS * P.GENERATIONS, P.POPULATION)[0]
    assert len(best) <= min(map(len, first)) - saved
    assert sorted(i for b in best for i in b) == list(range(600)) and max(map(p.fill, best)) <= 2048


def test_exchanges_lose_nothing():
    rng = np.random.default_rng(5)
    for seed in range(20):
        p = P.Packer(rng.integers(1, 900, 60).tolist(), 2048, seed)
        bins = p.best_fit(p.longest_first(range(60)), [])
        out = p.placed([i for b in bins[:3] for i in b], [list(b) for b in bins[3:]])
        assert sorted(i for b in out for i in b) == list(range(60)) and max(map(p.fill, out)) <= 2048


def test_islands_and_migration(spark):
    """Groups that best fit leaves open go through all epochs, and keep every item."""
    rng = np.random.default_rng(3)
    rows = [(g, sorted(rng.integers(400, 1100, 120).tolist(), reverse=True)) for g in range(3)]
    got = {r.grp: r.solution for r in P.best_solutions(spark.createDataFrame(rows, "grp long, lengths array<long>")).collect()}
    for g, lengths in rows:
        p = P.Packer(lengths, 2048, 0)
        bins = P._bins(got[g])
        assert sorted(i for b in bins for i in b) == list(range(120)) and max(map(p.fill, bins)) <= 2048
        assert len(bins) < len(p.best_fit(p.longest_first(range(120)), []))


def test_added_tokens_in_any_case_are_what_the_library_makes_of_them():
    """Added tokens are looked for before letters are lowered: only their own form is one id."""
    import random
    import struct

    from quern.llm.tokens import Encoder, vocabulary_path

    rng = random.Random(3)
    e = Encoder(vocabulary_path())
    added = ["<|startoftext|>", "<|endoftext|>"]
    forms = [f for c in added for f in (c, c.upper(), c.title(), c.swapcase(), "".join(rng.choice((x, x.upper())) for x in c))]
    signs = ["<|", "|>", "'S", "'re", " ", "\t", "\n", " ", " ", "　", "\x1c", "\x85", "İ", "ß", "Ab", "日", "🙂", "1", "23", "!", "ﬁ", "Ω", "_", "|", "̇"]
    some = lambda: rng.choice(forms + signs) if rng.random() < 0.7 else chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x10000, 0x1FFFF))))
    texts = [*forms, *(f"word{f}Word" for f in forms), *(f"!{f}?" for f in forms), *("".join(some() for _ in range(rng.randrange(1, 14))) for _ in range(20_000))]
    found = list(e.encode([t.encode() for t in texts]))
    assert found == [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
