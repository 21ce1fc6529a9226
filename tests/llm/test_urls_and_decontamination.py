import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate as D
from quern.llm import urls as U
from quern.llm.queries import QUERIES, oracles


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    best = None
    for r, v in U.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best or (None, None)


URLS = [None, "", "no scheme", "http://A.NET/x", "http://net/", "http://net", "http://x.example.net/en/1?q", "http://example.com/de/1#a://b", "http://notexample.com/de/", "http://ÉX.org/fr/x", "http://a.org/fr", "HTTP://x.example.com:80/de/?a", "http://u@a.net/en/", "x://y://z.net/", "http://a.example.net/en"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate([*URLS, *URLS[:3]])], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in U.filter_urls(pages).collect()}
    for i, u in enumerate([*URLS, *URLS[:3]]):
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert U.filter_urls(pages.where("false")).count() == 0


def test_rules_of_the_whole_table(spark, data):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op3_url_trees"](spark, data).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def held_out_hosts(spark, sf):
    """(precision, recall, rows) of the trees on hosts of which they saw no URL."""
    host = U.host_of(F.col("url"))
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").where(host != "").withColumn("label", U.seed_labels(host))
    out = F.pmod(F.crc32(host.cast("binary")), F.lit(4)) == 0
    got = U.UrlFilter(rows.where(~out)).judge(rows.where(out), keep=["page_id", "label"], rules=()).collect()
    hit = sum(r.verdict == "block" and r.label == 1 for r in got)
    return hit / max(1, sum(r.verdict == "block" for r in got)), hit / max(1, sum(r.label == 1 for r in got)), len(got)


def test_trees_find_bad_hosts_that_they_have_not_seen(spark, data):
    precision, recall, n = held_out_hosts(spark, data.replace("sf0.001", "sf0.1"))
    assert n > 200 and precision >= 0.5 and recall >= 0.6


def test_copies_of_two_urls_are_two_training_rows(spark):
    urls = spark.range(60_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://spam.example/a").otherwise("http://plain.example/b").alias("url"))
    got = U.filter_urls(urls)
    assert got.count() == 60_000 and {r.score >= 0 for r in got.select("score").distinct().collect()} == {True}
    one = U.filter_urls(urls.where("page_id % 2 = 0"))
    assert one.count() == 30_000 and {(r.verdict, r.score) for r in one.select("verdict", "score").distinct().collect()} == {("block", 1.0)}
    assert U.filter_urls(urls.where("page_id < 9"), keep=["page_id", "url"]).columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, ""), (4, None), (10, "SHORT, item!"), (5, "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (6, "Élan vital")]
TEXTS = [
    (1, "zero ONE two three four-five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, "a short item and a short item"), (3, None), (4, ""), (5, "élan vital"), (6, "Élan vital"),
    (7, "short " * 50 + "item"), (8, "nothing here"), (2, "a short item and a short item"), (None, "short item"), (9, "...!"),
]


@pytest.mark.parametrize("most", [D.MOST_BITS, 7])
def test_contamination_matches_brute_force_whatever_the_bitmap(spark, most):
    """A full set and one of 128 bits, in which most places seem known."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).select("*", *(F.lit(1).alias(c) for c in ("words", "n_words", "at", "size", "key", "items", "hash", "_row", "_k0")))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(docs, bench, most_bits=most).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute(TEXTS, ITEMS)
    left = D.decontaminate(docs, bench, most_bits=most)
    assert left.columns == docs.columns
    want = [(d, t) for (d, t), b in zip(TEXTS, [brute([x], ITEMS)[0] for x in TEXTS]) if not b[5]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)
    assert D.contamination(docs.where("false"), bench, most_bits=most).count() == 0
    assert {r.n_hit for r in D.contamination(docs, bench.where("false"), most_bits=most).collect()} == {0}


def plain_cut(text, items):
    """The text without the bytes from the first to the last word of each run of hit words."""
    w = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    low = [words(x)[0] for *_, x in w]
    windows = {tuple(words(t)[k : k + min(13, len(words(t)))]) for _, t in items for k in range(len(words(t)) - min(13, len(words(t))) + 1) if words(t)}
    gone = [(w[k][0], w[k + len(x) - 1][1]) for x in windows for k in range(len(low) - len(x) + 1) if tuple(low[k : k + len(x)]) == x]
    return None if text is None else "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in gone))


def test_cut_spans_keep_all_bytes_outside(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).select("*", F.lit(7).alias("_spans"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.cut_spans(docs, bench)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((d, plain_cut(t, ITEMS)) for d, t in TEXTS), key=repr)
    some = {r.text for r in D.cut_spans(docs, bench, contaminated_only=True).collect()}
    assert "zero  sixteen" in some and D.cut_spans(docs.where("false"), bench).count() == 0


def test_kept_names_may_be_any(spark):
    docs = spark.createDataFrame([(1, "a short item", 5)], "doc_id long, text string, words long")
    got = D.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), keep=["doc_id", "words", "text"]).first()
    assert (got.words, got.text, got.n_hit) == (5, "a short item", 2)


def test_contamination_twin(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(oracles()["op6_decontaminate"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, QUERIES["op6_decontaminate"](spark, data).select(*names).collect())) == sorted(cur.fetchall())
