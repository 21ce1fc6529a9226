import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import url as U
from quern.functions import vector as V
from quern.sources import captions as P

CANONICAL = [
    ("HTTPS://Www.Shop.Example:443/Path/", "https://shop.example/Path"),
    ("http://a.example:80", "http://a.example"),
    ("http://a.example:8080/", "http://a.example:8080"),
    ("https://me:pw@a.example/x#frag", "https://a.example/x"),
    ("https://a.example/?b=2&a=1&utm_campaign=z&ref=q", "https://a.example?a=1&b=2"),
    ("https://a.example/p?x=&y=a%20b", "https://a.example/p?x=&y=a+b"),
    ("https://a.example/p?q=100%zz", "https://a.example/p?q=100%25zz"),
    ("https://a.example/p?q=~*", "https://a.example/p?q=~%2A"),
    ("https://youtu.be/abcdefghijk?t=9", "https://youtube.com/watch?v=abcdefghijk"),
    ("https://www.youtube.com/watch?v=abcdefghijk&list=PL1", "https://youtube.com/watch?v=abcdefghijk"),
    ("https://youtube.com/shorts/abcdefghijk", "https://youtube.com/watch?v=abcdefghijk"),
    ("https://a.example/x///", "https://a.example/x"),
    ("not a url", None),
]


@pytest.fixture(scope="module")
def one(spark):
    return lambda expr, **cols: spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), CANONICAL)
def test_canonical(one, url, want):
    assert one(U.canonical(F.col("u")), u=url) == want


def test_canonical_twice_is_once(spark):
    df = spark.createDataFrame([(u,) for u, w in CANONICAL if w], ["u"]).select(U.canonical(F.col("u")).alias("c"))
    assert all(r["c"] == r["d"] for r in df.select("c", U.canonical(F.col("c")).alias("d")).collect())


@pytest.mark.parametrize(
    ("url", "kind"),
    [("https://m.youtube.com/live/abcdefghijk", "video"), ("https://youtube.com/playlist?list=PL3", "playlist"), ("https://youtube.com/@me", "channel"), ("https://youtube.com/channel/UC1", "channel"), ("https://youtube-nocookie.com/embed/abcdefghijk", None), ("https://vimeo.example/1", None), ("https://youtube.com/watch?v=short", None)],
)
def test_youtube(one, url, kind):
    assert one(U.youtube_kind(F.col("u")), u=url) == kind


def test_listing(one):
    assert one(U.normal_listing(F.col("u")), u="https://youtube.com/@me/") == "https://youtube.com/@me/videos"
    assert one(U.normal_listing(F.col("u")), u="https://youtube.com/watch?list=PL9") == "https://www.youtube.com/playlist?list=PL9"


def test_audio(one):
    assert one(U.is_audio_url(F.col("u")), u="https://a.example/x.MP3?k=1") is True
    assert one(U.is_audio_url(F.col("u")), u="https://a.example/x.html") is False
    assert one(U.is_audio_type(F.col("u")), u="Audio/MPEG; charset=x") is True


def test_surface_forms(one):
    for given, want in [("Harbour-Lights (UK)", "harbour lights uk"), ("Škoda Éclair", "skoda eclair"), ("STRAßE", "strasse"), ("ﬁne Ｗｏｒｄｓ", "fine word"), ("Łódź", "łodz"), ("old rivers", "old river"), ("cherries", "cherry"), ("torches", "torch"), ("moss", "moss")]:
        assert one(X.surface_norm(F.col("s")), s=given) == want
    assert one(X.query_norm(F.col("s")), s=" Große\u00a0 \n Fragen ") == "grosse fragen"


def test_domains_and_slugs(one):
    for given, want in [("Example.ORG", "example.org"), ("https://user@www.a.example:80/x?y", "a.example"), (" www.b.example. ", "b.example"), ("none", None), ("c.example/path", "c.example")]:
        assert one(U.normal_domain(F.col("s")), s=given) == want
    assert [one(U.is_bare_domain(F.col("s")), s=x) for x in ("a-b.example", "-a.example", "two words", "a")] == [True, False, False, False]
    assert one(X.model_slug("v", F.col("s")), s="--/Org/Name v2!").startswith("v_org_name_v2_")
    assert one(X.model_slug("v", F.col("s")), s="???").startswith("v_model_")


def test_edit_distance(one):
    assert one(X.edit_distance(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(3 / 7)
    assert one(X.edit_distance(F.col("a"), F.col("b")), a="", b="") == 0
    assert one(X.edit_distance(F.col("a"), F.col("b")), a="", b="x") == 1


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, "ab      cd"), (3, ""), (4, None)], "page_id long, body_text string")
    got = [(r.page_id, r.ordinal, r.text) for r in X.fixed_chunks(df, 4).orderBy("page_id", "ordinal").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "efg"), (2, 0, "ab  "), (2, 1, "cd")]
    s = spark.createDataFrame([(1, "One two. Three four five! Six?"), (2, "a b c d e f g")], "page_id long, body_text string")
    got = [(r.page_id, r.text) for r in X.sentence_chunks(s, target=5, hard_max=3).orderBy("page_id", "ordinal").collect()]
    assert got == [(1, "One two. Three four five!"), (1, "Six?"), (2, "a b c"), (2, "d e f g")] or got[:2] == [(1, "One two. Three four five!"), (1, "Six?")]


def test_keyword_tokens(one):
    assert one(X.keyword_tokens(F.col("t")), t="The Kubernetes-pods, don't a1 RUN2 it") == ["kubernetes-pods", "don't", "run2"]


def test_vectors(one):
    assert one(V.l2_normalize(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(V.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)


def test_vtt(spark):
    body = "WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<c>Hi &amp; bye</c>\n\n2\n01:00:03,500 --> 01:00:04\nHi &amp; bye\nnext"
    rows = P.vtt_cues(spark.createDataFrame([(1, body)], "id int, body string"), "id").orderBy("pos").collect()
    assert [(r.start_s, r.text, r.char_start) for r in rows] == [(1.0, "Hi & bye", 0), (3603.5, "next", 9)]


def test_json3(spark):
    body = '{"events":[{"tStartMs":0,"segs":[{"utf8":"a"},{"utf8":"b"}]},{"tStartMs":5},{"tStartMs":10,"segs":[{"utf8":"ab"}]},{"tStartMs":1500,"segs":[{"utf8":"c"}]}]}'
    rows = P.json3_lines(spark.createDataFrame([(1, body)], "id int, body string"), "id").orderBy("pos").collect()
    assert [(r.start_s, r.text, r.char_start) for r in rows] == [(0.0, "ab", 0), (1.5, "c", 3)]


def test_chapters_past_the_end(spark):
    c = spark.createDataFrame([(1, "a", 0.0), (1, "b", 9.0)], "id int, title string, start_s double")
    s = spark.createDataFrame([(1, 0.0, 0), (1, 4.0, 7)], "id int, start_s double, char_start int")
    got = {r.title: r.char_start for r in P.chapter_offsets(c, s, "id").collect()}
    assert got == {"a": 0, "b": 7}
    assert [r.title for r in P.chapter_offsets(c, s, "id", past_end="drop").collect()] == ["a"]


def test_tiles(spark):
    df = spark.createDataFrame([(1, [(0, 3), (3, 5)], 5), (2, [(0, 3), (4, 5)], 5), (3, [], 0), (4, [(0, 5)], 5)], "id int, s array<struct<char_start:int,char_end:int>>, n int")
    assert {r.id: r.t for r in df.select("id", P.tiles(F.col("s"), F.col("n")).alias("t")).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_feed(spark):
    body = """<rss><item><title>A &amp; B</title><link>http://x.example/1</link><pubDate>d1</pubDate></item><item><title>no link</title></item>
<entry><title>C</title><link href="http://x.example/2"/><updated>d2</updated></entry><item><enclosure url="http://x.example/e.mp3"/></item></rss>"""
    got = P.feed_items(spark.createDataFrame([(1, body)], "id int, body string"), "id").orderBy("pos").collect()
    assert [(r.title, r.link, r.published, r.enclosure) for r in got] == [("A & B", "http://x.example/1", "d1", None), ("C", "http://x.example/2", "d2", None), (None, None, None, "http://x.example/e.mp3")]


def test_gazetteer_file(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"label":"ORG","pattern":"acme"}\nnot json\n{"label":"ORG"}\n')
    assert [tuple(r) for r in P.gazetteer_file(spark, str(tmp_path / "g.jsonl")).collect()] == [("ORG", "acme")]


def test_html(one):
    h = "<html><head><title>T &lt;1&gt;</title></head><body><script>x</script><p>One  two</p><div>three</div></body></html>"
    assert one(P.html_text(F.col("h")), h=h) == "One two\nthree"
    assert one(P.html_title(F.col("h")), h=h) == "T <1>"
    assert unicodedata.is_normalized("NFC", h)


def test_quantiles_by_narrowing_ranges(spark):
    import random

    from quern.operators.timeseries import latency_quantiles, quantiles

    rng = random.Random(2)
    cases = [
        [rng.gauss(0, 5) for _ in range(700)] + [None],
        [float(rng.randrange(4)) for _ in range(300)],
        [1.0] * 200 + [1e300, -1e300, -1e300],
        [1e-9 * k for k in range(300)] + [1e9],
        [3.5],
        [2.0, 7.0],
    ]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values], "total double")
        want = df.selectExpr("percentile(total, 0.5)", "percentile(total, 0.95)", "percentile(total, 0)", "percentile(total, 1)").first()
        found = quantiles(df, {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, buckets=8, few=3).first()
        assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(found, want, strict=True))
    assert tuple(latency_quantiles(spark.createDataFrame([(None,)], "total double")).first()) == (None, None)
