"""Registered queries on texts from their sources, with their SQL twins. Bodies of feeds and captions are put together from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import url as U
from quern.sources import captions as P
from quern.sources import model as M
from quern.sources import texts as T


def _str(c):
    return c.cast("string")


def _video(i):
    return F.concat(F.lit("vid"), F.lpad(_str(i), 8, "0"))


def fetch_routes(spark: SparkSession, d: str) -> DataFrame:
    """Pages, videos and sound files, one in nine asked for as sound."""
    i, bare = F.col("page_id"), F.regexp_replace("url", r"[?#].*$", "")
    url = F.when(i % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), _video(i))).when(i % 4 == 1, F.concat(bare, F.lit(".OGG"))).otherwise(F.col("url"))
    return M.table(spark, d, "pages").select("page_id", T.fetch_route(url, F.when(i % 9 == 0, "audio")).alias("route"))


def extractor_routes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 5
    kind = F.when(i == 0, "text/html; charset=utf-8").when(i == 1, "application/pdf").when(i == 2, " TEXT/Plain ").when(i == 3, "image/png")
    return M.table(spark, d, "pages").select("page_id", T.extractor_of(kind).alias("extractor"))


def audio_types(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 5
    kind = F.when(i == 0, "audio/mpeg").when(i == 1, "Application/Octet-Stream; x=1").when(i == 2, "application/ogg").when(i == 3, "video/mp4")
    return M.table(spark, d, "pages").select("page_id", F.coalesce(U.is_audio_type(kind), F.lit(False)).alias("audio"))


def listing_urls(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    url = F.when(i % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?list=PL"), _str(i))).when(i % 4 == 1, F.concat(F.lit("https://www.youtube.com/@name"), _str(i), F.lit("/"))).when(i % 4 == 2, F.lit("https://www.youtube.com/channel/UC1/shorts")).otherwise(F.col("url"))
    return M.table(spark, d, "pages").select("page_id", U.normal_listing(url).alias("listing"))


def absolute_links(spark: SparkSession, d: str) -> DataFrame:
    """References of seven kinds, read from each page."""
    i = F.col("page_id") % 7
    ref = F.when(i == 0, "a/./b").when(i == 1, "/x/../y").when(i == 2, "../z?w").when(i == 3, "?q=1").when(i == 4, "#f").when(i == 5, "//h.example/z").otherwise("https://o.example/")
    return M.table(spark, d, "pages").select("page_id", T.joined_url(F.col("url"), ref).alias("link"))


def _feeds(spark, d):
    """A feed of three items for each page, one without a link."""
    p, i = M.table(spark, d, "pages"), F.col("page_id")
    item = F.concat(
        F.lit("<rss><item><title><![CDATA[One "), _str(i), F.lit("]]></title><link>/e/"), _str(i), F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:"), F.lpad(_str(i % 60), 2, "0"), F.lit(" GMT</pubDate>"),
        F.lit("<enclosure url='/s/"), _str(i), F.lit(".pdf' type='application/pdf'/><enclosure url='/s/"), _str(i), F.lit(".mp3' type=''/></item>"),
        F.lit("<item><title>Two &amp; a half</title><link>https://o.example/2</link><pubDate>never</pubDate><podcast:transcript url='/t/2.vtt' type='text/vtt'/><podcast:chapters url='c.json'/></item>"),
        F.lit("<item><title>Three</title><enclosure url='https://o.example/3' type='audio/mpeg'/></item></rss>"),
    )
    return p.select("page_id", F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("site"), item.alias("body")).select("page_id", F.concat("site", F.lit("/feed/x.xml")).alias("base"), "body")


def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    f = T.feed_entries(_feeds(spark, d), "page_id")
    return f.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


def podcast_items(spark: SparkSession, d: str) -> DataFrame:
    return T.podcast_items(_feeds(spark, d), "page_id")


def _lines(spark, d):
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"[\r\n<>&]+", " ")).alias("text"))


def vtt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as WebVTT files: a cue a turn, with a tag and an entity in each."""
    cue = F.concat(_str(F.col("turn")), F.lit("\n00:"), F.lpad(_str(F.col("turn") % 60), 2, "0"), F.lit(":05.500 --> 00:59:59.000\n<b>"), "text", F.lit("</b> &amp;\n"))
    body = _lines(spark, d).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n")).alias("body"))
    return P.vtt_cues(body, "conv_id").select("conv_id", "start_s", "text", "char_start")


def json3_lines(spark: SparkSession, d: str) -> DataFrame:
    event = F.struct((F.col("turn") * 1500).alias("tStartMs"), F.array(F.struct(F.lit(" ").alias("utf8")), F.struct(F.col("text").alias("utf8"))).alias("segs"))
    body = _lines(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]).alias("events"))
    files = body.select("conv_id", F.to_json(F.struct("events")).alias("body"))
    return P.json3_lines(files, "conv_id").select("conv_id", "start_s", "text", "char_start")


def _segments(spark, d):
    """Turns as segments of ten seconds, placed one after the other."""
    return P.kept_lines(_lines(spark, d), "conv_id", "turn").select("conv_id", (F.col("turn") * 10.0).alias("start_s"), "char_start", F.length("text").alias("n"))


def _chapters(spark, d):
    c = M.table(spark, d, "conversations").select("conv_id").distinct()
    each = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(s).alias("start_s")) for t, s in (("A", 5.0), (" A ", 5.0), ("B", 15.0), ("C", 16.0), ("  ", 25.0), ("Z", 9000.0))))
    return T.normal_chapters(c.select("conv_id", F.explode(each).alias("x")).select("conv_id", "x.*"), "conv_id")


def _sections(spark, d, how):
    s = _segments(spark, d)
    lengths = s.groupBy("conv_id").agg(F.max(F.col("char_start") + F.col("n")).alias("body_len"))
    return T.chapter_sections(_chapters(spark, d), s, lengths, "conv_id", how=how)


def podcast_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d, "podcast")


def video_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d, "video")


def transcription_result(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments out of order, every fourth blank."""
    text = F.when(F.col("turn") % 4 != 3, F.concat(F.lit(" "), "text")).otherwise("  ")
    segs = _lines(spark, d).groupBy("conv_id").agg(F.collect_list(F.struct(text.alias("text"), F.col("turn").alias("start_s"), (F.col("turn") + 1).alias("end_s"))).alias("s"))
    r = segs.select("conv_id", T.transcription(F.col("s")).alias("r"))
    return r.select("conv_id", F.sha2("r.text", 256).alias("digest"), F.array_join(F.transform("r.offsets", lambda o: _str(o["char_start"])), ",").alias("offsets"))


def caption_choice(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as caption tracks."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    lang = F.when(n % 4 == 0, "en-US").when(n % 4 == 1, "es").when(n % 4 == 2, "de").otherwise("fr-CA")
    fmt = F.when(p % 3 == 0, "json3").when(p % 3 == 1, "vtt").otherwise("srv1")
    t = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), (n * 1_000_000 + p).alias("pos"), lang.alias("lang"), (F.col("l_suppkey") % 2 == 0).alias("automatic"), fmt.alias("fmt"))
    return T.caption_choice(t, "video", ["fr", "de"])


def listing_videos(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    e = M.table(spark, d, "part").select(p.alias("pos"), F.when(p % 3 == 0, _str(p)).otherwise(_video(p)).alias("id"), F.col("p_name").alias("title"), F.when(p % 4 != 0, F.lit(0)).otherwise(p * 1000).cast("long").alias("timestamp"), F.when(p % 5 != 0, p * 2000).cast("long").alias("release_timestamp"))
    return T.listing_videos(e).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a section of a hundred characters, one without a title and one to the end; every fifth has none."""
    p = M.pages(spark, d).select("page_id", "body_text")
    n = F.length("body_text").cast("long")
    span = lambda a, b, t: F.struct(F.lit(t).cast("string").alias("title"), a.cast("long").alias("char_start"), b.cast("long").alias("char_end"))
    a, b = F.least(n, F.lit(100)), F.least(n, F.lit(333))
    s = p.where("page_id % 5 <> 0").select("page_id", F.explode(F.array(span(F.lit(0), a, "Intro"), span(a, b, None), span(b, n, "Rest"))).alias("s")).select("page_id", "s.*").where("char_end > char_start")
    c = T.section_chunks(p, s, 150)
    return c.select("page_id", "ordinal", "char_start", "char_end", "section_title", F.sha2("text", 256).alias("digest"))


def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of a page a turn, with a header and a page number."""
    page = F.concat(F.lit("Some report\n"), "text", F.lit(" word-\nbroken  here "), _str(F.col("turn")), F.lit("\nx "), _str(F.col("turn")), F.lit("\ny "), _str(F.col("turn")), F.lit("\nPage "), _str(F.col("turn")), F.lit(" of 9"))
    pages = _lines(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]).alias("pages"))
    return pages.where(F.size("pages") > 1).select("conv_id", T.pdf_text(F.col("pages")).alias("text")).select("conv_id", F.contains("text", F.lit("Some report")).alias("header"), F.contains("text", F.lit("wordbroken here")).alias("joined"), F.regexp_count("text", F.lit("(?m)^Page \\d+ of 9$")).alias("numbers"))


SURFACES = ("the", "und", "tion")


def mention_places(spark: SparkSession, d: str) -> DataFrame:
    """Three surfaces reported three times for each document."""
    t = M.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    r = t.select("page_id", F.explode(F.array(*(F.lit(s) for s in SURFACES for _ in range(3)))).alias("surface"))
    return T.mention_places(r, t, "page_id")


TERMS = (("word", "the"), ("word", "der"), ("phrase", "licensed under"), ("insult", "Moron"))


def gazetteer_places(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([*TERMS], "label string, pattern string")
    return T.gazetteer_places(M.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"), terms)


QUERIES = {f.__name__: f for f in (fetch_routes, extractor_routes, audio_types, listing_urls, absolute_links, feed_entries, podcast_items, vtt_lines, json3_lines, podcast_sections, video_sections, transcription_result, caption_choice, listing_videos, section_chunks, pdf_pages, mention_places, gazetteer_places)}

_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_DIR = "regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '')"
_LINES = r"c_ AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\r\n<>&]+', ' ', 'g')) AS text FROM conversations)"
_KEPT = f"""{_LINES}, k_ AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM c_ WHERE text <> '') WHERE last IS NULL OR last <> text)"""
_SEGS = f"""{_KEPT}, s_ AS (SELECT conv_id, turn * 10.0 AS start_s, coalesce(sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, len(text) AS n FROM k_),
l_ AS (SELECT conv_id, max(char_start + n) AS body_len, max(char_start) AS last FROM s_ GROUP BY 1),
ch_ AS (SELECT conv_id, title, start_s, body_len, (SELECT min(char_start) FROM s_ WHERE s_.conv_id = l_.conv_id AND s_.start_s >= v.start_s) AS place, last FROM l_, (VALUES ('A', 5.0), ('B', 15.0), ('C', 16.0), (NULL, 25.0), ('Z', 9000.0)) v(title, start_s))"""
_SPANS = """every_ AS (SELECT conv_id, title, start_s, place, body_len FROM b_ UNION ALL SELECT conv_id, NULL, 0.0, 0, any_value(body_len) FROM b_ GROUP BY conv_id HAVING min(place) > 0)
SELECT conv_id, title, place AS char_start, e AS char_end, start_s::DOUBLE AS start_s FROM (SELECT *, coalesce(lead(place) OVER (PARTITION BY conv_id ORDER BY place, title NULLS FIRST, start_s), body_len) AS e FROM every_) WHERE e > place"""


def _places(surfaces: str, extra: str = "") -> str:
    return f"""p_ AS (SELECT doc_id AS page_id, text, unnest(range(1, len(text) + 1)) AS p FROM documents),
f_ AS (SELECT page_id, v.*, p, substring(text, p, len(s)) AS found, CASE WHEN p > 1 THEN substring(text, p - 1, 1) ELSE '' END AS bef, substring(text, p + len(s), 1) AS aft FROM p_ JOIN (VALUES {surfaces}) v(s{extra}) ON lower(substring(text, p, 1)) = lower(substring(s, 1, 1)) AND lower(substring(text, p, len(s))) = lower(s))"""


ORACLES = {
    "fetch_routes": r"SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'audio' WHEN page_id % 4 = 0 THEN 'captions' WHEN page_id % 4 = 1 AND regexp_matches(regexp_replace(url, '[?#].*$', ''), '://[^/]+/?') THEN 'audio' ELSE 'http' END AS route FROM pages",
    "extractor_routes": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' END AS extractor FROM pages",
    "audio_types": "SELECT page_id, page_id % 5 < 3 AS audio FROM pages",
    "listing_urls": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/playlist?list=PL' || page_id WHEN 1 THEN 'https://www.youtube.com/@name' || page_id || '/videos' WHEN 2 THEN 'https://www.youtube.com/channel/UC1/shorts' ELSE url END AS listing FROM pages",
    "absolute_links": f"""WITH x AS (SELECT page_id, {_SITE} AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '([?][^#]*)', 1) AS query FROM pages), y AS (SELECT *, {_DIR} AS dir FROM x)
SELECT page_id, CASE page_id % 7 WHEN 0 THEN site || dir || 'a/b' WHEN 1 THEN site || '/y' WHEN 2 THEN site || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || 'z?w' WHEN 3 THEN site || path || '?q=1' WHEN 4 THEN site || path || query || '#f' WHEN 5 THEN regexp_extract(site, '^[a-z]+:') || '//h.example/z' ELSE 'https://o.example/' END AS link FROM y""",
    "feed_entries": f"""SELECT page_id, 0 AS pos, {_SITE} || '/e/' || page_id AS url, 'One ' || page_id AS title, '2024-01-01 10:00:' || lpad((page_id % 60)::VARCHAR, 2, '0') AS published_at FROM pages
UNION ALL SELECT page_id, 1, 'https://o.example/2', 'Two & a half', NULL FROM pages""",
    "podcast_items": f"""SELECT page_id, 0 AS pos, {_SITE} || '/s/' || page_id || '.mp3' AS url, {_SITE} || '/s/' || page_id || '.mp3' AS enclosure_url, NULL AS transcript_url, NULL AS transcript_type, NULL AS chapters_url, 'One ' || page_id AS title FROM pages
UNION ALL SELECT page_id, 1, 'https://o.example/2', NULL, {_SITE} || '/t/2.vtt', 'text/vtt', {_SITE} || '/feed/c.json', 'Two & a half' FROM pages
UNION ALL SELECT page_id, 2, 'https://o.example/3', 'https://o.example/3', NULL, NULL, NULL, 'Three' FROM pages""",
    "vtt_lines": f"""WITH {_LINES}, k_ AS (SELECT * FROM (SELECT conv_id, turn, text || ' &' AS text, lag(text || ' &') OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM (SELECT conv_id, turn, trim(text) AS text FROM c_)) WHERE last IS NULL OR last <> text)
SELECT conv_id, (turn % 60) * 60 + 5.5::DOUBLE AS start_s, trim(text) AS text, coalesce(sum(len(trim(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM k_""",
    "json3_lines": f"WITH {_KEPT} SELECT conv_id, turn * 1.5::DOUBLE AS start_s, text, coalesce(sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM k_",
    "podcast_sections": f"WITH {_SEGS}, b_ AS (SELECT conv_id, title, start_s, coalesce(place, last) AS place, body_len FROM ch_), {_SPANS}",
    "video_sections": f"WITH {_SEGS}, b_ AS (SELECT conv_id, title, start_s, place, body_len FROM ch_ WHERE place < body_len QUALIFY row_number() OVER (PARTITION BY conv_id, place ORDER BY start_s DESC) = 1), {_SPANS}",
    "transcription_result": f"""WITH {_LINES}, s AS (SELECT conv_id, turn, text, coalesce(sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM c_ WHERE turn % 4 <> 3 AND text <> '')
SELECT conv_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn), '')) AS digest, coalesce(string_agg(place, ',' ORDER BY turn), '') AS offsets FROM (SELECT DISTINCT conv_id FROM c_) LEFT JOIN s USING (conv_id) GROUP BY 1""",
    "caption_choice": """WITH t AS (SELECT l_orderkey AS video, l_linenumber * 1000000 + l_partkey AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'es' WHEN 2 THEN 'de' ELSE 'fr-CA' END AS lang, l_suppkey % 2 = 0 AS automatic, CASE l_partkey % 3 WHEN 0 THEN 'json3' WHEN 1 THEN 'vtt' END AS fmt FROM lineitem)
SELECT video, lang, automatic, fmt FROM t WHERE fmt IS NOT NULL AND lang <> 'es' QUALIFY row_number() OVER (PARTITION BY video ORDER BY automatic, CASE lang WHEN 'de' THEN 1 WHEN 'fr-CA' THEN 2 ELSE 3 END, pos, fmt) = 1""",
    "listing_videos": "SELECT p_partkey AS pos, 'https://www.youtube.com/watch?v=vid' || lpad(p_partkey::VARCHAR, 8, '0') AS url, p_name AS title, strftime(make_timestamp(CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 1000 WHEN p_partkey % 5 <> 0 THEN p_partkey * 2000 END * 1000000), '%Y-%m-%d %H:%M:%S') AS published_at FROM part WHERE p_partkey % 3 <> 0",
    "section_chunks": r"""WITH p AS (SELECT doc_id AS page_id, text, len(text) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT page_id, 'Intro' AS title, 0 AS a, least(n, 100) AS b FROM p WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, NULL, least(n, 100), least(n, 333) FROM p WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, 'Rest', least(n, 333), n FROM p WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, NULL, 0, n FROM p WHERE page_id % 5 = 0),
w AS (SELECT page_id, title, x AS char_start, least(x + 150, b) AS char_end FROM (SELECT *, unnest(range(a, b, 150)) AS x FROM s)),
t AS (SELECT w.*, substring(text, char_start + 1, char_end - char_start) AS body FROM w JOIN p USING (page_id))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY char_start) - 1 AS ordinal, char_start, char_end, title AS section_title, sha256(CASE WHEN title IS NOT NULL THEN title || chr(10) || chr(10) ELSE '' END || body) AS digest FROM t WHERE regexp_matches(body, '\S')""",
    "pdf_pages": "SELECT conv_id, false AS header, true AS joined, 0 AS numbers FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "mention_places": f"""WITH {_places(", ".join(f"('{s}')" for s in SURFACES))}
SELECT page_id, s AS surface, row_number() OVER (PARTITION BY page_id, s ORDER BY p) - 1 AS nth, p - 1 AS char_start, p - 1 + len(s) AS char_end FROM f_ WHERE found = s QUALIFY nth < 3""",
    "gazetteer_places": f"""WITH {_places(", ".join(f"('{s}', '{x}')" for x, s in TERMS), ", label")}
SELECT page_id, label, found AS surface, p - 1 AS char_start, p - 1 + len(s) AS char_end FROM f_ WHERE NOT regexp_matches(bef, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(aft, '[\\p{{L}}\\p{{N}}_]')""",
}
