"""Transcripts: lines with running offsets, sections, WebVTT and json3 captions, gazetteers, feeds, plain text of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_lines(lines: DataFrame, by: str, pos: str, text: str = "text") -> DataFrame:
    """Non-empty lines that differ from the one before, with char_start: each line is followed by one character."""
    w = Window.partitionBy(by).orderBy(pos)
    some = lines.withColumn(text, F.trim(text)).where(F.length(text) > 0)
    changed = some.withColumn("_last", F.lag(text).over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col(text))).drop("_last")
    before = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return changed.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long"))


def section_spans(starts: DataFrame, by: str, body_len: str = "body_len") -> DataFrame:
    """(title, char_start) rows to spans up to the next start or the body's end; empty spans go."""
    w = Window.partitionBy(by).orderBy("char_start", "title")
    return starts.withColumn("char_end", F.coalesce(F.lead("char_start").over(w), F.col(body_len)).cast("long")).where("char_end > char_start")


def tiles(spans: Column, length: Column) -> Column:
    """Whether (char_start, char_end) spans run from 0 to length without gap or overlap."""
    n = F.size(spans)
    joined = F.forall(F.arrays_zip(F.slice(spans, 1, n - 1).alias("a"), F.slice(spans, 2, n).alias("b")), lambda x: x["a"]["char_end"] == x["b"]["char_start"])
    return (n > 0) & (spans[0]["char_start"] == 0) & (F.element_at(spans, -1)["char_end"] == length) & F.when(n > 1, joined).otherwise(True)


def plain_markup(c: Column) -> Column:
    """Text without tags, with the common entities resolved."""
    out = F.regexp_replace(c, "<[^>]*>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def html_text(c: Column) -> Column:
    """Readable text of a page by rules: scripts, styles, comments and navigation dropped, blocks on lines of their own.

    The reader model that picks a page's main part is not reproduced.
    """
    bare = F.regexp_replace(c, r"(?is)<(script|style|nav|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    lined = F.regexp_replace(bare, r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|table|article|section)\b[^>]*>", "\n")
    tidy = F.regexp_replace(plain_markup(lined), r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(tidy, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def html_title(c: Column) -> Column:
    return plain_markup(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def vtt_seconds(c: Column) -> Column:
    """[hh:]mm:ss.mmm to seconds."""
    parts = F.reverse(F.split(F.replace(c, F.lit(","), F.lit(".")), ":"))
    return F.aggregate(F.transform(parts, lambda x, i: x.cast("double") * F.pow(F.lit(60.0), i.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vtt_cues(files: DataFrame, by: str, body: str = "body") -> DataFrame:
    """(by, pos, start_s, text): a WebVTT file's lines with the start of their cue, headers and numbers dropped, then kept_lines."""
    line = files.select(by, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "text"))
    cue = F.when(F.contains("text", F.lit("-->")), vtt_seconds(F.regexp_extract("text", r"^\s*([\d:.,]+)", 1)))
    w = Window.partitionBy(by).orderBy("pos")
    timed = line.withColumn("start_s", F.last(cue, True).over(w))
    words = timed.where(F.col("start_s").isNotNull() & ~F.contains("text", F.lit("-->")) & ~F.col("text").rlike(r"^\s*\d*\s*$"))
    return kept_lines(words.withColumn("text", plain_markup(F.col("text"))), by, "pos")


def json3_lines(files: DataFrame, by: str, body: str = "body") -> DataFrame:
    """(by, pos, start_s, text, char_start) of json3 captions."""
    shape = "struct<events: array<struct<tStartMs: long, segs: array<struct<utf8: string>>>>>"
    events = files.select(by, F.posexplode(F.from_json(body, shape)["events"]).alias("pos", "e"))
    text = F.array_join(F.transform("e.segs", lambda s: s["utf8"]), "")
    return kept_lines(events.select(by, "pos", (F.col("e.tStartMs") / 1000).alias("start_s"), F.replace(text, F.lit("\n"), F.lit(" ")).alias("text")), by, "pos")


def chapter_offsets(chapters: DataFrame, segments: DataFrame, by: str, *, past_end: str = "last") -> DataFrame:
    """Each chapter's char_start: that of the first segment starting at or after it; past the end the last segment's, or none with past_end='drop'."""
    c, s = chapters.alias("c"), segments.alias("s")
    hits = c.join(s, (F.col(f"c.{by}") == F.col(f"s.{by}")) & (F.col("s.start_s") >= F.col("c.start_s")), "left")
    first = hits.groupBy(f"c.{by}", "c.title", "c.start_s").agg(F.min_by("s.char_start", "s.start_s").alias("char_start"))
    if past_end == "drop":
        return first.where("char_start IS NOT NULL")
    last = segments.groupBy(by).agg(F.max("char_start").alias("_last"))
    return first.join(last, by, "left").withColumn("char_start", F.coalesce("char_start", "_last")).drop("_last")


def gazetteer(docs: DataFrame, terms: list[tuple[str, str]], *, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, label, surface, n: how often each (label, word) stands in a text as words of its own, whatever the case."""
    from quern.sources.texts import gazetteer_places

    known = docs.sparkSession.createDataFrame([*terms], "label string, pattern string")
    # places carry the text's own letters; a term is told apart by its label and folded form
    found = gazetteer_places(docs.select(id_col, text_col), known, id_col=id_col, text_col=text_col)
    names = known.select("label", F.lower("pattern").alias("_key"), F.col("pattern").alias("surface"))
    counted = found.groupBy(id_col, "label", F.lower("surface").alias("_key")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(names), ["label", "_key"]).select(id_col, "label", "surface", "n")


def gazetteer_file(spark, path: str) -> DataFrame:
    """label and pattern of a JSON-lines gazetteer; bad lines are skipped."""
    rows = spark.read.schema("label string, pattern string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL AND label IS NOT NULL AND pattern IS NOT NULL").select("label", "pattern")


def feed_items(feeds: DataFrame, by: str, body: str = "body") -> DataFrame:
    """(by, pos, title, link, published, enclosure) of RSS items and Atom entries; items without a link and enclosure are dropped."""
    parts = F.regexp_extract_all(F.col(body), F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), 1)
    i = feeds.select(by, F.posexplode(parts).alias("pos", "x"))
    inner = lambda tag: plain_markup(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    empty = lambda c: F.when(F.trim(c) != "", F.trim(c))
    link = F.coalesce(empty(inner("link")), empty(F.regexp_extract("x", r"""(?is)<link\b[^>]*href=["']([^"']*)""", 1)))
    sound = F.regexp_extract("x", r"""(?is)<enclosure\b[^>]*url=["']([^"']*)""", 1)
    out = i.select(by, "pos", empty(inner("title")).alias("title"), link.alias("link"), F.coalesce(empty(inner("pubDate")), empty(inner("published")), empty(inner("updated"))).alias("published"), empty(sound).alias("enclosure"))
    return out.where("link IS NOT NULL OR enclosure IS NOT NULL")


def repeated_lines(pages: DataFrame, by: str, page: str, text: str, *, scan: int = 3, ratio: float = 0.5) -> DataFrame:
    """(by, line, n_pages): lines among the first or last `scan` of pages that recur on at least max(2, ceil(ratio * pages)) of them."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    zone = F.array_distinct(F.concat(F.slice(lines, 1, scan), F.slice(F.reverse(lines), 1, scan)))
    each = pages.select(by, page, F.explode(F.transform(zone, lambda x: F.trim(x))).alias("line"))
    total = pages.groupBy(by).agg(F.count_distinct(page).alias("pages"))
    n = each.groupBy(by, "line").agg(F.count_distinct(page).alias("n_pages"))
    return n.join(total, by).where(F.col("n_pages") >= F.greatest(F.lit(2), F.ceil(F.lit(ratio) * F.col("pages")))).select(by, "line", "n_pages")
