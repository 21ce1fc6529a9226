"""Texts from their sources: routes, feeds and podcasts, caption choice, sections of transcripts, section-wise chunks, PDF text, and places of names."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import groupby
from string import ascii_lowercase

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import url as U
from quern.sources.captions import plain_markup


def fetch_route(url: Column, asked: Column | None = None) -> Column:
    """captions, audio or http: as asked for (audio), else by the URL's shape."""
    own = F.when(F.coalesce(U.youtube_kind(url) == "video", F.lit(False)), "captions").when(U.is_audio_url(url), "audio").otherwise("http")
    return own if asked is None else F.when(asked == "audio", "audio").otherwise(own)


#: Which extractor a content type goes to.
EXTRACTORS = {"text/html": "html", "application/xhtml+xml": "html", "application/pdf": "pdf", "text/plain": "text", "text/markdown": "text"}


def extractor_of(content_type: Column) -> Column:
    """The extractor of a content type, without parameters and whatever its case; null for an unknown one."""
    t = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    pairs = [F.lit(x) for p in EXTRACTORS.items() for x in p]
    return F.create_map(*pairs)[t]


def joined_url(base: Column, ref: Column) -> Column:
    """A reference as an absolute URL, read from the page of `base`."""
    start = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.substring(ref, F.length(own) + 1, F.length(ref))
    full = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), own))

    def step(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))

    # the first part is the empty one before the leading slash; a last . or .. leaves a slash
    parts = F.split(full, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    folder = F.when(full.rlike(r"/\.\.?$"), "/").otherwise("")
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(start, ref))
        .when(ref == "", base)
        .when(own == "", F.concat(site, path, F.when(rest.startswith("#"), F.regexp_extract(base, r"(\?[^#]*)", 1)).otherwise(""), rest))
        .otherwise(F.concat(site, F.array_join(kept, "/"), folder, rest))
    )


def published_at(text: Column) -> Column:
    """A feed's date (with or without a weekday, or ISO) as a UTC timestamp; null for others."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")), F.when(bare.rlike(r"^\d{4}-"), F.try_to_timestamp(bare)))


def _tag(c: Column, name: str) -> Column:
    inner = F.regexp_replace(F.regexp_extract(c, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    text = F.trim(plain_markup(inner))
    return F.when(text != "", text)


def _attribute(c: Column, name: str) -> Column:
    found = plain_markup(F.regexp_extract(c, rf"""(?is)\s{name}=["']([^"']*)""", 1))
    return F.when(found != "", found)


def feed_entries(feeds: DataFrame, by: str, body: str = "body", base: str = "base") -> DataFrame:
    """(by, pos, url, title, published_at) of RSS items and Atom entries with a link, which is made absolute."""
    parts = F.regexp_extract_all(F.col(body), F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), 1)
    i = feeds.select(by, base, F.posexplode(parts).alias("pos", "x"))
    link = F.coalesce(_tag(F.col("x"), "link"), _attribute(F.regexp_extract("x", r"(?is)(<link\b[^>]*>)", 1), "href"))
    date = F.coalesce(_tag(F.col("x"), "pubDate"), _tag(F.col("x"), "published"), _tag(F.col("x"), "updated"))
    out = i.select(by, "pos", joined_url(F.col(base), link).alias("url"), _tag(F.col("x"), "title").alias("title"), published_at(date).alias("published_at"))
    return out.where(F.col("url").isNotNull())


def podcast_items(feeds: DataFrame, by: str, body: str = "body", base: str = "base") -> DataFrame:
    """(by, pos, url, enclosure_url, transcript_url, transcript_type, chapters_url, title): items with sound, or with a transcript and a link.

    Of an item's enclosures the first counts whose type is one of sound, or that has none and ends like a sound file.
    """
    parts = F.regexp_extract_all(F.col(body), F.lit(r"(?is)(<item\b.*?</item>)"), 1)
    i = feeds.select(by, base, F.posexplode(parts).alias("pos", "x"))
    tags = F.regexp_extract_all(F.col("x"), F.lit(r"(?is)(<enclosure\b[^>]*>)"), 1)
    each = F.transform(tags, lambda t: F.struct(_attribute(t, "url").alias("u"), F.coalesce(_attribute(t, "type"), F.lit("")).alias("t")))
    fits = F.filter(each, lambda e: e["u"].isNotNull() & F.when(F.trim(e["t"]) != "", U.is_audio_type(e["t"])).otherwise(U.is_audio_url(joined_url(F.lit("https://x/"), e["u"]))))
    one = lambda name: F.regexp_extract("x", rf"(?is)(<podcast:{name}\b[^>]*>)", 1)
    found = i.select(
        by, "pos", base, F.get(fits, 0)["u"].alias("sound"), _attribute(one("transcript"), "url").alias("transcript"), _attribute(one("transcript"), "type").alias("type"),
        _attribute(one("chapters"), "url").alias("chapters"), _tag(F.col("x"), "link").alias("link"), _tag(F.col("x"), "title").alias("title"),
    )
    target = F.coalesce("sound", F.when(F.col("transcript").isNotNull(), F.col("link")))
    absolute = lambda c: F.when(F.col(c).isNotNull(), joined_url(F.col(base), F.col(c)))
    return found.where(target.isNotNull()).select(
        by, "pos", joined_url(F.col(base), target).alias("url"), absolute("sound").alias("enclosure_url"), absolute("transcript").alias("transcript_url"),
        F.when(F.col("transcript").isNotNull(), F.col("type")).alias("transcript_type"), absolute("chapters").alias("chapters_url"), "title",
    )


def caption_choice(tracks: DataFrame, by: str, languages: list[str], *, automatic: bool = True) -> DataFrame:
    """(by, lang, automatic, fmt) of the track to take: made by hand first, then the languages' order, then base languages, then English; json3 before vtt.

    Tracks have (by, pos, lang, automatic, fmt) in the site's order.
    """
    base = F.substring_index("lang", "-", 1)
    steps = [F.col("lang") == x for x in languages] + [base == x.split("-")[0] for x in languages] + [base == "en"]
    step = F.coalesce(*(F.when(s, i) for i, s in enumerate(steps)))
    form = F.when(F.col("fmt") == "json3", 0).when(F.col("fmt") == "vtt", 1)
    some = tracks.withColumns({"_step": step, "_form": form}).where("_step IS NOT NULL AND _form IS NOT NULL" + ("" if automatic else " AND NOT automatic"))
    order = Window.partitionBy(by).orderBy("automatic", "_step", "pos", "_form")
    return some.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, "lang", "automatic", "fmt")


def listing_videos(entries: DataFrame) -> DataFrame:
    """entries (pos, id, title, timestamp, release_timestamp) that are videos, with url and published_at."""
    at = F.coalesce(F.when(F.col("timestamp") != 0, F.col("timestamp")), F.when(F.col("release_timestamp") != 0, F.col("release_timestamp")))
    return entries.where(F.col("id").rlike(U.VIDEO_ID)).select("pos", F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"), "title", F.timestamp_seconds(at).alias("published_at"))


def normal_chapters(chapters: DataFrame, by: str) -> DataFrame:
    """(by, title, start_s): blank titles are null, equal (start, title) count once."""
    title = F.trim("title")
    return chapters.select(by, F.when(title != "", title).alias("title"), F.col("start_s").cast("double").alias("start_s")).distinct()


def chapter_sections(chapters: DataFrame, segments: DataFrame, lengths: DataFrame, by: str, *, how: str = "podcast") -> DataFrame:
    """(by, title, char_start, char_end, start_s) of chapters (by, title, start_s) over a transcript's segments (by, char_start, start_s) and length (by, body_len).

    A chapter begins with the first segment at or after its time. Past the last segment a podcast's chapter goes to that
    segment, a video's is dropped. Of a video's chapters that begin at one place the last counts; a podcast's sections
    without characters are dropped. What comes before the first chapter is a section without a title. No segments, no
    sections.
    """
    # chapters and segments meet in one order of time: a chapter's place is that of the next segment
    c = chapters.select(by, "start_s", F.lit(0).alias("kind"), "title", F.lit(None).cast("long").alias("char_start"))
    s = segments.select(by, "start_s", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title"), F.col("char_start").cast("long"))
    w = Window.partitionBy(by).orderBy("start_s", "kind", "char_start")
    following = F.first("char_start", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.max("char_start").over(Window.partitionBy(by))
    placed = c.unionByName(s).withColumns({"at": F.coalesce(following, last) if how == "podcast" else following, "some": last}).where("kind = 0 AND some IS NOT NULL AND at IS NOT NULL").select(by, "title", "start_s", "at")
    starts = placed.join(lengths.select(by, "body_len"), by)
    if how != "podcast":
        latest = F.row_number().over(Window.partitionBy(by, "at").orderBy(F.desc("start_s"), F.desc("title")))
        starts = starts.where("at < body_len").withColumn("_r", latest).where("_r = 1").drop("_r")
    first = starts.groupBy(by, "body_len").agg(F.min("at").alias("least")).where("least > 0")
    every = starts.unionByName(first.select(by, F.lit(None).cast("string").alias("title"), F.lit(0.0).alias("start_s"), F.lit(0).cast("long").alias("at"), "body_len"))
    order = Window.partitionBy(by).orderBy("at", F.col("title").asc_nulls_first(), "start_s")
    spans = every.withColumn("char_end", F.coalesce(F.lead("at").over(order), F.col("body_len")).cast("long")).where("char_end > at")
    return spans.select(by, "title", F.col("at").alias("char_start"), "char_end", "start_s")


def transcription(segments: Column) -> Column:
    """A struct (text, offsets) of segments (text, start_s, end_s): in order of time, trimmed, empty ones dropped, a line each.

    offsets: (char_start, start_s) of each, found one after the other in the text.
    """
    trimmed = F.transform(segments, lambda s: F.struct(s["start_s"].alias("start_s"), s["end_s"].alias("end_s"), F.trim(s["text"]).alias("text")))
    some = F.filter(F.array_sort(trimmed), lambda s: F.length(s["text"]) > 0)
    text = F.array_join(F.transform(some, lambda s: s["text"]), "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start:int,start_s:double>>").alias("out"))
    offsets = F.aggregate(some, start, lambda a, s: F.struct((a["at"] + F.length(s["text"]) + 1).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("char_start"), s["start_s"].cast("double").alias("start_s"))).alias("out")), lambda a: a["out"])
    return F.struct(text.alias("text"), offsets.alias("offsets"))


def section_chunks(pages: DataFrame, sections: DataFrame, width: int, *, prepend: bool = True) -> DataFrame:
    """(page_id, ordinal, char_start, char_end, text, section_title) of windows of `width` characters that cross no section.

    Ordinals run over the whole page; a section's title stands before each of its chunks. Pages without sections are cut
    as one.
    """
    n = F.length("body_text")
    own = sections.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "title"))).alias("sections"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("char_start"), n.cast("long").alias("char_end"), F.lit(None).cast("string").alias("title")))
    p = pages.join(own, "page_id", "left").withColumn("sections", F.coalesce("sections", whole))

    def windows(s):
        starts = F.when(s["char_end"] > s["char_start"], F.sequence(s["char_start"], s["char_end"] - 1, F.lit(width).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(starts, lambda a: F.struct(a.alias("char_start"), F.least(a + width, s["char_end"]).alias("char_end"), s["title"].alias("title")))

    each = F.transform(F.flatten(F.transform("sections", windows)), lambda w: F.struct(w["char_start"].alias("char_start"), w["char_end"].alias("char_end"), w["title"].alias("title"), F.substring(F.col("body_text"), (w["char_start"] + 1).cast("int"), (w["char_end"] - w["char_start"]).cast("int")).alias("text")))
    kept = p.select("page_id", F.posexplode(F.filter(each, lambda w: w["text"].rlike(r"\S"))).alias("ordinal", "w"))
    text = F.when(F.lit(prepend) & F.col("w.title").isNotNull() & (F.col("w.title") != ""), F.concat("w.title", F.lit("\n\n"), "w.text")).otherwise(F.col("w.text"))
    return kept.select("page_id", "ordinal", "w.char_start", "w.char_end", text.alias("text"), F.col("w.title").alias("section_title"))


_SMALL = frozenset(ascii_lowercase)
_BLANKS = " \t\r\x0b\x0c"


def is_page_number(line: str) -> bool:
    """A number, or one of how many, after the word page or without it."""
    words = line.lower().split(None, 1)
    rest = words[1] if len(words) == 2 and words[0] == "page" else line.lower()
    counts = rest.replace("of", "/").split("/")
    return len(counts) <= 2 and rest == rest.strip() and all(c.strip().isdecimal() for c in counts)


def _at_edges(lines: list[str], scan: int) -> list[int]:
    """Places of the first and last `scan` lines that have text."""
    full = [i for i, line in enumerate(lines) if line]
    return full if len(full) <= 2 * scan else full[:scan] + full[len(full) - scan :]


def _one_blank(line: str) -> str:
    """Neighbouring blanks as one; a single one stays as it is."""
    out = []
    for blank, run in groupby(line, _BLANKS.__contains__):
        run = "".join(run)
        out.append(" " if blank and len(run) > 1 else run)
    return "".join(out)


def tidy_pages(pages: list[str | None], scan: int, ratio: float, fold: bool) -> str:
    """One document for pdf_text()."""
    bare = [[line.strip() for line in (p or "").split("\n")] for p in pages]
    edges = [_at_edges(lines, scan) for lines in bare]
    seen = Counter(line for lines, at in zip(bare, edges, strict=True) for line in {lines[i] for i in at})
    often = {line for line, n in seen.items() if n >= max(2, math.ceil(ratio * len(pages)))}
    out: list[str] = []
    for page, lines, at in zip(pages, bare, edges, strict=True):
        numbers = {i for i in at if is_page_number(lines[i])}
        for i, line in enumerate((page or "").split("\n")):
            if lines[i] in often or i in numbers:
                continue
            # a word that a hyphen breaks at the end of a line goes on in the next
            if out and out[-1][-1:] == "-" and out[-1][-2:-1] in _SMALL and line[:1] in _SMALL:
                out[-1] = out[-1][:-1] + line
            else:
                out.append(line)
    text = "\n".join(out)
    text = unicodedata.normalize("NFKC", text) if fold else text
    tidy: list[str] = []
    for line in text.split("\n"):
        line = _one_blank(line.rstrip(_BLANKS))
        if line or tidy[-1:] != [""]:
            tidy.append(line)
    return "\n".join(tidy).strip()


def pdf_text(pages: Column, *, scan: int = 3, ratio: float = 0.5, fold: bool = True) -> Column:
    """The text of a document's pages: headers and footers that recur and page numbers at the edges dropped, words joined again over line ends, blanks tidied.

    A line recurs if it is among the first or last `scan` lines of max(2, ratio of the pages) pages. fold: letters take
    their compatibility forms (NFKC).
    """

    @F.pandas_udf("string")
    def tidied(column: pd.Series) -> pd.Series:
        return column.map(lambda p: None if p is None else tidy_pages(list(p), scan, ratio, fold))

    return tidied(pages)


def mention_places(reports: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """(by, surface, nth, char_start, char_end) of reported mentions (by, surface): the nth report is the nth place where it stands; those beyond the last are dropped."""
    n = reports.groupBy(by, "surface").agg(F.count("*").cast("int").alias("n")).where(F.length("surface") > 0)
    # locate() takes its place as a column in SQL alone
    places = F.expr("aggregate(sequence(1, n), named_struct('at', 1, 'out', cast(array() as array<int>)), (a, i) -> if(a.at > 0 AND locate(surface, text, a.at) > 0, named_struct('at', locate(surface, text, a.at) + length(surface), 'out', array_append(a.out, locate(surface, text, a.at) - 1)), named_struct('at', 0, 'out', a.out)), a -> a.out)")
    found = n.join(texts.select(by, "text"), by).select(by, "surface", F.posexplode(places).alias("nth", "char_start"))
    return found.select(by, "surface", "nth", "char_start", (F.col("char_start") + F.length("surface")).alias("char_end"))


_WORD = re.compile(r"\w+")


def _places_task(terms: list[tuple[str, str]]):
    """Occurrences of each (label, pattern) as words of their own, whatever the case; a text's words find the patterns to try."""
    by_word: dict[str, list[tuple[str, str, re.Pattern]]] = {}
    odd: list[tuple[str, str, re.Pattern]] = []
    for label, pattern in terms:
        own = (label, pattern, re.compile(rf"\b{re.escape(pattern)}\b", re.I))
        first = _WORD.match(pattern)
        (by_word.setdefault(first[0].lower(), []) if first else odd).append(own)

    def task(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {w.lower() for w in _WORD.findall(text or "")}
                for label, pattern, regex in [*odd, *(p for w in words & by_word.keys() for p in by_word[w])]:
                    for m in regex.finditer(text or ""):
                        for column, value in zip(out, (key, label, m[0], m.start(), m.end())):
                            column.append(value)
            types = (b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "label", "surface", "char_start", "char_end"])

    return task


def gazetteer_places(docs: DataFrame, terms: DataFrame, *, id_col: str = "page_id", text_col: str = "text", most_terms: int = 200_000) -> DataFrame:
    """(id, label, surface, char_start, char_end) of all places where a term (label, pattern) stands in a text.

    Terms go to every task, most_terms at most, which is checked; a text is split into words once, and only patterns
    whose first word it has are searched for.
    """
    known = [tuple(r) for r in terms.select("label", "pattern").distinct().orderBy("label", "pattern").limit(most_terms + 1).collect()]
    if len(known) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_places_task(known), f"id {kind}, label string, surface string, char_start long, char_end long")
    return found.withColumnRenamed("id", id_col)
