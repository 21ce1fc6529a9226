"""URL functions on columns: canonical form, host, YouTube and audio forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of tracking parameters, and file endings of audio.
TRACKING = "^(utm_.*|fbclid|gclid|ref|si)$"
AUDIO = r"(?i)\.(mp3|m4a|m4b|aac|ogg|oga|opus|wav|flac)$"
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    """Host and port in lower case, without user information."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host without port and a leading www."""
    return F.regexp_replace(F.regexp_replace(authority(url), r":\d*$", ""), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _decoded(c: Column) -> Column:
    """Each valid %XX decoded, others as they are, and plus signs as blanks."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.url_encode(c), "%7E", "~"), r"\*", "%2A")


def _param(query_: Column, name: str) -> Column:
    return _decoded(F.regexp_extract(query_, rf"(?:^|&){name}=([^&]*)", 1))


def is_youtube_host(h: Column) -> Column:
    return h.rlike(r"^(youtu\.be|([^/]*\.)?youtube(-nocookie)?\.com)$")


def video_id(url: Column) -> Column:
    """The id of a single video, or null."""
    h, p = host(url), path(url)
    on_site = h.rlike(r"^([^/]*\.)?youtube\.com$")
    found = (
        F.when(h == "youtu.be", F.regexp_extract(p, "^/+([^/]+)", 1))
        .when(on_site & p.rlike("^/+watch(/|$)"), _param(query(url), "v"))
        .when(on_site, F.regexp_extract(p, "^/+(?:shorts|live|embed|v)/+([^/]+)", 1))
    )
    return F.when(found.rlike(VIDEO_ID), found)


def youtube_kind(url: Column) -> Column:
    """video, playlist, channel, or null."""
    h, p = host(url), path(url)
    has_list = F.length(_param(query(url), "list")) > 0
    return F.when(
        is_youtube_host(h),
        F.when(video_id(url).isNotNull(), "video").when(p.rlike("^/+(playlist|watch)(/|$)") & has_list, "playlist").when(p.rlike("^/+(@|(channel|c|user)(/|$))"), "channel"),
    )


def is_audio_url(url: Column) -> Column:
    return path(url).rlike(AUDIO)


def is_audio_type(content_type: Column) -> Column:
    t = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return t.startswith("audio/") | t.isin("application/octet-stream", "application/ogg")


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no www., fragment, user information, default port, trailing slashes or tracking parameters; parameters sorted.

    On a YouTube site only v is kept, and short, shorts and live links become watch links.
    """
    s, a, p = scheme(url), F.regexp_replace(authority(url), r"^www\.", ""), path(url)
    a = F.when(s == "http", F.regexp_replace(a, ":80$", "")).when(s == "https", F.regexp_replace(a, ":443$", "")).otherwise(a)
    a = F.regexp_replace(a, ":$", "")
    vid = video_id(url)
    fold = vid.isNotNull() & ~p.rlike("^/+watch(/|$)")
    on_youtube = host(url).rlike(r"^([^/]*\.)?youtube\.com$")
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda x: x != ""),
        lambda x: F.struct(_decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda x: F.when(on_youtube, x["k"] == "v").otherwise(~x["k"].rlike(TRACKING))))
    q = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    plain = F.concat(s, F.lit("://"), a, F.regexp_replace(p, "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(s != "", F.when(fold, F.concat(s, F.lit("://youtube.com/watch?v="), vid)).otherwise(plain))


def normal_listing(url: Column) -> Column:
    """The page that lists a playlist's or channel's videos."""
    kind = youtube_kind(url)
    bare = path(url).rlike("^/+(@[^/]+|(channel|c|user)/+[^/]+)/*$")
    return F.when(kind == "playlist", F.concat(F.lit("https://www.youtube.com/playlist?list="), _param(query(url), "list"))).when((kind == "channel") & bare, F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/videos"))).otherwise(url)


#: Fixed value: what a query must look like to be taken for a domain.
BARE_DOMAIN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9-]+)+$"


def is_bare_domain(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(BARE_DOMAIN)


def normal_domain(text: Column) -> Column:
    """The host of a domain or URL that a user gives, lower case, without www. and a last dot; null if it has no dot."""
    t = F.lower(F.trim(text))
    rest = F.when(F.contains(t, F.lit("://")), F.regexp_replace(t, r"^.*?://", "")).otherwise(t)
    found = F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.|\.+$", "")
    return F.when(F.contains(found, F.lit(".")), found)
