"""Text functions on columns: tokens, chunks, hashes, surface forms."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing",
    "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most",
    "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over",
    "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your", "yours",
)


def word_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, the analyser of the sparse arm."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def keyword_tokens(c: Column) -> Column:
    """Candidates for keywords: three characters or more, from a letter on, no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9'-]{2,})"), 1), lambda w: ~w.isin(list(STOP_WORDS)))


def fixed_chunks(pages: DataFrame, width: int, *, id_col: str = "page_id", text_col: str = "body_text") -> DataFrame:
    """Windows of `width` characters: page_id, ordinal, char_start, char_end, text; windows of white space alone are left out and give no ordinal."""
    # one pass over the text; a place asked for by number would be walked to from the start each time
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s)(.{{1,{width}}})"), 1)
    windows = F.transform(pieces, lambda t, i: F.struct((i * width).alias("char_start"), (i * width + F.length(t)).alias("char_end"), t.alias("text")))
    kept = F.filter(windows, lambda w: w["text"].rlike(r"\S"))
    return pages.select(id_col, F.posexplode(kept).alias("ordinal", "w")).select(id_col, "ordinal", "w.char_start", "w.char_end", "w.text")


def sentence_chunks(pages: DataFrame, *, target: int = 448, hard_max: int = 512, id_col: str = "page_id", text_col: str = "body_text") -> DataFrame:
    """Sentences gathered up to `target` words a chunk; a sentence of more than `hard_max` words is cut into pieces.

    Words set off by blanks stand for model tokens, which need a vocabulary that is not part of the engine; chunks do not overlap.
    """
    pieces = F.flatten(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)(\S.*?(?:[.!?]+(?=\s|$)|\z))"), 1), lambda s: _cut(s, hard_max)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state, piece):
        n = F.size(F.split(piece, r"\s+"))
        full = (state["n"] > 0) & (state["n"] + n > target)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full | (state["n"] == 0), piece).otherwise(F.concat_ws(" ", state["open"], piece)).alias("open"),
            F.when(full, n).otherwise(state["n"] + n).alias("n"),
        )

    chunks = F.aggregate(pieces, start, add, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return pages.select(id_col, F.posexplode(chunks).alias("ordinal", "text"))


def _cut(sentence: Column, most: int) -> Column:
    words = F.split(F.trim(sentence), r"\s+")
    return F.transform(F.sequence(F.lit(1), F.size(words), F.lit(most)), lambda i: F.array_join(F.slice(words, i, F.lit(most)), " "))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_uuid(page_id: Column, digest: Column, ordinal: Column) -> Column:
    """Name-based UUID (version 5, URL name space) of page:hash:ordinal."""
    name = F.concat_ws(":", page_id.cast("string"), digest, ordinal.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def job_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def purge_key(ids: Column) -> Column:
    """Key of a set of page ids, whatever their order."""
    return job_key("purge", F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 16))


@functools.cache
def _folds(accents: bool):
    """Arrow functions for what has no built-in: full case folding, and with it compatibility forms without accents."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.casefold())

    @F.pandas_udf("string")
    def bare(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(x)))

    return bare if accents else folded


def query_norm(c: Column) -> Column:
    """Runs of blanks as one, none at the ends, case folded."""
    return _folds(False)(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def surface_norm(c: Column) -> Column:
    """Normal form of an entity's name: case folded, compatibility forms without accents, signs to blanks, the last word singular by rule."""
    return singular_last(F.trim(F.regexp_replace(_folds(True)(c), r"[^\p{L}\p{N}]+", " ")))


def singular_last(c: Column) -> Column:
    word = F.regexp_extract(c, r"(\S*)$", 1)
    one = (
        F.when(word.rlike("(ss|us|is)$") | (F.length(word) < 4), word)
        .when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(sh|ch|x|z|ss)es$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )
    return F.concat(F.regexp_replace(c, r"\S*$", ""), one)


def block_key(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length: 0 for equal, 1 if one is empty."""
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def model_slug(prefix: str, model_id: Column, most: int = 48) -> Column:
    """A name for a model's tables: what can stand in a name, and the start of a hash of the whole id."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(model_id, "[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", ""))
    slug = F.when(slug == "", "model").otherwise(F.substring(slug, 1, most))
    return F.concat(F.lit(prefix + "_"), slug, F.lit("_"), F.substring(F.sha2(model_id, 256), 1, 12))
