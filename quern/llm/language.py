"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent character n-grams (1 to 3 letters, words set off by a blank), most
frequent first. A document is compared with each language by the out-of-place distance: for each of its n-grams, how far
its rank is from the language's rank, or the whole profile's length where the language lacks it.

Training counts the n-grams of all training texts: each task counts in arrays and hands on one sum for each language and
n-gram, so a language with a third of all rows weighs no more in the shuffle than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, packed_rows, unpacked_rows

PROFILE = 400
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to its lower-case letter's code point, or 0 where it is no letter."""
    if not _tables:
        table = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to 3: 21 bits a letter, a blank beside each word; none without letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one blank for each run
    two = codes[:-1] << 21 | codes[1:]
    return np.concatenate([codes[codes > 0], two, two[:-1] << 21 | codes[2:]])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and how often each occurs."""
    grams = np.sort(grams)
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[at], np.diff(np.append(at, len(grams)))


def profile(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))[:size]]


#: Texts joined before they are counted, in letters; bounds a task's memory.
HELD = 2_000_000


def _count_task(batches):
    names = ["lang", "code", "n"]
    held: dict[str, list[str]] = {}
    size = 0

    def flush():
        for lang, texts in held.items():
            codes, counts = counted(ngrams("\n".join(texts)))
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts.astype(np.int64))], names=names)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > HELD:
                yield from flush()
                held, size = {}, 0
    yield from flush()


class Profiles:
    """Ranks of all languages' n-grams, for many documents."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(by_lang), size
        self.codes = np.unique(np.concatenate([by_lang[x] for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text or "")
        if not len(grams) or not self.langs:
            return "und", 0.0
        own = profile(*counted(grams), self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))  # the first name where two are as near
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def learn_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """A profile of each non-null lang from all texts of docs; `size` n-grams a language come to the driver."""
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInArrow(_count_task, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the best `size` of each of 64 parts of the codes, then of the language: no language's n-grams meet in one sort
    best = lambda *by: F.row_number().over(_window(*by))
    part = counts.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(64)))
    some = part.withColumn("r", best("lang", "part")).where(F.col("r") <= size)
    top = some.withColumn("r", best("lang")).where(F.col("r") <= size).select("lang", "code", "r")
    by_lang: dict[str, list] = {}
    for r in top.collect():
        by_lang.setdefault(r["lang"], []).append((r["r"], r["code"]))
    return Profiles({k: np.array([c for _, c in sorted(v)], np.int64) for k, v in by_lang.items()}, size)


def _window(*by):
    return Window.partitionBy(*by).orderBy(F.desc("n"), "code")


def _predict_task(profiles: Profiles):
    def task(batches):
        for b in batches:
            found = [profiles.predict(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_keep"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["_keep", "lang_pred", "score"])

    return task


def predict_language(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default doc_id), lang_pred and score: 1 for the same ranks, 0 for nothing in common.

    `und` with score 0 for null, for texts without a letter, and if no language has been learned; ties go to the first
    name; repeated rows are predicted alike; a kept column with a result's name gives way to it. Combining marks are no
    letters here and end a word, in training as in prediction.
    """
    rows = packed_rows(docs, keep, text_col)
    found = rows.mapInArrow(_predict_task(profiles), f"_keep {rows.schema['_keep'].dataType.simpleString()}, lang_pred string, score double")
    return unpacked_rows(found, "lang_pred", "score")


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def language_predictions(docs: DataFrame) -> DataFrame:
    """Profiles from the documents that are not held out, predictions for all."""
    marked = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    profiles = learn_profiles(marked.where(~F.col("held_out")))
    return predict_language(marked, profiles, keep=["doc_id", "held_out"])
