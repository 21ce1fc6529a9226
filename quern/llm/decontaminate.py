"""Benchmark decontamination: a hash set of the benchmark's word windows, scanned over every window of every document.

All steps are DataFrame functions. The words of a text become an array; each window of 13 words (or of a short item's own
length) becomes one 64-bit hash, and only places whose hash is in the set are ever made into rows. The set is a packed one,
a bitmap with some sixteen bits a window (2 kB to 4 MB), which goes to the tasks as one literal of the plan, for a benchmark
of any size. Its hits are verified by the window's words in a join with the benchmark's windows. Contaminated documents are
dropped, or the hit words are cut out of them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, packed_rows, stored, unpacked_rows

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words and what is between them, in a text whose A-Z have not been lowered.
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Least and most bits of the bitmap, as powers of two. With more windows than it has room for, more places are verified.
LEAST_BITS, MOST_BITS = 14, 25


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; none for null."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: size, hash, key (its words), the sorted ids, as strings, of the items that have it, and owners, a hash of those."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    each = items.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("w"))
    found = each.groupBy("size", F.xxhash64("w").alias("hash"), F.concat_ws(" ", "w").alias("key")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("owners", F.sha2(F.to_json("items"), 256))


def packed_set(windows: DataFrame, *, most_bits: int = MOST_BITS):
    """A function that tells of a hash whether it may be one of the windows', and the windows' sizes (13 at most)."""
    sizes = windows.groupBy("size").agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in sizes)
    bits = min(most_bits, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, n)))))
    longs = [0] * (1 << (bits - 6))
    at = lambda h: F.shiftrightunsigned(h, 64 - (bits - 6)).cast("int")
    place = lambda h: F.pmod(h, F.lit(64)).cast("int")
    for r in windows.groupBy(at(F.col("hash")).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(hash, 64) AS INT))")).alias("x")).collect():
        longs[r["at"]] = r["x"]
    literal = F.from_json(F.lit(json.dumps(longs)), "array<bigint>")
    return lambda h: F.getbit(literal[at(h)], place(h)) == 1, sorted(r["size"] for r in sizes)


def _hits(words: Column, known, sizes: list[int]) -> Column:
    """(at, size, key) of the windows whose hash may be in the set."""

    def of(size: int) -> Column:
        places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
        found = F.filter(places, lambda i: known(F.xxhash64(F.slice(words, i, size))))
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.concat_ws(" ", F.slice(words, i, size)).alias("key")))

    return F.concat(*map(of, sizes)) if sizes else F.array().cast("array<struct<at:int,size:int,key:string>>")


def _covered(spans: Column) -> Column:
    """Words covered by (at, size) spans, each word once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["size"] - 1).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - 1 - F.greatest(s["end"], x["at"] - 1))).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each document: keep (default doc_id), n_words, n_hit, n_items, items (sorted strings), spans and contaminated.

    spans are (at, size) of verified windows, in words from 1. contaminated: some words are hit, and a twentieth or more
    of all. Null and empty texts have no words and are clean, as is everything beside an empty benchmark; items without
    words have no windows; repeated rows are counted on their own; a kept column with a result's name gives way to it.
    """
    windows = stored(benchmark_windows(benchmark, id_col=item_col, text_col=item_text_col, window=window), "windows")
    known, sizes = packed_set(windows, most_bits=most_bits)
    # the row number is made by the scan, whose splits are the same in each attempt of a task
    rows = packed_rows(docs, keep, text_col, F.monotonically_increasing_id().alias("row")).select("row", "_keep", words_of(F.col("_text")).alias("words"))
    hits = rows.select("row", "_keep", F.size("words").cast("long").alias("n_words"), F.explode_outer(_hits(F.col("words"), known, sizes)).alias("h")).select("row", "_keep", "n_words", "h.*")
    verified = hits.join(windows.select("size", "key", "owners"), ["size", "key"], "left")
    span = F.when(F.col("owners").isNotNull(), F.struct("at", "size"))
    # a map side sum leaves one row a task for each document; owners stand for the lists of items, which travel once a document
    by_row = stored(verified.groupBy("row", "_keep", "n_words").agg(F.collect_list(span).alias("spans"), F.collect_set("owners").alias("owners")), "hits")
    lists = windows.select("owners", "items").dropDuplicates(["owners"])
    items = by_row.where(F.size("owners") > 0).select("row", F.explode("owners").alias("owners")).join(lists, "owners").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = by_row.join(items, "row", "left").withColumn("n_hit", _covered(F.col("spans"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return unpacked_rows(out, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of id and text, by which rows are told apart, so that the texts themselves need not meet the verdicts."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(i, t), F.xxhash64(t, F.lit(1), i)]


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    keyed = docs.select(F.col(f"`{text_col}`").alias("text"), *(k.alias(f"_k{n}") for n, k in enumerate(_keys(id_col, text_col))))
    return contamination(keyed, benchmark, keep=["_k0", "_k1"], **options)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated documents; the others stay as they are, whatever their columns are called."""
    bad = _judged(docs, benchmark, id_col, text_col, options).where("contaminated").select("_k0", "_k1").distinct()
    k0, k1 = _keys(id_col, text_col)
    return docs.join(bad, (k0 == bad["_k0"]) & (k1 == bad["_k1"]), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", contaminated_only: bool = False, **options) -> DataFrame:
    """docs with the hit words cut out, from the first word of a run of hit words to the last; all bytes outside stay.

    All documents stay, those without hits as they are; contaminated_only leaves documents below the threshold whole too.
    """
    found = _judged(docs, benchmark, id_col, text_col, options).where("contaminated" if contaminated_only else F.size("spans") > 0)
    spans = found.select(F.col("_k0").alias("_h0"), F.col("_k1").alias("_h1"), F.array_sort("spans").alias("_spans")).dropDuplicates(["_h0", "_h1"])
    k0, k1 = _keys(id_col, text_col)
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), k0.alias("_k0"), k1.alias("_k1"))
    joined = rows.join(spans, (F.col("_k0") == F.col("_h0")) & (F.col("_k1") == F.col("_h1")), "left")
    text = F.col(f"_row.`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit(f"({PIECES})"), 1)
    # words and what is between them take turns: of piece i, the word it is, or the one before it
    first = F.when(pieces[0].rlike(f"^(?:{PIECES.split('|')[0]})$"), 1).otherwise(0)
    word = lambda i: F.floor((i + 1 + first) / 2)
    is_word = lambda i: F.pmod(i + first, F.lit(2)) == 1
    covered = lambda i: F.exists("_spans", lambda s: (s["at"] <= word(i)) & (word(i) + F.when(is_word(i), 0).otherwise(1) < s["at"] + s["size"]))
    cut = F.when(F.col("_spans").isNull(), text).otherwise(F.array_join(F.filter(pieces, lambda x, i: ~covered(i)), ""))
    return joined.select(*((cut if c == text_col else col).alias(c) for c, col in zip(docs.columns, columns)))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), k AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, sz, array_to_string(w[i:i + sz - 1], ' ') AS key
  FROM (SELECT item_id, w, sz, unnest(range(1, len(w) - sz + 2)) AS i FROM (SELECT *, least(len(w), 13) AS sz FROM b WHERE len(w) > 0))
), h AS (
  SELECT doc_id, i, p.sz, item
  FROM (SELECT doc_id, sz, i, array_to_string(w[i:i + sz - 1], ' ') AS key FROM (SELECT doc_id, w, sz, unnest(range(1, len(w) - sz + 2)) AS i FROM d, (SELECT DISTINCT sz FROM k) s WHERE len(w) >= sz)) p
  JOIN k ON p.sz = k.sz AND p.key = k.key
), n AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + sz)) AS pos FROM (SELECT DISTINCT doc_id, i, sz FROM h)) GROUP BY 1
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
