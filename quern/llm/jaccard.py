"""N-gram Jaccard join by MinHash banding.

1. Texts become sets of hashed word n-grams. Texts with the same set form one class and go on as one row, so copies are
   never compared with each other.
2. Bands: as many rows and bands of MinHash values as the target recall at the least similarity needs. Classes shuffle on
   their band hashes as two numbers a band. Each bucket ties its classes to its least one, which keeps every class that
   shares a band with another in one candidate component, with as many ties as classes and not as many as pairs.
3. Classes are compared on their full n-gram sets, in blocks: a candidate component, or each band's bucket, is cut into
   chunks of bounded number and size, each pair of chunks is one group of rows, and a group gives back one row a class
   (the documents it links to, and the least class that it is linked with), never its pairs. Which of the two ways sends
   fewer rows is counted for each component: one whole component where its classes share most of their bands, as true
   copies do; its buckets where chance ties many unlike classes into one. A pair that shares several buckets counts in
   that of its first common band alone, so both ways give the same links.
4. The linked classes' components are the near-duplicate classes.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, plain_words, stored, text_bytes
from quern.llm.components import components

N, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9998, 6
#: Classes of a chunk and n-grams that it is meant to hold; a block compares two chunks.
CHUNK, CHUNK_GRAMS = 512, 2_000_000
#: Stands for no id where ids are ordered.
_LAST = 2**63 - 1
#: Distinct n-grams taken at a time when a block is compared.
SLAB = 2048
_WORDS_HELD = 200_000


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` MinHash values with which a pair of this similarity shares one at least with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    new = set(words).difference(_words)
    if len(_words) + len(new) > _WORDS_HELD:
        _words.clear()
        new = set(words)
    digest = xxhash.xxh3_64_intdigest
    _words.update({w: digest(w) for w in new})
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(data: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; a text of fewer words has one n-gram of all, and none if it has no word."""
    words = plain_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return np.unique(_mixed(out + np.uint64(size)))


@functools.cache
def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    a = _multipliers(bands * rows)
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 128):
        np.minimum(least, (grams[at : at + 128, None] * a).min(axis=0), out=least)
    least = _mixed(least).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return out.view(np.int64)


def _class_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signature_task(n: int, bands: int, rows: int):
    def task(batches):
        for b in batches:
            fps, sizes, keys = [], [], []
            for data in text_bytes(b.column(2)):
                grams = shingles(data, n)
                fps.append(_class_of(grams))
                sizes.append(len(grams))
                keys.append(band_keys(grams, bands, rows).tolist() if len(grams) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "fp", "n", "bands"])

    return task


def _shingle_task(n: int):
    """Rows whose text has the wanted class, with the class's n-grams in place of text and class."""

    def task(batches):
        for b in batches:
            grams = [shingles(data, n) for data in text_bytes(b.column("text"))]
            right = pa.array([_class_of(g) == w for g, w in zip(grams, b.column("fp").to_pylist())], pa.bool_())
            cols = [*(b.column(c) for c in ("node", "docs", "bands", "groups")), pa.array([g.tobytes() for g in grams], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "docs", "bands", "groups", "grams"]).filter(right)

    return task


def compare_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean matrix of the links between sets of the two sides; exact, on slabs of n-grams."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    number = np.cumsum(first) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    both = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + SLAB, SLAB))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        m = np.zeros((len(sets), SLAB), np.float32)
        m[owner[a:b], number[a:b] - k * SLAB] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= similarity * union - 1e-6


def _least_linked(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> np.ndarray:
    """For each node, the least one that chains of links lead to."""
    label = nodes.copy()
    while True:
        before = label.copy()
        big = np.iinfo(np.int64).max
        label[a] = np.minimum(label[a], np.where(links, label[b][None, :], big).min(axis=1))
        label[b] = np.minimum(label[b], np.where(links, label[a][:, None], big).min(axis=0))
        if np.array_equal(before, label):
            return label


def earlier_band(left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """Boolean matrix of the pairs that share a band before this one; left and right hold the band keys of each side's rows."""
    out = np.zeros((len(left), len(right)), bool)
    at = int(np.argmax((left == band).all(axis=0)))
    for k in range(at):
        out |= left[:, k][:, None] == right[:, k][None, :]
    return out


def _block_task(similarity: float):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], ignore_index=True)
        i, j, by_band, grp = (int(pdf[c].iloc[0]) for c in ("i", "j", "by_band", "grp"))
        nodes, docs, side = pdf["node"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64), pdf["side"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        a = np.flatnonzero(side == i)
        b = a if i == j else np.flatnonzero(side == j)
        linked = np.zeros(len(nodes), np.int64)
        label = nodes
        if len(a) and len(b):
            links = compare_block(sets, a, b, similarity)
            if by_band:
                keys = np.stack(pdf["bands"].to_numpy())
                links &= ~earlier_band(keys[a], keys[b], grp)
            if i == j:
                np.fill_diagonal(links, False)
                linked[a] += links @ docs[b]
            else:
                linked[a] += links @ docs[b]
                linked[b] += links.T @ docs[a]
            label = _least_linked(nodes, a, b, links)
        return pd.DataFrame({"node": nodes, "label": label, "linked": linked})

    return task


def _parts(count, grams, chunk: int):
    """Chunks for so many classes and n-grams."""
    return F.greatest(F.ceil(count / chunk), F.ceil(grams / CHUNK_GRAMS), F.lit(1)).cast("int")


def comparison_groups(classes: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(node, groups) for each class (node, n, bands) that shares a band with another: the groups it is compared in, as (by_band, grp, parts).

    A group is a candidate component (named by its least class), or one band's bucket (named by its key); parts are its
    chunks. Each class is sent once for each part of its groups.
    """
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size"), F.sum("n").alias("grams")).where("hub < last").drop("last"), "buckets")
    ties = banded.join(buckets.select("band", "hub"), "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    near = components(ties)
    bucket = buckets.withColumn("parts", _parts(F.col("size"), F.col("grams"), chunk))
    by_bucket = bucket.join(near.withColumnRenamed("node", "hub"), "hub").groupBy("component").agg(F.sum(F.col("size") * F.col("parts")).alias("sent"))
    whole = near.join(classes.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("grams")).withColumn("parts", _parts(F.col("size"), F.col("grams"), chunk))
    ways = stored(whole.join(by_bucket, "component").select("component", "parts", (F.col("sent") < F.col("size") * F.col("parts")).alias("split")), "ways")
    group = lambda by_band, name: F.struct(F.lit(by_band).alias("by_band"), F.col(name).alias("grp"), F.col("parts"))
    out = near.join(ways.where("NOT split"), "component").select("node", F.array(group(0, "component")).alias("groups"))
    if ways.where("split").isEmpty():
        return out
    loose = near.join(ways.where("split").select("component"), "component").select("node")
    split = banded.join(loose, "node").join(bucket.select("band", "parts"), "band").groupBy("node").agg(F.collect_list(group(1, "band")).alias("groups"))
    return out.unionByName(split)


def _numbered(classes: DataFrame) -> DataFrame:
    """classes with node, a number for each fingerprint: half of it, or a hash of all of it for halves that two have."""
    half = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    out = stored(classes.withColumn("node", half), "classes")
    twice = out.groupBy("node").agg(F.count("*").alias("n_same")).where("n_same > 1").select("node")
    if twice.isEmpty():
        return out
    return stored(out.join(twice.withColumn("same", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("same"), F.xxhash64("fp")).otherwise(F.col("node"))).drop("same"), "classes")


def _classified(docs: DataFrame, n: int, similarity: float, recall: float, rows: int, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """For each document: doc_id, th (hash of its text), class_id, class_key, copy_of, n_links, and head_id and head_th of the one document that stands for its class."""
    bounded_batches(docs.sparkSession)
    bands = bands_for(similarity, recall, rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signature_task(n, bands, rows), "doc_id long, th long, fp binary, n int, bands array<long>"), "signatures")
    own = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("th"))
    classes = _numbered(signed.where("n > 0").groupBy("fp").agg(F.min(own).alias("own"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    wanted = classes.join(comparison_groups(classes, chunk=chunk), "node").select(F.col("own.id").alias("_id"), F.col("own.th").alias("_th"), "fp", "node", "docs", "bands", "groups")
    with_text = texts.join(wanted, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "fp", "node", "docs", "bands", "groups")
    sets = with_text.mapInArrow(_shingle_task(n), "node long, docs long, bands array<long>, groups array<struct<by_band:int,grp:bigint,parts:int>>, grams binary")
    # a repeated row gives a class more than once
    one = sets.dropDuplicates(["node"]).withColumn("g", F.explode("groups")).select("node", "docs", "grams", F.when(F.col("g.by_band") == 1, F.col("bands")).alias("bands"), "g.*")
    sides = one.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = sides.select("by_band", "grp", F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "node", "docs", "bands", "grams")
    found = stored(blocks.groupBy("by_band", "grp", "i", "j").applyInPandas(_block_task(similarity), "node long, label long, linked long"), "links")
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = components(found.select(F.col("node").alias("u"), F.col("label").alias("v")))
    heads = classes.select("node", "own").join(groups, "node").groupBy("component").agg(F.min("own").alias("head"))
    by_node = linked.join(groups, "node", "left").join(heads, "component", "left").select("node", "linked", "component", "head")
    by_class = classes.select("fp", "own", "docs", "node").join(by_node, "node", "left").select(
        "fp", F.coalesce("head", "own").alias("head"), F.coalesce("component", "node").alias("class_key"), "own", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("linked")
    )
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    lone = F.col("n") == 0
    return signed.select("doc_id", "th", "fp", "n").join(by_class, "fp", "left").select(
        "doc_id",
        "th",
        F.when(lone, F.col("doc_id")).otherwise(known("head.id")).alias("class_id"),
        "class_key",
        F.when(lone, F.col("doc_id")).otherwise(known("own.id")).alias("copy_of"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
        F.when(lone, F.coalesce("doc_id", F.lit(_LAST))).otherwise(F.col("head.id")).alias("head_id"),
        F.when(lone, F.col("th")).otherwise(F.col("head.th")).alias("head_th"),
    )


def near_duplicates(docs: DataFrame, *, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, class_id, copy_of, n_links, class_key.

    class_id: least doc_id of the documents that chains of links lead to, itself included; copy_of: least doc_id of the
    documents with the same n-gram set; both are null if none of them has an id. n_links: other documents whose n-gram
    sets have this Jaccard similarity or more. class_key: a number of the class, whether its documents have ids or not.
    Texts without words (null, empty) are alone in a class and have no class_key; repeated rows count as documents of one
    class; an empty table gives no rows. Components that don't settle in 50 rounds raise an error.
    """
    return _classified(docs, n, similarity, recall, rows, id_col, text_col, chunk).select("doc_id", "class_id", "copy_of", "n_links", "class_key")


def one_of_each(docs: DataFrame, *, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with one document of each near-duplicate class: that of the least id, those without an id last and by a hash of their text.

    Of rows with the same id and text one stays, and so does each different text without words under its id.
    """
    found = _classified(docs, n, similarity, recall, rows, id_col, text_col, chunk)
    heads = found.where((F.coalesce("doc_id", F.lit(_LAST)) == F.col("head_id")) & F.col("th").eqNullSafe(F.col("head_th"))).select("head_id", "head_th").distinct()
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)) == heads["head_id"]) & (F.xxhash64(text_col) == heads["head_th"])
    return docs.join(heads, same, "left_semi").dropDuplicates([id_col, text_col]).select(*(F.col(f"`{c}`") for c in docs.columns))
