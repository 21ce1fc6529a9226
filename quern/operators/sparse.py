"""A stored sparse index: postings in blocks of documents, with bounds by which searches skip blocks, changed by segments.

A block is up to BLOCK documents of one task, numbered from 0. A segment is one Parquet folder, sorted by word and block
and cut into files by ranges of these, so that a search reads its words' row groups alone and a frequent word is spread over
files. It has a row for each word and block (the word's documents, counts and places, with the greatest count and the least
length, which bound its scores there) and a row for each block (ids, lengths and the places of documents that are gone).

Adding writes a segment; forgetting writes the affected segments' block rows anew; merging makes one segment of all, without
what is gone. Each change is one row of the table `versions`, whose last row says which folders count, so a reader sees a
change as a whole or not at all. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import word_tokens
from quern.operators.retrieval import K1, B, best_rows, ranked

#: Documents and tokens of a block at most.
BLOCK, BLOCK_TOKENS = 1024, 4_000_000
#: Blocks that a search scores before it has a threshold, words of the queries of one search, and cells of a score matrix.
FIRST_BLOCKS, MOST_TERMS, CELLS = 4, 500_000, 8_000_000

SEGMENT = "term string, block long, n int, max_tf int, min_dl int, docs binary, tfs binary, places binary, ids array<long>, dls array<int>, dead array<int>"
_COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]
_VERSIONS = "version long, segments array<struct<postings string, blocks string>>"

_ASCII = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """As word_tokens() has them."""
    if not text:
        return []
    return (text if text.isascii() else text.lower()).encode().translate(_ASCII).split()


_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _segment_batch(columns: list) -> pa.RecordBatch:
    """A batch of a segment of the first columns; the others are null."""
    nulls = [pa.nulls(len(columns[0]), k) for k in _KINDS[len(columns) :]]
    return pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=False)), *nulls], names=_COLUMNS)


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Runs of numbers, each from its begin to the next, as bytes."""
    offsets = np.append(begins, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of bytes, one row's after the other's, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _places(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Runs of numbers as bytes, two for each number of a run that has none of 65,536 or more, else four."""
    begins = begins.astype(np.int64)
    wide = np.maximum.reduceat(values, begins) >= 1 << 16
    if not wide.any() or wide.all():
        return _binary(values.astype(np.uint32 if wide.any() else np.uint16), begins)
    return pa.array([r.astype(np.uint32 if w else np.uint16).tobytes() for r, w in zip(np.split(values, begins[1:]), wide, strict=True)], pa.binary())


def _placed(column: pa.Array, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The numbers of _places(), for rows of n documents and their counts."""
    sizes = _numbers(column, np.uint8)[1]
    wide = sizes > 2 * np.add.reduceat(tf.astype(np.int64), _begins(n)) if len(n) else np.zeros(0, bool)
    if not wide.any() or wide.all():
        return _numbers(column, np.uint32 if wide.any() else np.uint16)[0].astype(np.uint32)
    return np.concatenate([np.frombuffer(x, np.uint32 if w else np.uint16).astype(np.uint32) for x, w in zip(column.to_pylist(), wide, strict=True)])


def _posting_batch(terms: pa.Array, block, rows: np.ndarray, doc: np.ndarray, tf: np.ndarray, place: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    """Postings of terms whose entries (document, count, length) begin at `rows`; places are as many as the counts."""
    n = np.diff(np.append(rows, len(doc)))
    blocks = pa.array(np.full(len(terms), block) if np.isscalar(block) else block, pa.int64())
    columns = [terms, blocks, n.astype(np.int32), np.maximum.reduceat(tf, rows).astype(np.int32), np.minimum.reduceat(dl, rows).astype(np.int32)]
    return _segment_batch([*columns, _binary(doc.astype(np.uint16), rows), _binary(tf.astype(np.uint32), rows), _places(place, _begins(tf)[rows])])


def _postings(block: int, words: pa.Array, term: np.ndarray, doc: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Rows of a block's words; the three arrays have an entry for each token, in order of document and place."""
    order = np.argsort(term, kind="stable")
    term, doc, place = term[order], doc[order], place[order]
    begin = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))
    tf = np.diff(np.append(begin, len(term)))
    t, d = term[begin], doc[begin]
    rows = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    return _posting_batch(words.take(pa.array(t[rows])), block, rows, d, tf, place, lengths[d])


def _build_task(salt: int, most: int):
    """(chunk_id, text) to a segment's rows; rows without an id are left out."""

    def flushed(block: int, ids: list[int], docs: list[np.ndarray], words: dict[bytes, int]):
        lengths = np.array([len(d) for d in docs], np.int32)
        total = int(lengths.sum())
        one = [pa.nulls(1, k) for k in _KINDS[2:8]]
        yield _segment_batch([pa.nulls(1, pa.string()), [block], *one, [ids], [lengths.tolist()], [[]]])
        if total:
            place = np.arange(total) - np.repeat(_begins(lengths), lengths)
            yield _postings(block, pa.array([w.decode() for w in words], pa.string()), np.concatenate(docs), np.repeat(np.arange(len(ids)), lengths), place, lengths)

    def task(batches):
        number = salt << 44 | TaskContext.get().partitionId() << 22
        ids, docs, words, size = [], [], {}, 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None:
                    continue
                tokens = tokens_of(text)
                for w in set(tokens).difference(words):
                    words[w] = len(words)
                ids.append(i)
                docs.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
                if len(ids) >= most or size >= BLOCK_TOKENS:
                    yield from flushed(number, ids, docs, words)
                    number, ids, docs, words, size = number + 1, [], [], {}, 0
        if ids:
            yield from flushed(number, ids, docs, words)

    return task


@dataclass(frozen=True)
class SparseIndex:
    """One version of a stored index; later changes don't show in it."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[tuple[str, str], ...]

    def postings(self) -> DataFrame:
        """(term, block, n, max_tf, min_dl, docs, tfs, places)"""
        return self._read([p for p, _ in self.segments]).where("term IS NOT NULL").select(*_COLUMNS[:8])

    def blocks(self) -> DataFrame:
        """(block, ids, dls, dead)"""
        return self._read([b for _, b in self.segments]).where("term IS NULL").select("block", "ids", "dls", "dead")

    def _read(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(SEGMENT)
        return reader.parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], SEGMENT)

    def totals(self) -> tuple[int, float]:
        """Number and mean length of the documents that are there."""
        gone = F.aggregate("dead", F.lit(0).cast("long"), lambda s, i: s + F.get("dls", i))
        sums = self.blocks().select((F.size("ids") - F.size("dead")).alias("n"), (F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x) - gone).alias("dl"))
        n, dl = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return n, dl / n if n else 0.0

    def vocabulary(self) -> DataFrame:
        """(term, df, occurrences) of the documents that are there."""
        gone = self.blocks().where(F.size("dead") > 0).select("block", "dead")

        @F.pandas_udf("n long, occurrences long")
        def live(docs: pd.Series, tfs: pd.Series, dead: pd.Series) -> pd.DataFrame:
            rows = []
            for d, t, g in zip(docs, tfs, dead, strict=True):
                some = np.ones(len(d) // 2, bool) if g is None else ~np.isin(np.frombuffer(d, np.uint16), g)
                rows.append((int(some.sum()), int(np.frombuffer(t, np.uint32)[some].sum())))
            return pd.DataFrame(rows, columns=["n", "occurrences"])

        counts = self.postings().join(gone, "block", "left").select("term", live("docs", "tfs", "dead").alias("x"))
        return counts.groupBy("term").agg(F.sum("x.n").alias("df"), F.sum("x.occurrences").alias("occurrences")).where("df > 0")

    def counted(self, rows: DataFrame) -> DataFrame:
        """Postings with n counted without what is gone."""
        gone = self.blocks().where(F.size("dead") > 0).select("block", "dead")
        if gone.isEmpty():
            return rows

        @F.pandas_udf("int")
        def here(docs: pd.Series, dead: pd.Series) -> pd.Series:
            return pd.Series([int((~np.isin(np.frombuffer(a, np.uint16), b)).sum()) for a, b in zip(docs, dead, strict=True)], dtype="int32")

        some = rows.join(gone, "block").withColumn("n", here("docs", "dead")).drop("dead")
        return rows.join(gone, "block", "left_anti").unionByName(some)


def open_index(spark: SparkSession, path: str) -> SparseIndex:
    """The newest version."""
    last = spark.read.schema(_VERSIONS).parquet(f"{path}/versions").orderBy(F.desc("version")).first()
    return SparseIndex(spark, path, last["version"], tuple((s["postings"], s["blocks"]) for s in last["segments"]))


def _committed(spark: SparkSession, path: str, version: int, segments: list[tuple[str, str]]) -> SparseIndex:
    spark.createDataFrame([(version, segments)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return SparseIndex(spark, path, version, tuple(segments))


def _written(rows: DataFrame, path: str) -> str:
    """A segment's folder; its rows are kept meanwhile, as the ranges are found from a sample of them."""
    name = f"segment-{uuid.uuid4().hex}"
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{path}/{name}")
    finally:
        rows.unpersist()
    return name


def _segment(docs: DataFrame, path: str, version: int, most: int) -> str:
    rows = docs.select(F.col("chunk_id").cast("long"), "text").mapInArrow(_build_task(version, most), SEGMENT)
    return _written(rows, path)


def create(docs: DataFrame, path: str, *, most: int = BLOCK) -> SparseIndex:
    """An index of (chunk_id, text), ids being different, in a new folder; null texts have no words."""
    name = _segment(docs, path, 1, most)
    return _committed(docs.sparkSession, path, 1, [(name, name)])


def add(index: SparseIndex, docs: DataFrame, *, most: int = BLOCK) -> SparseIndex:
    """Documents whose ids are not there yet."""
    name = _segment(docs, index.path, index.version + 1, most)
    return _committed(index.spark, index.path, index.version + 1, [*index.segments, (name, name)])


def _without(index: SparseIndex, ids: DataFrame) -> list[tuple[str, str]]:
    """Segments without the given (chunk_id); only those that hold one of them get new block rows."""
    out = []
    gone = ids.select(F.col("chunk_id").cast("long").alias("id")).distinct()
    for postings, blocks in index.segments:
        own = index._read([blocks]).where("term IS NULL")
        hits = own.select("block", F.posexplode("ids").alias("at", "id")).join(gone, "id", "left_semi").groupBy("block").agg(F.collect_set("at").alias("gone"))
        changed = own.join(hits, "block", "left")
        if hits.isEmpty():
            out.append((postings, blocks))
            continue
        name = f"blocks-{uuid.uuid4().hex}"
        dead = F.when(F.col("gone").isNull(), F.col("dead")).otherwise(F.array_sort(F.array_union("dead", "gone")))
        changed.withColumn("dead", dead).select(*_COLUMNS).write.parquet(f"{index.path}/{name}")
        out.append((postings, name))
    return out


def forget(index: SparseIndex, ids: DataFrame) -> SparseIndex:
    """Without the documents (chunk_id); those that aren't there are no error."""
    return _committed(index.spark, index.path, index.version + 1, _without(index, ids))


def replace(index: SparseIndex, docs: DataFrame, *, most: int = BLOCK) -> SparseIndex:
    """Documents take the place of those of the same ids, in one step."""
    kept = _without(index, docs)
    name = _segment(docs, index.path, index.version + 1, most)
    return _committed(index.spark, index.path, index.version + 1, [*kept, (name, name)])


def _moved_task(batches):
    """Blocks, each with where its documents go (to, moved; -1: nowhere) and before its postings: these under the new numbers."""
    to, moved, dls = None, None, None
    for b in batches:
        kind = b.column(1).to_numpy()
        block = b.column(0).to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(kind)], strict=True):
            part = b.slice(begin, end - begin)
            if not part.num_rows:
                continue
            if kind[begin] == 0:
                to, moved, dls = part.column(2)[0].as_py(), np.array(part.column(3)[0].as_py()), np.array(part.column(4)[0].as_py())
                continue
            doc, n = _numbers(part.column(6), np.uint16)
            tf, _ = _numbers(part.column(7), np.uint32)
            place = _placed(part.column(8), n, tf)
            row = np.repeat(np.arange(len(n)), n)
            some = moved[doc] >= 0
            if some.any():
                row, own = row[some], doc[some]
                rows = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                yield _posting_batch(part.column(5).take(pa.array(row[rows])), to, rows, moved[own], tf[some], place[np.repeat(some, tf)], dls[own])


def _joined_task(batches):
    """Neighbouring rows of one word and block, in order of their first documents, as one."""
    held: list[pa.RecordBatch] = []

    def joined(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        column = [t.column(k).chunk(0) for k in range(8)]
        term, block = column[0].dictionary_encode().indices.to_numpy(), column[1].to_numpy()
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        doc, n = _numbers(column[5], np.uint16)
        tf, _ = _numbers(column[6], np.uint32)
        place = _placed(column[7], n, tf)
        at = _begins(n)[first]
        out = _posting_batch(column[0].take(pa.array(first)), block[first], at, doc, tf, place, np.zeros(len(doc), np.int64))
        least = np.minimum.reduceat(column[4].to_numpy(), first)
        return out.set_column(4, "min_dl", pa.array(least, pa.int32()))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        if t.num_rows < 5000:
            continue
        term, block = t.column(0), t.column(1).to_numpy()
        last = t.num_rows - 1
        cut = last
        while cut > 0 and block[cut - 1] == block[last] and term[cut - 1] == term[last]:
            cut -= 1
        if cut:
            yield joined(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield joined(pa.Table.from_batches(held))


def merge(index: SparseIndex, *, most: int = BLOCK, groups: int = 64) -> SparseIndex:
    """All segments as one: small blocks are put together and what is gone is left out. Searches find the same before and after."""
    spark = index.spark
    at = F.sequence(F.lit(0), F.size("ids") - 1)
    live = F.filter(F.transform(at, lambda i: F.when(~F.array_contains("dead", i), i)), lambda i: i.isNotNull())
    blocks = index.blocks().where(F.size("ids") > 0).withColumn("live", live).where(F.size("live") > 0)
    part = F.pmod(F.xxhash64("block"), F.lit(groups))
    before = F.coalesce(F.sum(F.size("live")).over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a new block takes the old ones that begin within its share of the running count; half of `most` leaves room for the last
    share = most // 2
    placed = blocks.withColumn("part", part).withColumn("before", before).withColumn("turn", F.expr(f"before div {share}"))
    small = F.size("live") <= share
    to = F.when(small, F.lit(index.version + 1).cast("long") * (1 << 44) + F.col("part") * (1 << 32) + F.col("turn") * 2).otherwise(F.lit(index.version + 1).cast("long") * (1 << 44) + F.col("part") * (1 << 32) + F.col("turn") * 2 + 1)
    placed = placed.withColumn("to", to)
    first = F.coalesce(F.sum(F.size("live")).over(Window.partitionBy("part", "to").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = placed.withColumn("first", first).withColumn("moved", F.transform(at, lambda i: F.array_position("live", i).cast("int") - 1 + F.when(F.array_contains("live", i), F.col("first")).otherwise(F.lit(0))))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    ways = placed.select("block", F.lit(0).alias("kind"), "to", "moved", "dls", none("term", "string"), *(none(c, "binary") for c in ("docs", "tfs", "places")))
    own = index.postings().select("block", F.lit(1).alias("kind"), none("to", "long"), none("moved", "array<int>"), none("dls", "array<int>"), "term", "docs", "tfs", "places")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = ways.unionByName(own.join(placed.select("block"), "block", "left_semi").select(own.columns)).withColumn("deal", F.xxhash64("block"))
    rows = met.repartition(tasks, "deal").sortWithinPartitions("block", "kind").drop("deal").mapInArrow(_moved_task, SEGMENT)
    sized = rows.repartitionByRange("term", "block").withColumn("from", F.substring("docs", 1, 2))
    # numbers are stored least byte first
    rows_joined = sized.sortWithinPartitions("term", "block", F.reverse("from")).drop("from").mapInArrow(_joined_task, SEGMENT)
    some = placed.select("to", "first", F.transform("live", lambda i: F.get("ids", i)).alias("ids"), F.transform("live", lambda i: F.get("dls", i)).alias("dls"))
    joined = some.groupBy("to").agg(F.array_sort(F.collect_list(F.struct("first", "ids", "dls"))).alias("x"))
    ids, dls = F.flatten("x.ids"), F.flatten("x.dls")
    own = joined.select(none("term", "string"), F.col("to").alias("block"), F.size(ids).alias("n"), none("max_tf", "int"), none("min_dl", "int"), *(none(c, "binary") for c in ("docs", "tfs", "places")), ids.alias("ids"), dls.alias("dls"), F.array().cast("array<int>").alias("dead"))
    # the joined rows lie in their ranges and order already; nothing is kept besides the two exchanges
    name, heads = f"segment-{uuid.uuid4().hex}", f"blocks-{uuid.uuid4().hex}"
    rows_joined.write.option("compression", "zstd").parquet(f"{index.path}/{name}")
    own.select(*_COLUMNS).write.parquet(f"{index.path}/{heads}")
    return _committed(spark, index.path, index.version + 1, [(name, heads)])


def _by_block(task: Callable, names: list[str]):
    """Rows in order of block and kind (0 the block, 1 who asks, 2 postings) to task(ids, dls, allowed, queries, rows) for each block that is asked.

    rows: the words' numbers, how many documents each has, and the numbers in each column of bytes.
    """

    def run(batches):
        ids, dls, allowed, asked, rows, now = None, None, None, None, [], None

        def closed():
            if ids is not None and asked and rows:
                t = pa.Table.from_batches(rows).combine_chunks()
                docs, sizes = _numbers(t.column("docs").chunk(0), np.uint16)
                tfs, _ = _numbers(t.column("tfs").chunk(0), np.uint32)
                places = [_placed(t.column(c).chunk(0), sizes, tfs) for c in names[3:]]
                yield from task(ids, dls, allowed, asked, (t.column("no").to_numpy(), sizes, docs, tfs, *places))

        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if end == begin:
                    continue
                if block[begin] != now:
                    yield from closed()
                    now, ids, asked, rows = block[begin], None, None, []
                part = b.slice(begin, end - begin)
                if kind[begin] == 2:
                    rows.append(part.select(names))
                    continue
                r = part.to_pylist()[0]
                if kind[begin] == 1:
                    asked = r["queries"]
                    continue
                ids, dls = np.array(r["ids"], np.int64), np.array(r["dls"], np.int64)
                allowed = np.ones(len(ids), bool)
                allowed[r["dead"]] = False
                if r["among"] is not None:
                    some = np.zeros(len(ids), bool)
                    some[r["among"]] = True
                    allowed &= some
        yield from closed()

    return run


def _visited(index: SparseIndex, asked: DataFrame, rows: DataFrame, names: list[str], task: Callable, ddl: str, among: DataFrame | None = None) -> DataFrame:
    """What `task` makes of each block of asked (query_id, block), with the rows of postings there."""
    by_block = asked.groupBy("block").agg(F.collect_list("query_id").alias("queries"))
    blocks = index.blocks().join(by_block.select("block"), "block", "left_semi")
    if among is None:
        blocks = blocks.withColumn("among", F.lit(None).cast("array<int>"))
    else:
        ids = blocks.select("block", F.posexplode("ids").alias("at", "chunk_id")).join(among.select(F.col("chunk_id").cast("long")), "chunk_id", "left_semi")
        blocks = blocks.join(ids.groupBy("block").agg(F.collect_set("at").alias("among")), "block", "left").withColumn("among", F.coalesce("among", F.array().cast("array<int>")))
    some = rows.join(by_block.select("block"), "block", "left_semi").select("block", *names)
    parts = [blocks.withColumn("kind", F.lit(0)), by_block.withColumn("kind", F.lit(1)), some.withColumn("kind", F.lit(2))]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    tasks = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by a column of its own: a union of parts that are dealt by block counts as dealt, even if a join in one of them is broadcast after all
    every = every.withColumn("deal", F.xxhash64("block"))
    return every.repartition(tasks, "deal").sortWithinPartitions("block", "kind").mapInArrow(_by_block(task, names), ddl)


def _numbered(index: SparseIndex, words: list[str], rows: DataFrame) -> DataFrame:
    """Postings of these words, which are bounded, with the word's number."""
    number = index.spark.createDataFrame(list(enumerate(words)), "no int, term string")
    if len(words) <= 10:  # Parquet's reader looks for so many values itself
        rows = rows.where(F.col("term").isin(words))
    elif words:
        rows = rows.where(F.col("term").between(words[0], words[-1]))
    return rows.join(F.broadcast(number), "term")


_FOUND = "query_id long, chunk_id long, score double"


def _score_task(by_query: dict[int, list[int]], idf: np.ndarray, avg_dl: float, limit: int, k1: float, b: float, cells: int):
    """The best `limit` documents of a block for each query that asks for it."""

    def task(ids, dls, allowed, asked, rows):
        no, sizes, own, tf = rows
        own, tf, term = own.astype(np.int64), tf.astype(float), np.repeat(no, sizes)
        weights = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dls[own] / avg_dl))
        some = allowed[own]
        own, term, weights = own[some], term[some], weights[some]
        here = np.zeros(len(idf), bool)
        here[no] = True
        out = ([], [], [])
        step = max(1, min(256, cells // max(1, len(ids))))
        for at in range(0, len(asked), step):
            queries = sorted(asked)[at : at + step]
            used = np.unique(np.concatenate([t[here[t]] for t in (np.array(by_query[q], np.int64) for q in queries)]))
            column = np.full(len(idf), -1)
            column[used] = np.arange(len(used))
            w = np.zeros((len(used), len(ids)))
            mine = column[term] >= 0
            w[column[term[mine]], own[mine]] = weights[mine]
            for q in queries:
                t = column[np.array(by_query[q], np.int64)]
                t = t[t >= 0]
                # words in their order, so that equal documents have equal scores
                found = np.zeros(len(ids))
                for c in t:
                    found += w[c]
                at_doc = np.flatnonzero(found > 0)
                best, score = best_rows(found[at_doc], ids[at_doc], lambda k, s=found[at_doc]: s[k], limit)
                out[0].extend([q] * len(best))
                out[1].extend(ids[at_doc[best]].tolist())
                out[2].extend(score.tolist())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    return task


def _words_of(queries: DataFrame, text: str) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("query_id"), word_tokens(F.col(text)).alias("words")).where(F.size("words") > 0)


def bm25(index: SparseIndex, queries: DataFrame, limit: int, *, save, among: DataFrame | None = None, k1: float = K1, b: float = B, first: int = FIRST_BLOCKS, most_terms: int = MOST_TERMS) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25 of queries (query_id, text), as bm25_topk() gives them, from the index alone.

    Bounds of each query and block come from the rows' numbers, without their bodies. The `first` blocks of the greatest
    bounds are scored; of the others only those whose bound reaches the last place found there. `save` writes a table and
    reads it back. among: the (chunk_id) that may be found; lengths and counts are over all documents even so. Queries of
    more than most_terms words in all are answered in parts.
    """
    words = _words_of(queries, "text").select("query_id", F.array_sort(F.array_distinct("words")).alias("words"))
    parts = -(-(words.agg(F.sum(F.size("words"))).first()[0] or 0) // most_terms)
    if parts > 1:
        out = None
        for k in range(parts):
            some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
            found = bm25(index, some, limit, save=save, among=among, k1=k1, b=b, first=first, most_terms=1 << 62)
            out = found if out is None else out.unionByName(found)
        return out
    lists = {r["query_id"]: r["words"] for r in words.collect()}
    every = sorted({w for t in lists.values() for w in t})
    number = {w: i for i, w in enumerate(every)}
    by_query = {q: sorted(number[w] for w in t) for q, t in lists.items()}
    rows = index.counted(_numbered(index, every, index.postings()))
    n, avg_dl = index.totals()
    idf = np.zeros(len(every))
    for r in rows.groupBy("no").agg(F.sum("n").alias("df")).collect():
        idf[r["no"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) if r["df"] else 0.0
    pairs = index.spark.createDataFrame([(q, t, float(idf[t])) for q, own in by_query.items() for t in own], "query_id long, no int, idf double")
    bound = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / avg_dl)) if avg_dl else F.lit(0.0)
    # the bound is a sum in another order than the scores, hence a hair above
    bounds = rows.select("no", "block", "max_tf", "min_dl").join(F.broadcast(pairs), "no").groupBy("query_id", "block").agg((F.sum(bound) * (1 + 1e-9)).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounds = save(bounds.withColumn("place", place))
    score = _score_task(by_query, idf, avg_dl, limit, k1, b, CELLS)
    visit = lambda asked: _visited(index, asked.select("query_id", "block"), rows, ["no", "docs", "tfs"], score, _FOUND, among)
    found = save(visit(bounds.where(F.col("place") <= first)))
    last = ranked(found, ["query_id"], "score", "chunk_id", limit).where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
    rest = bounds.where(F.col("place") > first).join(last, "query_id", "left").where("least IS NULL OR bound >= least")
    return ranked(found.unionByName(visit(rest)), ["query_id"], "score", "chunk_id", limit)


def _phrase_task(phrases: dict[int, list[int]]):
    """(query_id, chunk_id) of a block's documents in which a phrase's words stand side by side."""

    def task(ids, dls, allowed, asked, rows):
        no, sizes, docs, tfs, places = rows
        keys = np.repeat(docs.astype(np.int64), tfs) << 32 | places
        ends = np.cumsum(tfs, dtype=np.int64)[np.cumsum(sizes) - 1]
        at = dict(zip(no.tolist(), np.split(keys, ends[:-1]), strict=True))
        found = ([], [])
        for q in asked:
            begins = sorted((at[no] - k for k, no in enumerate(phrases[q])), key=len)
            left = begins[0]
            for other in begins[1:]:
                left = left[np.isin(left, other, assume_unique=True)]
                if not len(left):
                    break
            docs = np.unique(left >> 32)
            docs = docs[allowed[docs]]
            found[0].extend([q] * len(docs))
            found[1].extend(ids[docs].tolist())
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "chunk_id"])

    return task


def phrases(index: SparseIndex, queries: DataFrame, *, save, among: DataFrame | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """(query_id, chunk_id) of the documents that hold the words of queries (query_id, phrase) side by side; no document is read.

    A block is looked at for a phrase if it has all its words; there, places are met by offset, the rarest word first.
    """
    words = _words_of(queries, "phrase")
    parts = -(-(words.agg(F.sum(F.size("words"))).first()[0] or 0) // most_terms)
    if parts > 1:
        some = lambda k: queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        out = phrases(index, some(0), save=save, among=among, most_terms=1 << 62)
        for k in range(1, parts):
            out = out.unionByName(phrases(index, some(k), save=save, among=among, most_terms=1 << 62))
        return out
    lists = {r["query_id"]: r["words"] for r in words.collect()}
    every = sorted({w for t in lists.values() for w in t})
    number = {w: i for i, w in enumerate(every)}
    rows = _numbered(index, every, index.postings())
    terms = index.spark.createDataFrame([(q, number[w], len(set(t))) for q, t in lists.items() for w in sorted(set(t))], "query_id long, no int, words int")
    have = rows.select("no", "block").join(F.broadcast(terms), "no").groupBy("query_id", "block").agg(F.count("*").alias("here"), F.first("words").alias("words"))
    task = _phrase_task({q: [number[w] for w in t] for q, t in lists.items()})
    asked = save(have.where("here = words").select("query_id", "block"))
    return _visited(index, asked, rows, ["no", "docs", "tfs", "places"], task, "query_id long, chunk_id long", among)
