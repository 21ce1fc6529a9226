"""Exact duplicates by a cuckoo-filter index of live digests, from which digests can be deleted again.

The index is dealt to shards by a text's SHA-256, its content address. A shard is a cuckoo filter (16-bit prints of 64-bit
digests, buckets of four slots, two buckets a digest) and the bucketed contents behind it: each slot leads to the address
and length of the text it stands for. A print that is found is a hit only if that address and length are the same. Where a
digest finds no slot, the filter is built anew, twice as large, from the stored keys.

Texts never travel: a task leaves one row for each different text of a block, with all its rows in one list, so that a text
that a third of all rows share is one row for each block. Rows of one shard are taken in, in the order of their ids, by one
task; a shard holds SHARD_KEYS keys on average, whatever the size of the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import packed_rows, stored, text_bytes, unpacked_rows

SLOTS, KICKS, LOAD = 4, 200, 0.85
#: Rows of a block, keys of a shard on average, and the least number of shards.
BLOCK_ROWS, SHARD_KEYS, LEAST_SHARDS = 100_000, 100_000, 512
#: An absent id counts as the least of all.
_LOWEST = -(2**63)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

LOAD_KEY, INSERT, DELETE = 0, 1, 2
_KEYS = "address binary, bytes long, best long, tie long, n long"
_INDEX = f"shard int, filter binary, buckets int, slot int, {_KEYS}"


def _names(ddl: str = _KEYS) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class CuckooFilter:
    """Prints of digests in one of two buckets each; every used slot names the row of its key."""

    def __init__(self, keys: int = 0):
        self.buckets = 4
        while self.buckets * SLOTS * LOAD < keys:
            self.buckets *= 2
        self.prints = np.zeros((self.buckets, SLOTS), np.uint16)
        self.rows = np.full((self.buckets, SLOTS), -1, np.int32)
        #: Rows whose digest is that of more others than two buckets hold; no size of filter would do for them.
        self.stash: list[int] = []
        self._random = np.random.default_rng(7)

    @classmethod
    def of_prints(cls, raw: bytes) -> CuckooFilter:
        """A stored filter, to be asked alone."""
        out = cls()
        out.prints = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS)
        out.buckets, out.rows = len(out.prints), np.zeros(out.prints.shape, np.int32)
        return out

    @staticmethod
    def prints_of(digests: np.ndarray) -> np.ndarray:
        return ((digests >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def first(self, digests: np.ndarray) -> np.ndarray:
        return (digests & np.uint64(self.buckets - 1)).astype(np.int64)

    def other(self, bucket, prints):
        """The second bucket of a print, from either of the two."""
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def hits(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which digest, which row) wherever a print is found; a row may be another's with the same print."""
        prints, one = self.prints_of(digests), self.first(digests)
        two = self.other(one, prints)
        found_i, found_r = [], []
        for at, some in ((one, slice(None)), (two, np.flatnonzero(two != one))):
            i, slot = np.nonzero(self.prints[at[some]] == prints[some][:, None])
            found_i.append(i if isinstance(some, slice) else some[i])
            found_r.append(self.rows[at[found_i[-1]], slot])
        if self.stash:
            found_i.append(np.repeat(np.arange(len(digests)), len(self.stash)))
            found_r.append(np.tile(np.array(self.stash, np.int32), len(digests)))
        return np.concatenate(found_i), np.concatenate(found_r)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digests), bool)
        out[self.hits(digests)[0]] = True
        return out

    def put(self, digests: np.ndarray, rows: np.ndarray) -> bool:
        """Insert all; False if one found no place after KICKS moves, and the filter has to be built anew."""
        prints, at = self.prints_of(digests), self.first(digests)
        left = np.arange(len(digests))
        for second in (False, True):
            bucket = self.other(at[left], prints[left]) if second else at[left]
            order = np.argsort(bucket, kind="stable")
            bucket, left = bucket[order], left[order]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            rank = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.append(begin, len(bucket))))
            used = self.prints[bucket] != 0
            fits = rank < SLOTS - used.sum(axis=1)
            slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.prints[bucket[fits], slot], self.rows[bucket[fits], slot] = prints[left[fits]], rows[left[fits]]
            left = left[~fits]
        return all(self._kick(prints[i], rows[i], int(at[i])) for i in left)

    def _kick(self, mark, row, bucket: int) -> bool:
        for _ in range(KICKS):
            free = np.flatnonzero(self.prints[bucket] == 0)
            slot = int(free[0]) if len(free) else int(self._random.integers(SLOTS))
            out = self.prints[bucket, slot], self.rows[bucket, slot]
            self.prints[bucket, slot], self.rows[bucket, slot] = mark, row
            if len(free):
                return True
            mark, row = out
            bucket = int(self.other(np.int64(bucket), mark))
        return False

    def drop(self, digests: np.ndarray, rows: np.ndarray) -> None:
        """Delete the prints of digests that are there, of exactly these rows."""
        prints, one = self.prints_of(digests), self.first(digests)
        for at in (one, self.other(one, prints)):
            i, slot = np.nonzero(self.rows[at] == rows[:, None])
            self.prints[at[i], slot], self.rows[at[i], slot] = 0, -1
        gone = set(rows.tolist())
        self.stash = [r for r in self.stash if r not in gone]


class Shard:
    """A filter, and the keys that its slots lead to."""

    def __init__(self, digest_bits: int = 64):
        self.mask = np.uint64(2**digest_bits - 1 if digest_bits < 64 else 2**64 - 1)
        self.filter = CuckooFilter()
        self.address = np.zeros(0, "S32")
        self.values = np.zeros((0, 4), np.int64)  # bytes, best, tie, n
        self.live = np.zeros(0, bool)
        self.resized = 0

    def digests(self, address: np.ndarray) -> np.ndarray:
        return np.frombuffer(address.tobytes(), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64) & self.mask

    def load(self, address: np.ndarray, values: np.ndarray, slot: np.ndarray, buckets: int) -> None:
        """Keys of the stored index, each back in its slot."""
        if self.filter.buckets != buckets:
            self.filter = CuckooFilter(buckets * SLOTS * LOAD)
        rows = len(self.address) + np.arange(len(address), dtype=np.int32)
        self._append(address, values)
        at = slot >= 0
        self.filter.prints.reshape(-1)[slot[at]] = CuckooFilter.prints_of(self.digests(address[at]))
        self.filter.rows.reshape(-1)[slot[at]] = rows[at]
        self.filter.stash += rows[~at].tolist()

    def _append(self, address, values) -> None:
        self.address = np.concatenate([self.address, address])
        self.values = np.concatenate([self.values, values])
        self.live = np.concatenate([self.live, np.ones(len(address), bool)])

    def find(self, address: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The live row of each text, or -1: hits of the filter whose stored content is the same."""
        which, row = self.filter.hits(self.digests(address))
        same = self.live[row] & (self.address[row] == address[which]) & (self.values[row, 0] == length[which])
        out = np.full(len(address), -1)
        out[which[same]] = row[same]
        return out

    def insert(self, address: np.ndarray, values: np.ndarray) -> None:
        # rows of one text in a batch are one; the greatest id stays
        order = np.lexsort((values[:, 2], values[:, 1], address))
        address, values = address[order], values[order].copy()
        begin = np.flatnonzero(np.append(True, address[1:] != address[:-1])) if len(address) else np.zeros(0, int)
        last = np.append(begin[1:], len(address)) - 1
        n = np.add.reduceat(values[:, 3], begin) if len(begin) else values[:, 3]
        address, values = address[last], values[last]
        values[:, 3] = n
        row = self.find(address, values[:, 0])
        old, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        mine, r = self.values[row[old]], row[old]
        later = (values[old, 1] > mine[:, 1]) | ((values[old, 1] == mine[:, 1]) & (values[old, 2] > mine[:, 2]))
        self.values[r[later], 1:3] = values[old[later], 1:3]
        self.values[r, 3] += values[old, 3]
        first = len(self.address)
        self._append(address[new], values[new])
        roomy = self.live.sum() <= self.filter.buckets * SLOTS * LOAD
        if not roomy or not self.filter.put(self.digests(address[new]), np.arange(first, len(self.address), dtype=np.int32)):
            self.resize()

    def resize(self) -> None:
        """Build the filter from the stored keys, larger until all find a place."""
        rows = np.flatnonzero(self.live).astype(np.int32)
        digests = self.digests(self.address[rows])
        # of equal digests no more than two buckets' slots can be in the filter, at any size
        order = np.argsort(digests, kind="stable")
        begin = np.flatnonzero(np.diff(digests[order], prepend=digests[order][:1] + np.uint64(1)))
        rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        crowd = np.zeros(len(rows), bool)
        crowd[order] = rank >= SLOTS // 2
        size = max(self.filter.buckets * SLOTS * LOAD, 1)
        while True:
            size *= 2
            self.resized += 1
            self.filter = CuckooFilter(size)
            if self.filter.put(digests[~crowd], rows[~crowd]):
                break
        self.filter.stash = rows[crowd].tolist()

    def delete(self, address: np.ndarray, length: np.ndarray) -> None:
        """Texts that are not live are no error."""
        row = self.find(address, length)
        row = np.unique(row[row >= 0]).astype(np.int32)
        self.filter.drop(self.digests(self.address[row]), row)
        self.live[row] = False

    def batches(self, shard: int):
        """The shard's filter and its live keys as rows of the index."""
        slot = np.full(len(self.address), -1, np.int32)
        bucket, place = np.nonzero(self.filter.prints)
        slot[self.filter.rows[bucket, place]] = bucket * SLOTS + place
        rows = np.flatnonzero(self.live)
        n = len(rows)
        schema = _names(_INDEX)
        one = lambda k, kind: pa.array([k] * n, kind)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((shard, pa.int32()), (self.filter.prints.tobytes(), pa.binary()), (self.filter.buckets, pa.int32()), (None, pa.int32()), (None, pa.binary()), *[(None, pa.int64())] * 4)], names=schema)
            raw = self.address[rows].tobytes()
            yield pa.RecordBatch.from_arrays([one(shard, pa.int32()), one(None, pa.binary()), one(self.filter.buckets, pa.int32()), pa.array(slot[rows]), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), *(pa.array(self.values[rows, k]) for k in range(4))], names=schema)


def _block_task(names: list[str]):
    """(address, bytes, best, tie, n, rows) for each different text of a block, the row of the greatest id first."""

    def flushed(keep, ids, address, length, tie):
        ids, address, length = np.array(ids, np.int64), np.array(address, "S32"), np.array(length, np.int64)
        order = np.lexsort((~ids, address))
        begin = np.flatnonzero(np.append(True, address[order][1:] != address[order][:-1]))
        ends = np.append(begin, len(ids))
        raw = address[order][begin].tobytes()
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(keep).take(pa.array(order)))
        head = order[begin]
        columns = [pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(length[head]), pa.array(ids[head]), pa.array(np.full(len(head), tie)), pa.array(np.diff(ends).astype(np.int64)), rows]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def task(batches):
        part, block = TaskContext.get().partitionId(), 0
        keep, ids, address, length = [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            keep.append(b.column(0))
            ids += [_LOWEST if i is None else i for i in b.column(1).to_pylist()]
            for t in text_bytes(b.column(2)):
                address.append(hashlib.sha256(t.translate(_LOWER)).digest())
                length.append(len(t))
            if len(ids) >= BLOCK_ROWS:
                yield flushed(keep, ids, address, length, part << 32 | block)
                block += 1
                keep, ids, address, length = [], [], [], []
        if ids:
            yield flushed(keep, ids, address, length, part << 32 | block)

    return task


def content_blocks(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each different text of a block of documents, written once; texts are equal after lower-casing A-Z alone."""
    rows = packed_rows(docs, keep or [id_col], text_col, F.col(id_col).cast("long").alias("_id")).select("_keep", "_id", "_text")
    schema = T.StructType.fromDDL(_KEYS).add("rows", T.ArrayType(rows.schema["_keep"].dataType))
    return stored(rows.mapInArrow(_block_task(schema.names), schema), "blocks")


def _table(b: pa.RecordBatch, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    part = b.slice(rows.start, rows.stop - rows.start)
    values = np.stack([np.array([x or 0 for x in part.column(k).to_pylist()], np.int64) for k in range(3, 7)], axis=1)
    return np.array(part.column(2).to_pylist(), "S32"), values


def _shard_task(digest_bits: int):
    """Rows in order of (shard, kind): what is stored, then what comes in, then what goes; gives the shards as they are after."""

    def task(batches):
        now, held = None, None
        for b in batches:
            shards, kinds = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if end == begin:
                    continue
                if shards[begin] != now:
                    if held is not None:
                        yield from held.batches(now)
                    now, held = int(shards[begin]), Shard(digest_bits)
                address, values = _table(b, slice(begin, end))
                if kinds[begin] == LOAD_KEY:
                    slot, buckets = (b.column(k).slice(begin, end - begin).to_numpy(zero_copy_only=False) for k in (7, 8))
                    held.load(address, values, slot, int(buckets[0]))
                elif kinds[begin] == INSERT:
                    held.insert(address, values)
                else:
                    held.delete(address, values[:, 0])
        if held is not None:
            yield from held.batches(now)

    return task


def _shard(shards: int):
    return F.pmod(F.xxhash64("address"), F.lit(shards)).cast("int").alias("shard")


def _shards_of(index: DataFrame) -> int:
    return int(index.schema["shard"].metadata["shards"])


def _with_shards(index: DataFrame, shards: int) -> DataFrame:
    return index.withMetadata("shard", {"shards": shards})


def changed(index: DataFrame | None, *, insert: DataFrame | None = None, delete: DataFrame | None = None, digest_bits: int = 64) -> DataFrame:
    """The index (None: an empty one) after texts of content_blocks() came in, and after that others went; written as a table.

    A digest that is deleted is no longer live, with all its copies; its text counts as new when it comes again. Shards keep
    their number while an index lives and grow as it does. digest_bits: of a text's digest, for tests of equal digests.
    """
    given = next(x for x in (index, insert, delete) if x is not None)
    shards = _shards_of(index) if index is not None else max(LEAST_SHARDS, given.count() // SHARD_KEYS)
    none = F.lit(None).cast("int")
    parts = []
    if index is not None:
        parts.append(index.where("filter IS NULL").select("shard", F.lit(LOAD_KEY).alias("kind"), *_names(), "slot", "buckets"))
    for rows, kind in ((insert, INSERT), (delete, DELETE)):
        if rows is not None:
            parts.append(rows.select(_shard(shards), F.lit(kind).alias("kind"), *_names(), none.alias("slot"), none.alias("buckets")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    tasks = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(min(tasks, shards), "shard").sortWithinPartitions("shard", "kind", "best", "tie")
    return _with_shards(stored(dealt.mapInArrow(_shard_task(digest_bits), _INDEX), "index"), shards)


def _probe_task(digest_bits: int):
    """Filters first, then the texts asked for, by shard: those whose print is there."""

    digests = Shard(digest_bits).digests

    def task(batches):
        now, held = None, None
        for b in batches:
            shards = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if end == begin:
                    continue
                if shards[begin] != now:
                    now, held = shards[begin], None
                part = b.slice(begin, end - begin)
                if part.column(3)[0].is_valid:
                    held = CuckooFilter.of_prints(part.column(3)[0].as_py())
                    part = part.slice(1)
                if held is not None and part.num_rows:
                    some = pa.array(held.may_hold(digests(np.array(part.column(2).to_pylist(), "S32"))))
                    yield pa.RecordBatch.from_arrays([part.column(2).filter(some)], names=["address"])

    return task


def live_contents(index: DataFrame, blocks: DataFrame, *, digest_bits: int = 64) -> DataFrame:
    """(address, keep_id, group_size) of the texts of content_blocks() that are live; only hits of the filters meet the stored contents.

    A digest that more than a few texts share is in no filter; indexes with such digests are read by their keys alone.
    """
    shards = _shards_of(index)
    asked = blocks.select("address", "bytes").distinct()
    if not index.where("filter IS NULL AND slot < 0").isEmpty():
        maybe = asked
    else:
        filters = index.where("filter IS NOT NULL").select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("address"), "filter")
        probes = asked.select(_shard(shards), F.lit(1).alias("kind"), "address", F.lit(None).cast("binary").alias("filter"))
        tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = filters.unionByName(probes).repartition(min(tasks, shards), "shard").sortWithinPartitions("shard", "kind")
        maybe = dealt.mapInArrow(_probe_task(digest_bits), "address binary").join(asked, "address")
    keys = index.where("filter IS NULL").select("address", "bytes", F.when(F.col("best") != _LOWEST, F.col("best")).alias("keep_id"), F.col("n").alias("group_size"))
    return maybe.join(keys, ["address", "bytes"]).select("address", "keep_id", "group_size")


def exact_groups(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each row's kept columns (default the id) with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are after lower-casing A-Z alone; null counts as empty. Of equal texts the row of the greatest
    id stays, an absent id counts as the least, and of rows that share text and id one stays. An empty table gives no rows.
    """
    blocks = content_blocks(docs, keep=keep, text_col=text_col, id_col=id_col)
    index = changed(None, insert=blocks)
    keys = index.where("filter IS NULL").select("address", F.col("best").alias("_best"), F.col("tie").alias("_tie"), F.col("n").alias("_n"))
    met = blocks.join(keys, "address").select("address", "tie", "_best", "_tie", "_n", F.posexplode("rows").alias("_pos", "_keep"))
    return unpacked_rows(
        met,
        F.when(F.col("_best") != _LOWEST, F.col("_best")).alias("keep_id"),
        F.col("_n").alias("group_size"),
        ((F.col("_pos") == 0) & (F.col("tie") == F.col("_tie"))).alias("kept"),
        F.lower(F.hex("address")).alias("text_sha256"),
    )


#: The contract's rows in DuckDB's SQL.
ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)"""
