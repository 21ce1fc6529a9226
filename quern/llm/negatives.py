"""Hard negatives by threshold joins of anchors with an inverted index that leaves out what suffix norms cover.

Vectors become whole numbers. Rows are held in blocks, dimensions ordered from the block's heaviest on, in groups of GROUP.
Of a row the index holds the groups before the first whose suffix (it and all after) has a norm of at most SUFFIX of the
row's; the suffix stays out of the index, as its part of any score is at most the product of two suffix norms. Rows are
ordered by how many groups they have in the index, so a group's postings are a block's first rows.

A search adds up scores group by group for some anchors at a time and drops rows whose score, with the product of what
remains of both norms, stays below all thresholds. Pairs that are left at the end get their whole score in whole numbers.
Thresholds begin high and are lowered until the windows are full: an anchor's positives block by block, its negatives in
rounds over the index, in which only windows take part that are not full yet.

Anchors are a stated part of the rows and meet the others in blocks; what leaves a task is the first few rows of each window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored

GROUP, SUFFIX = 8, 0.45
#: Rows of an index block and anchors of a block; bytes of anchors that go to every task, else the blocks of both sides are dealt out.
ROWS, ANCHORS, MOST_BYTES = 4096, 256, 64 << 20
#: Rows of results that a task holds before it cuts them to the first few of each window.
HELD = 200_000
#: Thresholds of a search for positives, as shares of the greatest possible score.
SHARES = (0.5, 0.25, 0.1, -2.0)
#: Least score of a negative in each round, over 100 of its positive's.
ROUNDS = (95, 90, 85, 80)
SCALE, WANTED, EVERY, MOVED, LABELS = 256, 5, 100, 7, 10


def usable_rows(rows: DataFrame, *, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): rows that take part, components floored to whole numbers after scaling."""
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~odd)
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * SCALE))
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    found = given.select("vec_id", label.alias("label"), whole.alias("v"))
    short = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < 2.0**62
    found = found.where(short).select("vec_id", "label", F.col("v").cast("array<int>").alias("v"))
    return found.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def _matrix(column) -> np.ndarray:
    """Lists of whole numbers as rows of one matrix, zeros after the shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of each row from each group on; the last column is 0."""
    squares = np.add.reduceat(m.astype(float) ** 2, np.arange(0, m.shape[1], GROUP), axis=1) if m.shape[1] else np.zeros((len(m), 0))
    return np.sqrt(np.pad(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1))))


class Block:
    """The index of some rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray):
        self.dims = np.argsort(-(m.astype(float) ** 2).sum(axis=0), kind="stable")
        m = m[:, self.dims]
        norms = suffix_norms(m)
        ends = (norms > SUFFIX * norms[:, :1]).sum(axis=1)
        order = np.argsort(-ends, kind="stable")
        self.ids, self.labels, self.m, self.norms, self.ends = ids[order], labels[order], m[order], norms[order], ends[order]
        # of each group: how many rows have it in the index
        self.lengths = [int((ends > g).sum()) for g in range(norms.shape[1] - 1)]

    def search(self, asked: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the asked, which row, score): every pair whose score is `least` of the asked one or more."""
        q = _wide(asked, len(self.dims))[:, self.dims] if len(self.dims) else np.zeros((len(asked), 0), np.int32)
        qn, qf = suffix_norms(q), q.astype(float)
        slack = 1e-9 * qn[:, :1] * self.norms[:, 0].max(initial=0.0) + 1e-6
        rows = np.arange(len(self.ids))
        sums = np.zeros((len(q), len(rows)))
        groups = len(self.lengths)
        for g in range(groups):
            k = int(np.searchsorted(rows, self.lengths[g]))
            if k:
                at = slice(g * GROUP, (g + 1) * GROUP)
                sums[:, :k] += qf[:, at] @ self.m[rows[:k], at].T.astype(float)
            if g + 1 in (groups // 2, groups):
                done = np.minimum(g + 1, self.ends[rows])
                may = sums + qn[:, done] * self.norms[rows, done] + slack >= least[:, None]
                some = may.any(axis=0)
                rows, sums = rows[some], sums[:, some]
                may = may[:, some]
        if not groups:
            may = np.broadcast_to(least[:, None] <= 0, sums.shape)
        i, r = np.nonzero(may)
        r = rows[r]
        score = np.concatenate([np.zeros(0, np.int64), *((q[i[k : k + 65536]].astype(np.int64) * self.m[r[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536))])
        ok = score >= least[i]
        return i[ok], r[ok], score[ok]


def first_of_each(keys: tuple, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each key, by greatest score and then least id; in that order."""
    order = np.lexsort((ids, -score, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < n]


_INDEX = "ids binary, labels binary, matrix binary"


def _index_task(rows: int):
    """Blocks of at most `rows` rows."""

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, _matrix(part.column(2)).astype(np.int32))], names=["ids", "labels", "matrix"])

    return task


def _window_task(rows: int):
    """Anchors with their windows (a positive and its score, the least score of a negative) to blocks."""

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                own = np.repeat(np.arange(len(ids)), np.diff(part.column(3).offsets.to_numpy()))
                windows = [part.column(k).flatten().to_numpy().astype(np.int64) for k in (3, 4, 5)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, _matrix(part.column(2)).astype(np.int32), own, *windows)], names=["a_ids", "a_labels", "a_matrix", "own", "pos", "high", "low"])

    return task


def _arrays(r: dict, names: tuple, kind=np.int64) -> list[np.ndarray]:
    return [np.frombuffer(r[n], kind) for n in names]


_FOUND = ["anchor_id", "positive_id", "found_id", "found_score", "high"]


class _Held:
    """What a task has found, cut to the first few of each window from time to time."""

    def __init__(self, n: int):
        self.n, self.parts, self.size = n, [], 0

    def add(self, *columns) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def cut(self) -> None:
        x = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        some = first_of_each((x[0], x[1]), x[3], x[2], self.n)
        self.parts = [tuple(c[some] for c in x)]
        self.size = len(some)

    def batches(self, last: bool = False):
        if self.parts and (last or self.size > HELD):
            self.cut()
            if last or self.size > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in self.parts[0]], names=_FOUND)
                self.parts, self.size = [], 0


def _blocks_met(batches, names: tuple):
    """Pairs of an index block and a block of anchors; a block that comes again, as it does beside each of the anchors', is built once."""
    built, last = None, None
    for b in batches:
        for r in b.to_pylist():
            if r["ids"] != last:
                ids, labels = _arrays(r, ("ids", "labels"))
                built, last = Block(ids, labels, np.frombuffer(r["matrix"], np.int32).reshape(len(ids), -1)), r["ids"]
            a_ids, *rest = _arrays(r, names)
            yield built, np.frombuffer(r["a_matrix"], np.int32).reshape(len(a_ids), -1), a_ids, *rest


def _positives_task(wanted: int):
    """The first rows of an anchor's own label: thresholds are lowered until a block gives enough, and begin where enough better ones are held."""

    def task(batches):
        held, floors = _Held(wanted), {}
        for block, asked, a_ids, a_labels in _blocks_met(batches, ("a_ids", "a_labels")):
            greatest = np.sqrt((asked.astype(float) ** 2).sum(axis=1)) * block.norms[:, 0].max(initial=0.0)
            floor = np.array([floors.get(a, np.nan) for a in a_ids.tolist()])
            left = np.arange(len(a_ids))
            for share in SHARES:
                known = ~np.isnan(floor[left])
                i, r, score = block.search(asked[left], np.where(known, floor[left], share * greatest[left] - (share < 0)))
                i = left[i]
                same = (block.labels[r] == a_labels[i]) & (block.ids[r] != a_ids[i])
                i, r, score = i[same], r[same], score[same]
                full = known | (np.bincount(i, minlength=len(a_ids))[left] >= wanted) | (share < 0)
                done = np.zeros(len(a_ids), bool)
                done[left[full]] = True
                some = np.flatnonzero(done[i])
                some = some[first_of_each((a_ids[i[some]],), score[some], block.ids[r[some]], wanted)]
                held.add(a_ids[i[some]], np.zeros(len(some), np.int64), block.ids[r[some]], score[some], np.zeros(len(some), np.int64))
                enough, first, n = np.unique(i[some], return_index=True, return_counts=True)
                for a, at in zip(a_ids[enough[n == wanted]].tolist(), (first + wanted - 1)[n == wanted].tolist(), strict=True):
                    floors[a] = max(floors.get(a, -np.inf), float(score[some][at]))
                left = left[~full]
                if not len(left):
                    break
            if len(floors) > HELD:
                floors.clear()
            yield from held.batches()
        yield from held.batches(last=True)

    return task


def _negatives_task(wanted: int):
    """The first rows of other labels in each window."""

    def task(batches):
        held = _Held(wanted)
        for block, asked, a_ids, a_labels, own, pos, high, low in _blocks_met(batches, ("a_ids", "a_labels", "own", "pos", "high", "low")):
            least = np.full(len(a_ids), np.inf)
            np.minimum.at(least, own, low.astype(float))
            i, r, score = block.search(asked, least)
            other = block.labels[r] != a_labels[i]
            i, r, score = i[other], r[other], score[other]
            # an anchor's pairs meet its few windows one after the other
            order = np.argsort(own, kind="stable")
            begin, size = np.searchsorted(own[order], np.arange(len(a_ids))), np.bincount(own, minlength=len(a_ids))
            for k in range(int(size.max(initial=0))):
                some = np.flatnonzero(size[i] > k)
                w = order[begin[i[some]] + k]
                inside = (score[some] <= high[w]) & (score[some] >= low[w])
                some, w = some[inside], w[inside]
                keep = first_of_each((w,), score[some], block.ids[r[some]], wanted)
                some, w = some[keep], w[keep]
                held.add(a_ids[i[some]], pos[w], block.ids[r[some]], score[some], high[w])
            yield from held.batches()
        yield from held.batches(last=True)

    return task


def _met(index: DataFrame, anchors: DataFrame, task: Callable, size: int, wanted: int) -> DataFrame:
    """Each block of the index with each block of anchors, and of what is found the first few of each window."""
    pairs = index.crossJoin(F.broadcast(anchors) if size <= MOST_BYTES else anchors)
    found = pairs.mapInArrow(task, ", ".join(f"{c} long" for c in _FOUND))
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted)


def hard_negatives(rows: DataFrame, *, wanted: int = WANTED, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) as the contract has them.

    Rows without an id, a label, a vector or one of its components take no part, nor do vectors whose norm after scaling is
    2^31 or more, as their scores may not fit a long. Of rows that share an id, the one of the greatest label, and then
    the greatest vector, counts. A shorter vector counts as one with zeros after it. Ties go to the least id. An empty
    table, or one without anchors, gives no rows.
    """
    kept = stored(usable_rows(rows, vector_col=vector_col, id_col=id_col, label_col=label_col), "vectors")
    index = stored(kept.select("vec_id", "label", "v").mapInArrow(_index_task(ROWS), _INDEX), "blocks")
    anchors = kept.where(F.col("vec_id") % EVERY == 0)
    none = F.array().cast("array<bigint>")
    size = anchors.agg(F.coalesce(F.sum(4 * F.size("v") + 200), F.lit(0))).first()[0]
    ddl = "a_ids binary, a_labels binary, a_matrix binary, own binary, pos binary, high binary, low binary"
    blocks = lambda df, *windows: df.select("vec_id", "label", "v", *windows).mapInArrow(_window_task(ANCHORS), ddl)
    best = _met(index, blocks(anchors, *(none.alias(c) for c in ("pos", "high", "low"))), _positives_task(wanted), size, wanted)
    positives = stored(best.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score")), "positives")
    left, out = positives.where("positive_score >= 0"), None
    for share in ROUNDS:
        low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * share / 100).cast("long")
        window = left.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score", low.alias("low")))).alias("w"))
        asked = blocks(anchors.join(window, "vec_id"), F.col("w.positive_id").alias("pos"), F.col("w.positive_score").alias("high"), F.col("w.low").alias("low"))
        found = stored(_met(index, asked, _negatives_task(wanted), size, wanted), "negatives")
        full = found.where(F.col("rank") == wanted).select("anchor_id", "positive_id")
        last = share == ROUNDS[-1]
        done = found if last else found.join(full, ["anchor_id", "positive_id"], "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        left = stored(left.join(full, ["anchor_id", "positive_id"], "left_anti"), "windows")
        if left.isEmpty():
            break
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("found_score").alias("negative_score"))


#: The contract's rows in DuckDB's SQL.
ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
