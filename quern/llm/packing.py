"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of a full sequence's length stand alone. The others are dealt by a hash into groups of bounded size. A group's
solutions evolve on several islands, each one row of a DataFrame with the group's lengths and its own population, so that
islands spread over the cluster and any task can be made again. Crossover takes whole well-filled bins from one parent,
drops the bins of the other parent that hold a document twice, and puts displaced documents where they fit best: into
free room, in the place of a slightly shorter one whose bin they fill better, which is then displaced in turn, or in room
that exchanges of the same kind gather in one bin. After
each epoch the best solution of each island goes to the next island of the ring. A group whose best solution meets the
lower bound needs no more epochs. Bins that are left badly filled are dissolved, and their pieces meet in groups of a
second round.
"""

from __future__ import annotations

import bisect
import random
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, stored, text_bytes
from quern.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
#: Pieces that a group is meant to hold.
GROUP = 3000
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 5, 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_task(vocabulary: str, end: bytes, capacity: int):
    def task(batches):
        enc = encoder(vocabulary)
        for b in batches:
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(text_bytes(b.column(1)))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return task


def token_pieces(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids with the end id after them, cut at each `capacity` ids."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_piece_task(vocabulary or vocabulary_path(), end_id.to_bytes(4, "little"), capacity), PIECES)


class Packer:
    """Solutions of one group: a solution is a list of bins, a bin a list of items."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.bound = -(-sum(lengths) // capacity)

    def best_fit(self, items: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Put the items, in their order, each into the fullest bin that has room."""
        free = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(bins))
        for i in items:
            at = bisect.bisect_left(free, (self.lengths[i], -1))
            if at == len(free):
                bins.append([i])
                bisect.insort(free, (self.capacity - self.lengths[i], len(bins) - 1))
            else:
                room, k = free.pop(at)
                bins[k].append(i)
                bisect.insort(free, (room - self.lengths[i], k))
        return bins

    def longest_first(self, items) -> list[int]:
        return sorted(items, key=lambda i: (-self.lengths[i], i))

    def exchanged(self, items: list[int], bins: list[list[int]]) -> list[int]:
        """Put items into free room or in the place of shorter ones whose bins they fill better; gives back what is displaced for good."""
        room = {k: self.capacity - self.fill(b) for k, b in enumerate(bins)}
        room = {k: r for k, r in room.items() if r}
        there = sorted((self.lengths[i], i, k) for k in room for i in bins[k])
        left = []
        for i in self.longest_first(items):
            while True:
                n = self.lengths[i]
                fits = min(((r, k) for k, r in room.items() if r >= n), default=None)
                if fits:
                    bins[fits[1]].append(i)
                    out, k = None, fits[1]
                else:
                    at = bisect.bisect_left(there, (n - max(room.values(), default=0), -1, -1))
                    while at < len(there) and there[at][0] < n and there[at][0] + room[there[at][2]] < n:
                        at += 1
                    if at == len(there) or there[at][0] >= n:
                        left.append(i)
                        break
                    _, out, k = there.pop(at)
                    bins[k][bins[k].index(out)] = i
                room[k] -= n - (self.lengths[out] if out is not None else 0)
                if room[k]:
                    bisect.insort(there, (n, i, k))
                else:
                    del room[k]
                    there = [x for x in there if x[2] != k]
                if out is None:
                    break
                i = out
        return left

    def gathered(self, need: int, bins: list[list[int]], sinks: int = 6) -> int | None:
        """Free room of other bins brought into one, by exchanging an item of it for a slightly shorter one of theirs; the bin that then has room for `need`, if any."""
        room = [self.capacity - self.fill(b) for b in bins]
        if sum(room) < need:
            return None
        givers = sorted((k for k, r in enumerate(room) if r), key=lambda k: -room[k])
        for sink in sorted(range(len(bins)), key=lambda k: -len(bins[k]))[:sinks]:
            own = sorted((self.lengths[i], i) for i in bins[sink])
            moved = True
            while moved and room[sink] < need:
                moved = False
                for k in givers:
                    if k == sink or not room[k] or room[sink] >= need:
                        continue
                    best = (0, None, None)
                    for i in bins[k]:
                        n = self.lengths[i]
                        at = bisect.bisect_right(own, (n + room[k], len(self.lengths))) - 1
                        if at >= 0 and own[at][0] - n > best[0]:
                            best = (own[at][0] - n, i, own[at])
                    gain, i, x = best
                    if gain:
                        own.remove(x)
                        bisect.insort(own, (self.lengths[i], i))
                        bins[sink][bins[sink].index(x[1])] = i
                        bins[k][bins[k].index(i)] = x[1]
                        room[k] -= gain
                        room[sink] += gain
                        moved = True
            if room[sink] >= need:
                return sink
        return None

    def placed(self, items, bins: list[list[int]]) -> list[list[int]]:
        """bins with the items in free room, in exchange, in room that is gathered for them, or in new bins."""
        left = []
        for i in self.exchanged(list(items), bins):
            sink = self.gathered(self.lengths[i], bins) if not left and bins else None
            if sink is None:
                left.append(i)
            else:
                bins[sink].append(i)
        return self.best_fit(left, bins)

    def fill(self, b: list[int]) -> int:
        return sum(self.lengths[i] for i in b)

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then more uneven ones, which leave room in one place."""
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def first(self, n: int) -> list[list[list[int]]]:
        """Best fit, longest first, and best fits in orders that are more and more by chance; best fit alone if it meets the bound."""
        every = range(len(self.lengths))
        out = [self.best_fit(self.longest_first(every), [])]
        while len(out) < n and len(out[0]) > self.bound:
            spread = len(out) / n
            drawn = {i: self.lengths[i] * self.random.uniform(1 - spread, 1 + spread) for i in every}
            out.append(self.best_fit(sorted(every, key=lambda i: -drawn[i]), []))
        return out

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """b with a choice of a's best-filled bins put in."""
        best = sorted(a, key=self.fill, reverse=True)[: max(1, len(a) * 2 // 3)]
        chosen = [list(x) for x in best if self.random.random() < 0.7] or [list(best[0])]
        there = {i for x in chosen for i in x}
        kept = [list(x) for x in b if there.isdisjoint(x)]
        displaced = set(range(len(self.lengths))) - there - {i for x in kept for i in x}
        return self.placed(displaced, chosen + kept)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Dissolve the emptiest bin and a few others."""
        order = sorted(range(len(bins)), key=lambda k: self.fill(bins[k]))
        gone = {order[0], *self.random.sample(order, min(len(order), 3))}
        return self.placed([i for k in gone for i in bins[k]], [list(x) for k, x in enumerate(bins) if k not in gone])

    def evolve(self, population: list[list[list[int]]], generations: int, size: int) -> list[list[list[int]]]:
        population = sorted(population, key=self.fitness, reverse=True)
        for _ in range(generations):
            if len(population[0]) <= self.bound:
                break
            children = [self.cross(*self.random.sample(population, 2)) for _ in range(size)] if len(population) > 1 else []
            children += [self.mutate(population[0]), self.mutate(self.random.choice(population))]
            population = sorted(population + children, key=self.fitness, reverse=True)[:size]
        return population


def _solution(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(solution: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(solution) + 1)]
    for i, k in enumerate(solution):
        out[k].append(i)
    return out


def _evolve_task(capacity: int, epoch: int):
    schema = pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int64())), ("population", pa.list_(pa.list_(pa.int32()))), ("done", pa.bool_())])

    def task(batches):
        for b in batches:
            for row in b.to_pylist():
                p = Packer(row["lengths"], capacity, hash((row["grp"], row["island"], epoch)))
                known = [_bins(s) for s in row["population"] or []]
                if row.get("elite"):
                    known.append(_bins(row["elite"]))
                population = p.evolve(known or p.first(POPULATION), GENERATIONS, POPULATION)
                done = len(population[0]) <= p.bound
                out = [_solution(x, len(row["lengths"])) for x in (population[:1] if done else population)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((row["grp"], row["island"], row["lengths"], out, done), schema)], schema=schema)

    return task


_STATE = "grp long, island int, lengths array<long>, population array<array<int>>, done boolean"


def best_solutions(groups: DataFrame, *, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(grp, solution) of the best island for each (grp, lengths)."""
    state = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.lit(None).cast("array<array<int>>").alias("population"))
    state = stored(state.mapInArrow(_evolve_task(capacity, 0), _STATE), "islands")
    for epoch in range(1, epochs):
        open_ = state.join(state.where("done").select("grp").distinct(), "grp", "left_anti")
        if open_.isEmpty():
            break
        elites = open_.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("elite"))
        moved = open_.select("grp", "island", "lengths", "population").join(elites, ["grp", "island"])
        after = moved.mapInArrow(_evolve_task(capacity, epoch), _STATE)
        state = stored(state.join(open_.select("grp").distinct(), "grp", "left_anti").unionByName(after), "islands")
    best = F.col("population")[0]
    return state.groupBy("grp").agg(F.min_by(best, F.struct(F.array_max(best), "island")).alias("solution"))


def _round(pieces: DataFrame, groups: int, capacity: int, base: int) -> DataFrame:
    """pieces with bin (unique over groups) and the bin's fill."""
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    # the row number spreads rows that share an id (or have none); groups are written once, as two plans read them
    group = F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(groups))
    numbered = pieces.withColumn("grp", group)
    dealt = stored(numbered.groupBy("grp").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")), "groups")
    packed = dealt.join(best_solutions(dealt.select("grp", F.transform("items", lambda x: x["length"]).alias("lengths")), capacity=capacity), "grp")
    # bins are laid out inside a group's own arrays: no other shuffle
    each = packed.select("grp", F.explode(F.arrays_zip("items", "solution")).alias("x"))
    flat = each.select("grp", F.col("x.solution").alias("bin"), "x.items.*")
    w = Window.partitionBy("grp", "bin")
    before = F.sum("length").over(w.orderBy(F.desc("length"), "doc_id", "piece", "start").rowsBetween(Window.unboundedPreceding, -1))
    return flat.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(base) + F.col("grp") * (1 << 20) + F.col("bin")).alias("sequence_id"), F.coalesce(before, F.lit(0)).alias("offset"), F.sum("length").over(w).alias("fill"))


def pack(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP, end_id: int = 0, refill_below: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and give the end id alone; repeated rows are packed as often as they occur; an empty table
    gives no rows. Groups hold `group` pieces on average however many documents there are.
    """
    pieces = stored(token_pieces(docs, vocabulary=vocabulary, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.where(F.col("length") < capacity)
    n = part.count()
    first = stored(_round(part, max(1, round(n / group)), capacity, 0), "packed")
    again = first.where(F.col("fill") < refill_below * capacity)
    second = _round(again.select("doc_id", "piece", "start", "length", "ids_crc32"), max(1, round(again.count() / group)), capacity, 1 << 61)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*columns).unionByName(first.where(F.col("fill") >= refill_below * capacity).select(*columns)).unionByName(second.select(*columns))
