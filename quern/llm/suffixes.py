"""Suffix-array deduplication of byte strings that occur twice, by a common-prefix-aware distributed merge sort.

Every string of LENGTH bytes holds the least K-gram of its own LENGTH - K + 1 (by a hash), and equal strings hold it at
the same place. So it is enough to sort the suffixes that begin at such anchors, one in some 35: two strings are equal
only if two anchors agree on the bytes before and after.

1. Each task finds its texts' anchors and deals their K-gram hashes out by value, each once a block; an anchor whose hash
   is seen nowhere else begins no repeat and is dropped. A gram of a third of all texts is one entry for each block.
2. The other anchors' suffixes, cut at LENGTH bytes, are sorted into runs where their texts are. Anchors whose whole
   surroundings are equal leave only the first of them in the run, so a group of copies costs a task one suffix.
3. Runs are exchanged front-coded (length of the prefix shared with the one before, and the rest), dealt by K-gram, and
   merged by a loser tree that compares stored prefix lengths first and bytes only beyond them. A first pass counts grams:
   the most frequent ones, as of a line that many texts share, are dealt by more bytes, once with the AHEAD bytes from the
   anchor on for strings that have these, once with bytes before the gram for the others. So only anchors that can share
   LENGTH bytes meet, and no gram comes to one task.
4. In merged order the shared lengths give the suffixes that agree on r bytes; with a hash of the LENGTH - r bytes before,
   whose hits are verified by the bytes, each anchor learns which of its strings started earlier, for all anchors at once
   and no pair of them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, packed_rows, text_bytes, unpacked_rows

LENGTH, K = 100, 32
WINDOW = LENGTH - K + 1
#: Bytes of texts joined for one pass, anchors of a block, and suffixes of a run.
JOINED, BLOCK, RUN = 150_000, 400_000, 60_000
#: Bytes of text that a bucket stands for at most, on average.
BUCKET_BYTES = 64_000_000
#: Anchors of one gram in a block from which it is reported, and the number of reported grams that are dealt by more bytes.
REPORTED, SPLIT = 256, 4096
#: Most bytes before an anchor of a string that is dealt by what is ahead, the bytes ahead that it then has, and the bytes before of all others.
NEAR = (LENGTH - K) // 2
AHEAD, BEHIND = LENGTH - NEAR, NEAR + 1
_LOWEST = -(2**63)


def _doc_key(column) -> list[int]:
    return [_LOWEST if d is None else d for d in column.to_pylist()]


_MIX = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place, by doubling."""
    h, size = _MIX[data], 1
    while size < K:
        m = np.uint64(pow(0x9E3779B97F4A7C15, size, 2**64) | 1)
        h = h[:-size] * m + h[size:]
        size *= 2
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _sliding(h: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each run of `width`, by doubling."""
    size = 1
    while size * 2 <= width:
        h = least(h[:-size], h[size:])
        size *= 2
    return least(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the K-grams that are least in some window of WINDOW, and their hashes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    low = _sliding(h, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), WINDOW, np.maximum) == h)
    return at, h[at]


def _blocks(batches):
    """(documents, places, gram hashes) of the anchors of some texts at a time, and the texts' bytes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    docs, texts, size, total = [], [], 0, 0

    def joined():
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        at, h = anchors(data)
        own = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[own]
        at, h, own = at[inside], h[inside], own[inside]
        held.append((np.array(docs, np.int64)[own], (at - (ends - lengths)[own]).astype(np.int32), h))

    for batch in batches:
        for d, t in zip(_doc_key(batch.column(0)), text_bytes(batch.column(1))):
            if len(t) >= LENGTH:
                docs.append(d)
                texts.append(t)
                size += len(t)
                total += len(t)
                if size > JOINED:
                    joined()
                    docs, texts, size = [], [], 0
                    if sum(len(x[0]) for x in held) > BLOCK:
                        yield *(np.concatenate(x) for x in zip(*held)), total
                        held, total = [], 0
    if texts:
        joined()
    if sum(len(x[0]) for x in held):
        yield *(np.concatenate(x) for x in zip(*held)), total


def _survey_task(batches):
    """(gram hash, anchors) of the frequent grams of each block, and the bytes of its texts under no gram."""
    for _, _, h, total in _blocks(batches):
        grams, n = np.unique(h, return_counts=True)
        often = n >= REPORTED
        yield pa.RecordBatch.from_arrays([pa.array([None, *grams[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[often].tolist()], pa.int64())], names=["gram", "n"])


def _anchor_task(buckets: int):
    def rows(d, p, h):
        order = np.argsort(h, kind="stable")
        first = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
        alone = first & np.concatenate([first[1:], [True]])
        known, lead = np.sort(order[~alone]), order[first]
        out = []
        if len(known):  # repeats within the block need no answer; one of each stands for them elsewhere
            out.append((int(h[known[0]] % np.uint64(buckets)), d[known].tobytes(), p[known].tobytes(), None, None))
        b = (h[lead] % np.uint64(buckets)).astype(np.int32)
        # 40 bits beside the bucket: a false hit only makes one more suffix to sort
        rest = h[lead] // np.uint64(buckets)
        by = np.argsort(b, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            at = lead[part]
            out.append((int(b[part[0]]), d[at].tobytes(), p[at].tobytes(), (rest[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((rest[part] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "docs", "places", "low", "high"])

    def task(batches):
        for d, p, h, _ in _blocks(batches):
            yield rows(d, p, h)

    return task


def _pairs(docs: np.ndarray, values: np.ndarray, name: str):
    """A row for each value, so that their number follows the anchors and not the partitions."""
    for at in range(0, len(docs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 100_000]), pa.array(values[at : at + 100_000])], names=["doc", name])


def _twice_task(batches):
    """(doc, place) of the anchors whose K-gram hash another anchor has."""
    parts: dict[str, list] = {c: [] for c in ("bucket", "docs", "places", "low", "high")}
    for b in batches:
        for r in b.filter(pc.is_null(b.column("low"))).to_pylist():
            yield from _pairs(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["places"], np.int32), "place")
        asked = b.filter(pc.is_valid(b.column("low")))
        for c, x in parts.items():
            x += asked.column(c).to_pylist()
    if not parts["docs"]:
        return
    d, p = np.frombuffer(b"".join(parts["docs"]), np.int64), np.frombuffer(b"".join(parts["places"]), np.int32)
    h = np.frombuffer(b"".join(parts["low"]), np.uint32).astype(np.uint64) | np.frombuffer(b"".join(parts["high"]), np.uint8).astype(np.uint64) << np.uint64(32)
    h |= np.repeat(np.array(parts["bucket"], np.uint64), [len(x) for x in parts["high"]]) << np.uint64(40)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    yield from _pairs(d[twice], p[twice], "place")


def _by_doc(docs: np.ndarray, values: np.ndarray, name: str):
    """Rows of (doc, the bytes of its values)."""
    if len(docs):
        order = np.argsort(docs, kind="stable")
        docs, values = docs[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array([v.tobytes() for v in np.split(values, first[1:])], pa.binary())], names=["doc", name])


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need not be compared."""
    n = min(len(a), len(b)) - known
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the length shared with the one before, and the rest."""
    shared = [0, *(shared_prefix(a, b, 0) for a, b in zip(suffixes, suffixes[1:]))]
    return shared, [s[n:] for s, n in zip(suffixes, shared)]


def front_decoded(shared: list[int], rests: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, rest in zip(shared, rests):
        last = last[:n] + rest
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int, int]]:
    """(run, place in the run, length shared with the suffix before) of all suffixes in order, by a loser tree.

    A run's head is known by the length it shares with the suffix that left last. Of two heads the one that shares more
    is less; only for equal lengths are bytes compared, and only beyond that length.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    shared = [0 if i < len(runs) and runs[i][0] else -1 for i in range(k)]
    head = [runs[i][0][0] if shared[i] == 0 else b"" for i in range(k)]

    def winner(a: int, b: int) -> tuple[int, int]:
        """The less of two heads and the other, which keeps what it shares with the less."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = head[a], head[b]
        n = shared_prefix(p, q, x)
        if p[n:] < q[n:] or n == len(p) == len(q) and a < b:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = winner(build(2 * node), build(2 * node + 1))
        return won

    out = []
    top = build(1)
    while shared[top] >= 0:
        suffixes, lengths = runs[top]
        i = place[top]
        out.append((top, i, shared[top]))
        i += 1
        place[top] = i
        if i < len(suffixes):
            head[top], shared[top] = suffixes[i], lengths[i]
        else:
            shared[top] = -1
        node = (top + k) >> 1
        while node:
            top, losers[node] = winner(top, losers[node])
            node >>= 1
    return out


def _bounds(before: int, after: int) -> tuple[int, int]:
    """Most and least bytes that a string at an anchor has before it."""
    return min(WINDOW - 1, before), max(0, LENGTH - after)


def _grams_at(data: bytes, places: list[int]) -> np.ndarray:
    """gram_hashes() at some places."""
    h, size = _MIX[np.frombuffer(data, np.uint8)[np.array(places)[:, None] + np.arange(K)]], 1
    while size < K:
        m = np.uint64(pow(0x9E3779B97F4A7C15, size, 2**64) | 1)
        h = h[:, :-size] * m + h[:, size:]
        size *= 2
    h = h[:, 0]
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


#: How a run has been dealt: by the gram, by bytes ahead, by bytes behind; with the least and most bytes before the anchor of the strings it answers for.
BY_GRAM, BY_AHEAD, BY_BEHIND = 0, 1, 2
ANSWERS = {BY_GRAM: (0, WINDOW - 1), BY_AHEAD: (0, NEAR), BY_BEHIND: (BEHIND, WINDOW - 1)}


def _dealt(after: bytes, before: bytes, split: bool):
    """(how, bytes to deal by, after, before) of an anchor; no more bytes travel than its strings have."""
    if not split:
        yield BY_GRAM, after[:K], after, before
        return
    if len(after) >= AHEAD:
        yield BY_AHEAD, after[:AHEAD], after, before[-NEAR:]
    if len(before) >= BEHIND:
        yield BY_BEHIND, before[-BEHIND:] + after[:K], after[: LENGTH - BEHIND], before


def _run_task(buckets: int, frequent: np.ndarray):
    """Rows of two kinds: runs of a bucket, and spans of texts that are known to be repeats of earlier ones, which go with any bucket.

    frequent: the sorted hashes of the grams that are dealt by more bytes.
    """
    names = ["bucket", "how", "doc", "spans", "shared", "rests", "rest_sizes", "befores", "before_sizes", "docs", "places"]
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]

    def task(batches):
        seen: dict[tuple[int, bytes], int] = {}
        entries: list[tuple[bytes, bytes, int, int, bool]] = []

        def runs():
            parts: dict[tuple[int, int], list] = {}
            for after, before, d, x, split in entries:
                for how, key, a, b in _dealt(after, before, split):
                    parts.setdefault((zlib.crc32(key) % buckets, how), []).append((a, b, d, x))
            for (bucket, how), part in parts.items():
                part.sort()
                shared, rests = front_coded([e[0] for e in part])
                befores = [e[1] for e in part]
                yield [bucket, how, None, None, bytes(shared), b"".join(rests), bytes(map(len, rests)), b"".join(befores), bytes(map(len, befores)), np.array([e[2] for e in part], np.int64).tobytes(), np.array([e[3] for e in part], np.int32).tobytes()]
            entries.clear()
            seen.clear()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            late: list[tuple[int, int, int]] = []
            for d, data, places in zip(_doc_key(b.column("doc")), text_bytes(b.column("text")), b.column("places").to_pylist()):
                # a place beyond the end is that of another row with the same id
                places = [x for x in sorted(set(places)) if x + K <= len(data)]
                split = np.isin(_grams_at(data, places), frequent).tolist() if len(frequent) and places else [False] * len(places)
                for x, more in zip(places, split):
                    before, after = data[max(0, x - WINDOW + 1) : x], data[x : x + LENGTH]
                    most, least = _bounds(len(before), len(after))
                    if most < least:
                        continue
                    i = seen.setdefault((len(before), before + after), len(entries))
                    if i == len(entries):
                        entries.append((after, before, d, x, more))
                        continue
                    first, own = entries[i][2:4], (d, x)
                    if own < first:
                        entries[i] = (after, before, d, x, more)
                        own = first
                    elif own == first:
                        continue
                    late.append((own[0], own[1] - most, own[1] - least + LENGTH))
            if late:
                found = np.array(late, np.int64)
                for r in _by_doc(found[:, 0], found[:, 1:].astype(np.int32), "spans"):
                    yield batch([[d % buckets, None, d, s, *[None] * 7] for d, s in zip(r.column(0).to_pylist(), r.column(1).to_pylist())])
            if len(entries) >= RUN:
                for r in runs():
                    yield batch([r])
        for r in runs():
            yield batch([r])

    return task


def earlier_spans(suffix_shared: np.ndarray, befores: np.ndarray, before_sizes: np.ndarray, after_sizes: np.ndarray, order: np.ndarray, fewest: np.ndarray | None = None, greatest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For anchors in merged order: the most and the least bytes before the anchor of its strings that an earlier anchor has; -1 for none.

    befores: bytes before each anchor, nearest first; order: rank of (document, place); fewest, greatest: bounds on the
    bytes before of the strings that are asked for.
    """
    n = len(suffix_shared)
    fewest = np.zeros(n, np.int64) if fewest is None else fewest
    greatest = np.full(n, WINDOW - 1) if greatest is None else greatest
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    back = np.zeros(n, np.uint64)
    rank = np.argsort(order, kind="stable")

    def grouped(key: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows and the first one, in order, of those with the same key."""
        by = np.argsort(key[some], kind="stable")
        some = some[by]
        begins = np.concatenate([[True], key[some[1:]] != key[some[:-1]]])[: len(some)]
        return some, some[np.maximum.accumulate(np.where(begins, np.arange(len(some)), 0))]

    for o in range(WINDOW):
        if o:
            back = back * np.uint64(0x9E3779B97F4A7C15) + befores[:, o - 1].astype(np.uint64) + np.uint64(1)
        fits = (before_sizes >= o) & (after_sizes >= LENGTH - o) & (fewest <= o) & (greatest >= o)
        chosen = rank[fits[rank]]
        node = np.cumsum(suffix_shared < LENGTH - o)
        some, first = grouped(node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ (back ^ (back >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), chosen)
        later = order[first] < order[some]
        if not ((node[first[later]] == node[some[later]]).all() and (befores[first[later], :o] == befores[some[later], :o]).all()):
            # two strings share a hash: the bytes themselves are the key
            some, first = grouped(np.unique(np.column_stack([node, befores[:, :o]]), axis=0, return_inverse=True)[1].ravel(), chosen)
            later = order[first] < order[some]
        hit = some[later]
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return most, least


def _packed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans as one number each."""
    return starts.astype(np.int64) << 32 | ends.astype(np.int64)


def _merge_task(batches):
    runs, befores, docs, places, hows = [], [], [], [], []
    for b in batches:
        late = b.filter(pc.is_valid(b.column("spans")))
        if late.num_rows:
            found = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in late.column("spans").to_pylist()]
            own = np.repeat(np.array(late.column("doc").to_pylist(), np.int64), [len(x) for x in found])
            yield from _pairs(own, _packed(*np.concatenate(found).T), "span")
        for r in b.filter(pc.is_valid(b.column("docs"))).to_pylist():
            sizes, at, rests = r["rest_sizes"], 0, []
            for n in sizes:
                rests.append(r["rests"][at : at + n])
                at += n
            shared = list(r["shared"])
            runs.append((front_decoded(shared, rests), shared))
            at, own = 0, []
            for n in r["before_sizes"]:
                own.append(r["befores"][at : at + n])
                at += n
            befores.append(own)
            docs.append(np.frombuffer(r["docs"], np.int64))
            places.append(np.frombuffer(r["places"], np.int32))
            hows.append(np.full(len(places[-1]), r["how"]))
    if not runs:
        return
    out = merged(runs)
    shared = np.array([n for *_, n in out], np.int64)
    firsts = np.cumsum([0, *map(len, docs)])
    flat = np.array([firsts[r] + i for r, i, _ in out])
    doc, place = np.concatenate(docs)[flat], np.concatenate(places)[flat].astype(np.int64)
    before = [befores[r][i][::-1] for r, i, _ in out]
    after_sizes = np.array([len(runs[r][0][i]) for r, i, _ in out])
    # anchors that share no K bytes with a neighbour have no partner
    partner = np.concatenate([shared[1:] >= K, [False]]) | (shared >= K)
    keep = np.flatnonzero(partner)
    if not len(keep):
        return
    lead = np.where(partner, shared, 0)[keep]
    matrix = np.frombuffer(b"".join(before[i].ljust(WINDOW - 1, b"\0") for i in keep), np.uint8).reshape(len(keep), WINDOW - 1)
    sizes = np.array([len(before[i]) for i in keep])
    by = np.lexsort((place[keep], doc[keep]))
    # equal (document, place) is one anchor that two rows share, and not earlier than itself
    same = (np.diff(doc[keep][by]) == 0) & (np.diff(place[keep][by]) == 0)
    rank = np.empty(len(keep), np.int64)
    rank[by] = np.cumsum(np.concatenate([[False], ~same]))
    how = np.concatenate(hows)[flat][keep]
    fewest, greatest = (np.array([ANSWERS[h][k] for h in (BY_GRAM, BY_AHEAD, BY_BEHIND)])[how] for k in (0, 1))
    most, least = earlier_spans(lead, matrix, sizes, after_sizes[keep], rank, fewest, greatest)
    hit = most >= 0
    at = place[keep][hit]
    yield from _pairs(doc[keep][hit], _packed(at - most[hit], at - least[hit] + LENGTH), "span")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) with a key that is never null. Both joins on it have this as their one side, so that Spark deals the texts out once."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc"), F.col(text_col).alias("text"))


def repeated_spans(texts: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """Of (doc, text): (doc, spans) for documents with repeats; a span is start * 2^32 + end in bytes, and spans are unsorted and overlap."""
    spark = texts.sparkSession
    bounded_batches(spark)
    survey = texts.mapInArrow(_survey_task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # the order is by frequency, with the row of all bytes first
    top = survey.orderBy(F.col("gram").isNotNull(), F.desc("n"), "gram").limit(SPLIT + 1).collect()
    frequent = np.sort(np.array([r["gram"] for r in top if r["gram"] is not None], np.int64).view(np.uint64))
    size = sum(r["n"] for r in top if r["gram"] is None)
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt = texts.mapInArrow(_anchor_task(n), "bucket int, docs binary, places binary, low binary, high binary").repartitionById(n, "bucket")
    twice = dealt.mapInArrow(_twice_task, "doc long, place int").groupBy("doc").agg(F.collect_list("place").alias("places"))
    kinds = "bucket int, how int, doc long, spans binary, shared binary, rests binary, rest_sizes binary, befores binary, before_sizes binary, docs binary, places binary"
    runs = texts.join(twice, "doc").mapInArrow(_run_task(n, frequent), kinds).repartitionById(n, "bucket")
    return runs.mapInArrow(_merge_task, "doc long, span long").groupBy("doc").agg(F.collect_list("span").alias("spans"))


def _removed(n: int, packed: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover, within a text of n bytes."""
    out: list[tuple[int, int]] = []
    if packed:
        for span in sorted(packed):
            a, b = span >> 32, min(span & 0xFFFFFFFF, n)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            elif a < b:
                out.append((a, b))
    return out


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return data
    starts = [0, *(b for _, b in runs)]
    ends = [*(a for a, _ in runs), len(data)]
    return b"".join(data[a:b] for a, b in zip(starts, ends))


def _result_task(digest: bool):
    def task(batches):
        for b in batches:
            texts = text_bytes(b.column("_text"))
            runs = [_removed(len(t), s) for t, s in zip(texts, b.column("_spans").to_pylist())]
            kept = [_kept(t, r) for t, r in zip(texts, runs)]
            own = [pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(e - s for s, e in r) for r in runs], pa.int64()), pa.array([len(r) for r in runs], pa.int64())]
            last = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array([k.decode("utf-8", "ignore") for k in kept])
            yield pa.RecordBatch.from_arrays([b.column("_keep"), *own, last], names=["_keep", *RESULT, "kept_sha256" if digest else "kept"])

    return task


RESULT = ("n_bytes", "n_removed", "n_spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """keep (default id_col), n_bytes, n_removed, n_spans and `kept`, the text that is left (or kept_sha256 of its bytes).

    A byte goes if a LENGTH-byte string over it also starts earlier, in a smaller id or earlier in the same text, judged
    on the input. Null and empty texts and those shorter than LENGTH lose nothing; a null id comes before all others. Ids
    are meant to be unique: rows that share one are judged as one document against smaller ids, and never against
    each other's same places. A removed run may begin or end inside a character; of such a character `kept` leaves out
    the bytes that stay, which kept_sha256 counts. A kept column with a result's name gives way to it.
    """
    bounded_batches(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(texts).select("doc", F.col("spans").alias("_spans"))
    if keep and keep != [id_col]:
        rows = packed_rows(docs, keep, text_col, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)).alias("doc"))
        joined = rows.join(spans, "doc", "left").select("_keep", "_text", "_spans")
    else:
        joined = texts.join(spans, "doc", "left").select(F.struct(F.when(F.col("doc") != _LOWEST, F.col("doc")).alias(id_col)).alias("_keep"), F.col("text").alias("_text"), "_spans")
    last = "kept_sha256" if digest else "kept"
    found = joined.mapInArrow(_result_task(digest), f"_keep {joined.schema['_keep'].dataType.simpleString()}, {', '.join(f'{c} long' for c in RESULT)}, {last} string")
    return unpacked_rows(found, *RESULT, last)
