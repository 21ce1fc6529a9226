"""Words that differ by one inserted, deleted or replaced letter, found in tries of letter-group counts.

A word's vector counts its letters by GROUPS groups. One edit adds at most one to one count (a surplus) and takes at most
one from another (a deficit), so a depth-first search from the root, one group a level, follows the equal count for
nothing and the next greater or smaller one for a budget of one each. Only the words of the leaves that it reaches are
compared letter by letter.

The vocabulary is dealt out so that words one edit apart meet: of two such words of L and L' letters, the first or the last
a letters agree, a being half the pair's greater length (half of L where both have L). A word goes to two such parts (four,
if its length is odd); in the part of the ends a pair is left out whose beginnings agree. Parts of more than PART_WORDS
words are cut into slices, each of which all words of the part visit, so that no task holds more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, dropped, stored, stored_at, text_bytes

#: The contract's words: letters of a word, occurrences, one (document, word) in so many that loses a letter, and how far more frequent a form is.
LEAST_LETTERS, LEAST_N, MISSPELT, FORM_RATIO = 6, 5, 199, 5
#: Words counted before a task hands on its counts, words of a slice, and words (and bytes) of one search.
HELD_WORDS, PART_WORDS, SEARCH_WORDS, SEARCH_BYTES = 300_000, 20_000, 20_000, 16_000_000
#: (word, node) places of one step of the search, and pairs of words compared at once.
STEP, PAIRS = 100_000, 50_000
GROUPS = 12
#: English letters by frequency, dealt to the groups in turn; all others by their code.
_FREQUENT = b"etaoinshrdlucmfwypvbgkjqxz"
_GROUP_OF = np.array([_FREQUENT.index(c) % GROUPS if c in _FREQUENT else c % GROUPS for c in range(256)], np.uint8)
_GROUP_OF[0] = GROUPS

_OTHERS = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]+")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))


def letter_runs(data: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, A-Z lowered."""
    return _OTHERS.sub(b" ", data).translate(_LETTERS).split() if not data.isascii() else data.translate(_LETTERS).split()


def _count_task(batches):
    """(word, n) of some documents at a time; words too short to count are left out."""
    held: Counter[bytes] = Counter()

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
            begun = zlib.crc32(b":" if d is None else b"%d:" % d)
            for w, n in Counter(letter_runs(t)).items():
                if len(w) < LEAST_LETTERS:
                    continue
                h = zlib.crc32(w, begun)
                if h % MISSPELT == 0:
                    u = w.decode()
                    at = h % len(u)
                    w = (u[:at] + u[at + 1 :]).encode()
                held[w] += n
            if len(held) >= HELD_WORDS:
                yield flushed()
    if held:
        yield flushed()


def vocabulary(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters or more, found LEAST_N times or more."""
    bounded_batches(docs.sparkSession)
    counts = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_count_task, "word string, n long")
    return counts.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


class Trie:
    """Vectors in lexical order; a level's nodes are its different beginnings, found by parent and count."""

    def __init__(self, parts: np.ndarray, vectors: np.ndarray):
        self.order = np.lexsort((*vectors.T[::-1], parts))
        parts, vectors = parts[self.order], vectors[self.order]
        self.scale = int(vectors.max(initial=0)) + 2
        new = np.append(True, parts[1:] != parts[:-1]) if len(parts) else np.zeros(0, bool)
        self.roots = parts[new]
        self.codes, self.begins = [], [np.append(np.flatnonzero(new), len(parts))]
        for g in range(vectors.shape[1]):
            node = np.cumsum(new) - 1
            new = new | np.append(False, vectors[1:, g] != vectors[:-1, g]) if len(parts) else new
            begin = np.flatnonzero(new)
            self.codes.append(node[begin] * self.scale + vectors[begin, g])
            self.begins.append(np.append(begin, len(parts)))

    def near(self, parts: np.ndarray, vectors: np.ndarray, few: int = 2):
        """Yields (which vector, which member): members of the part whose vector is at most a surplus and a deficit of one away.

        Depth first, a block of (vector, node, budgets) a step. A node of few members is a leaf for this purpose: some
        of its members may be further away.
        """
        at = np.minimum(np.searchsorted(self.roots, parts), len(self.roots) - 1) if len(self.roots) else np.zeros(0, int)
        found = np.flatnonzero(self.roots[at] == parts) if len(self.roots) else at
        more, less = np.ones(len(found), bool), np.ones(len(found), bool)
        stack = [(0, found, at[found], more, less)]
        while stack:
            level, which, node, more, less = stack.pop()
            if len(which) > STEP:
                stack += [(level, which[i : i + STEP], node[i : i + STEP], more[i : i + STEP], less[i : i + STEP]) for i in range(0, len(which), STEP)]
                continue
            begin, size = self.begins[level][node], self.begins[level][node + 1] - self.begins[level][node]
            leaf = size <= few if level < len(self.codes) else np.ones(len(which), bool)
            if leaf.any():
                n = size[leaf]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(which[leaf], n), self.order[np.repeat(begin[leaf], n) + inside]
            some = ~leaf
            which, node, more, less = which[some], node[some], more[some], less[some]
            if not len(which):
                continue
            codes = self.codes[level]
            for step, can in ((0, None), (1, more), (-1, less)):
                i = np.arange(len(which)) if can is None else np.flatnonzero(can)
                count = vectors[which[i], level] + step
                ok = (count >= 0) & (count < self.scale)  # others would be another parent's
                i, count = i[ok], count[ok]
                value = node[i] * self.scale + count
                child = np.minimum(np.searchsorted(codes, value), len(codes) - 1)
                ok = codes[child] == value
                i, child = i[ok], child[ok]
                if len(i):
                    stack.append((level + 1, which[i], child, more[i] & (step != 1), less[i] & (step != -1)))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two matrices of letters, zeros after them, that are exactly one edit apart; a's are no longer than b's."""
    differ = a != b
    la, lb = (a != 0).sum(axis=1), (b != 0).sum(axis=1)
    first = np.argmax(differ, axis=1)
    moved = a[:, :-1] != b[:, 1:]
    last = np.where(moved.any(axis=1), moved.shape[1] - 1 - np.argmax(moved[:, ::-1], axis=1), -1)
    return np.where(la == lb, differ.sum(axis=1) == 1, (lb == la + 1) & (last < first))


def near_words(keys: np.ndarray, sizes: np.ndarray, ends: np.ndarray, words: list[bytes], member: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, its near word), as places in `words`, of each part; sizes: the letters that agree in it; ends: whether these are the last."""
    width = max(map(len, words)) + 1
    letters = np.array(words, f"S{width}").view(np.uint8).reshape(-1, width)
    length = (letters != 0).sum(axis=1)
    groups = _GROUP_OF[letters]
    vectors = np.stack([(groups == g).sum(axis=1) for g in range(GROUPS)], axis=1)
    members, asking = np.flatnonzero(member), np.flatnonzero(asks)
    trie = Trie(keys[members], vectors[members])
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for q, m in trie.near(keys[asking], vectors[asking]):
        q, m = asking[q], members[m]
        lq, lm, a = length[q], length[m], sizes[q]
        some = (np.abs(lq - lm) <= 1) & ((lq != 2 * a - 1) | (lm != 2 * a - 1))
        q, m = q[some], m[some]
        for i in range(0, len(q), PAIRS):
            x, y = q[i : i + PAIRS], m[i : i + PAIRS]
            swap = length[x] > length[y]
            s, t = letters[np.where(swap, y, x)], letters[np.where(swap, x, y)]
            ok = one_edit(s, t)
            # agreement at the beginning is the other part's
            ok &= ~ends[x] | (np.argmax(s != t, axis=1) < sizes[x])
            found.append((x[ok], y[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_NEAR = "word string, n_near long, near_n long, near string"


def _near_task(batches):
    """Parts in order: (word, n_near, near_n, near) for each word of a part that has near words there."""
    held: list[pa.RecordBatch] = []

    def searched(t: pa.Table):
        column = lambda c: t.column(c).to_numpy()
        text, n = t.column("word").to_pylist(), column("n")
        q, m = near_words(column("part"), column("size"), column("ends"), [w.encode("latin-1") for w in text], column("member"), column("asks"))
        rank = np.empty(len(text), np.int64)
        rank[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
        order = np.lexsort((rank[m], -n[m], q))
        q, m = q[order], m[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
        many = np.diff(np.append(begin, len(q)))
        return pa.RecordBatch.from_arrays([pa.array([text[i] for i in q[begin]], pa.string()), pa.array(many.astype(np.int64)), pa.array(n[m[begin]]), pa.array([text[i] for i in m[begin]], pa.string())], names=["word", "n_near", "near_n", "near"])

    size = longest = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size, longest = size + b.num_rows, max(longest, max(map(len, b.column(2).to_pylist())))
        if size >= SEARCH_WORDS or size * longest >= SEARCH_BYTES:
            t = pa.Table.from_batches(held)
            part = t.column(0).to_numpy()
            cut = int(np.searchsorted(part != part[-1], False)) if part[0] == part[-1] else int(np.flatnonzero(part != part[-1])[-1]) + 1
            if cut:
                yield searched(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
                longest = max(map(len, t.slice(cut).column(2).to_pylist()))
    if size:
        yield searched(pa.Table.from_batches(held).combine_chunks())


def parted(words: DataFrame) -> DataFrame:
    """(part, size, word, n, ends, member, asks): each word in its parts, and in each slice of a part that is cut."""
    # half the length, and of an odd length also the half that it shares with the next greater one
    halves = F.array_distinct(F.array(F.expr("length(word) div 2"), F.expr("(length(word) + 1) div 2"))).cast("array<int>")
    w = words.select("word", "n", F.explode(halves).alias("size"))
    w = w.select("word", "n", "size", F.explode(F.array(F.lit(False), F.lit(True))).alias("ends"))
    affix = F.when(F.col("ends"), F.right("word", "size")).otherwise(F.left("word", "size"))
    w = w.withColumn("part", F.xxhash64("size", "ends", affix))
    large = w.groupBy("part").agg(F.ceil(F.count("*") / PART_WORDS).cast("int").alias("slices")).where("slices > 1")
    if large.isEmpty():
        return w.select("part", "size", "word", "n", "ends", F.lit(True).alias("member"), F.lit(True).alias("asks"))
    w = w.join(large, "part", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    w = w.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = F.pmod(F.xxhash64("word"), "slices") == F.col("slice")
    return w.select(F.xxhash64("part", "slice").alias("part"), "size", "word", "n", "ends", own.alias("member"), F.lit(True).alias("asks"))


def with_forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) for words (word, n): the near word of largest n, if that is FORM_RATIO times the word's."""
    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parted(words).repartition(tasks, "part").sortWithinPartitions("part")
    near = dealt.mapInArrow(_near_task, _NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    is_form = -F.col("best.minus") >= FORM_RATIO * F.col("n")
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: from the word, its form, that one's form and so on to the last.

    Forms are FORM_RATIO times as frequent as their words, so chains are short; each round doubles how far a word sees.
    """
    links, path = stored_at(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after, new_path = stored_at(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(forms.sparkSession, path)
        links, path = after.select("word", "root"), new_path
        if after.where("moved").isEmpty():
            return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary, as the contract has them.

    Null texts have no words; a document without an id counts as one with an empty id; repeated rows count again. An empty
    table gives no rows. Words are bytes of Latin letters, so no other column of the table matters.
    """
    words = stored(vocabulary(docs, text_col=text_col, id_col=id_col), "words")
    return with_roots(stored(with_forms(words), "forms")).select("word", "form", "root", "n", "n_near", "form_n")
