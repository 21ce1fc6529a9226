"""Toxicity by a support vector machine over a gapped subsequence kernel of sentences, with Nystrom landmarks.

The kernel of two words counts the subsequences of three and of five letters that they share, gaps allowed within SPAN
letters and weighted by DECAY for each letter skipped, so an insult with gaps or letters put in still looks like itself; a
start mark is part of each word, subsequences of any script are hashed into BUCKETS numbers, and rare ones weigh more. The
kernel of two sentences is the sum over their different words, over a root that grows with the words' numbers. Landmarks
are sentences of labelled texts; the Nystrom map sends a sentence to k(sentence, landmarks) K_LL^(-1/2), where a linear
machine is fitted by squared hinge loss. Its weights then collapse into one weight for each subsequence, so that scoring
costs the same for any number of landmarks.

Labels belong to texts, which are bags of sentences: a text is as toxic as its worst sentence. Training goes in rounds:
each labelled text hands on its worst sentence by the machine so far (at first: by the odds of subsequences in toxic texts
against clean ones), and the machine is fitted on those sentences. A text's score is a logistic function of the three
greatest margins of its sentences and of their number. Every sentence of every text is scored.
"""

from __future__ import annotations

import itertools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, packed_rows, stored, unpacked_rows
from quern.llm.language import held_out

SPAN, DECAY = 6, 0.8
#: Places of a subsequence's letters after its first.
PATTERNS = [p for n in (2, 4) for p in itertools.combinations(range(1, SPAN), n)]
WEIGHTS = np.array([DECAY ** (p[-1] - len(p)) for p in PATTERNS], np.float32)
#: Hashed subsequences; number 0 stands for none.
BUCKETS = 1 << 17
#: Letters of a unit with its start mark, and units of a sentence; longer words and sentences are several.
WIDTH, SENTENCE = 24, 24
#: Defaults of learn_toxicity: labelled texts that are fitted on, landmarks, rounds of choosing sentences.
TRAIN_ROWS, LANDMARKS, ROUNDS = 20_000, 256, 3
#: Added to the number of a sentence's words under the root, so that one odd word alone is no stronger than in a sentence.
SHORT = 8
#: Numbers that a text's score is made of, and the margin of a sentence that is not there.
EVIDENCE, NONE = 4, -2.0
#: Sentences that a toxic text hands on in a round.
WORST = 3
#: Different words whose units and margins a task keeps; a bound on its memory: beyond it the task starts anew with the next group of texts.
HELD_WORDS = 300_000
#: Letters of texts that are split at a time, but for a longer text; and marks of words that are no unit, one letter, or several units.
GROUP = 1 << 20
NOTHING, LETTER, LONG = -1, -2, -3
#: Signs put between letters, and digits written for letters.
PLAIN = str.maketrans({c: None for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$"} | dict(zip("013457@$", "oieastas")))
_END = re.compile(r"(?<=[.!?])\s+|[\n\r]+")


def plain(word: str) -> str:
    return word if word.isalpha() else word.translate(PLAIN)


def units(text: str) -> list[str]:
    """Lower-case words with a start mark and without signs in or around them, digits in words of letters read as letters.

    A run of three or more single letters is one word; a word longer than WIDTH is several overlapping parts.
    """
    return joined([plain(w) for w in text.lower().split()])


def joined(words: list[str]) -> list[str]:
    """The units of a sentence's plain words."""
    out, run = [], []

    def add(word: str) -> None:
        word = "^" + word
        if len(word) <= WIDTH:
            out.append(word)
        else:
            out.extend(word[i : i + WIDTH] for i in range(0, len(word) - SPAN, WIDTH - SPAN))

    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            add("".join(run))
        if run:
            run = []
        if len(w) < WIDTH:
            if w:
                out.append("^" + w)
        else:
            add(w)
    if len(run) > 2:
        add("".join(run))
    return out


def sentences(text: str | None) -> list[list[str]]:
    """The different units of each sentence, at most SENTENCE at a time: what Splitter finds, written out."""
    out = []
    for part in _END.split(text or ""):
        found = list(dict.fromkeys(units(part)))
        out.extend(found[i : i + SENTENCE] for i in range(0, len(found), SENTENCE))
    return out


class Numbers(dict):
    """Numbers for names, in the order in which they are first asked for."""

    def __init__(self):
        self.names = []

    def __missing__(self, name: str) -> int:
        n = self[name] = len(self.names)
        self.names.append(name)
        return n


@dataclass(frozen=True)
class Sentences:
    """Sentences of a group of texts: sentence i has units[starts[i] : starts[i + 1]], numbers in `names`; text i has sentences bounds[i] to bounds[i + 1]."""

    names: list[str]
    units: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray

    def sentence(self, i: int) -> list[str]:
        return [self.names[k] for k in self.units[self.starts[i] : self.starts[i + 1]]]


class Splitter:
    """Sentences as numbers of units, as sentences() has them; a task has its own, which looks at each different word once.

    A sentence ends with a word that ends with a stop, or with its line. Only sentences with runs of single letters or
    with long words are put together word by word.
    """

    def __init__(self):
        self.begin()

    def begin(self) -> None:
        self.words, self.units = Numbers(), Numbers()
        self.unit, self.stops = np.zeros(0, np.int32), np.zeros(0, bool)

    def look(self) -> None:
        """The units of new words, and whether a sentence ends with them."""
        new, unit = self.words.names[len(self.unit) :], []
        for w in new:
            w = plain(w)
            unit.append(LONG if len(w) >= WIDTH else self.units["^" + w] if len(w) > 1 else LETTER if w else NOTHING)
        self.unit = np.append(self.unit, np.array(unit, np.int32))
        self.stops = np.append(self.stops, np.array([w[-1] in ".!?" for w in new], bool))

    def group(self, texts: list[str | None]) -> Sentences:
        if len(self.words) > HELD_WORDS:
            self.begin()
        word, lines, ends, number = array("i"), [], [], self.words.__getitem__
        for t in texts:
            for line in (t or "").lower().replace("\r", "\n").split("\n"):
                word.extend(map(number, line.split()))
                lines.append(len(word))
            ends.append(len(word))
        word = np.array(word)
        self.look()
        unit, last, lines = self.unit[word], self.stops[word], np.array(lines, np.int64)
        last[lines[lines > 0] - 1] = True
        sentence, stop = np.cumsum(last) - last, np.flatnonzero(last)
        letter = unit == LETTER
        runs = np.flatnonzero(letter[:-2] & letter[1:-1] & letter[2:] & (sentence[:-2] == sentence[2:]))
        more, where = [], []
        for k in np.unique(sentence[np.append(runs, np.flatnonzero(unit == LONG))]).tolist():
            begin, end = (stop[k - 1] + 1 if k else 0), stop[k] + 1
            unit[begin:end] = NOTHING
            more += [self.units[u] for u in joined([plain(self.words.names[w]) for w in word[begin:end].tolist()])]
            where += [k] * (len(more) - len(where))
        at = np.flatnonzero(unit >= 0)
        unit, sentence = unit[at], sentence[at]
        if more:
            unit, sentence = np.append(unit, np.array(more, np.int32)), np.append(sentence, where)
            order = np.argsort(sentence, kind="stable")
            unit, sentence = unit[order], sentence[order]
        # the first of each unit in its sentence, in the order of the text
        first = np.sort(np.unique(sentence * max(len(self.units), 1) + unit, return_index=True)[1])
        unit, sentence = unit[first], sentence[first]
        new = np.flatnonzero(np.diff(sentence, prepend=-1))
        place = np.arange(len(unit)) - np.repeat(new, np.diff(np.append(new, len(unit))))
        starts = np.flatnonzero(place % SENTENCE == 0)
        # a sentence is of the first text that ends behind its last word
        bounds = np.searchsorted(stop[sentence[starts]], np.append(0, ends))
        return Sentences(self.units.names, unit, np.append(starts, len(unit)), bounds)


def grouped(texts: list[str | None]):
    """Texts in turn, in groups of some GROUP letters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= GROUP:
            yield some
            some, size = [], 0
    if some:
        yield some


def subsequences(words: list[str], most: int = 2048):
    """For parts of the units, of like lengths: their places, the numbers of their subsequences (a column for each pattern and place, 0: none), the columns' weights and the roots of the summed squared weights."""
    sizes = np.array([len(w) for w in words])
    for width in range(4, WIDTH + 4, 4):
        chosen = np.flatnonzero((sizes <= width) & (sizes > width - 4))
        for k in range(0, len(chosen), most):
            part = chosen[k : k + most]
            flat = np.frombuffer("".join(words[i].ljust(width, "\0") for i in part).encode("utf-32-le", "replace"), np.uint32).reshape(len(part), width)
            columns, weights, total = [], [], np.full(len(part), 1e-9)
            for pattern, w in zip(PATTERNS, WEIGHTS):
                last = pattern[-1]
                if last >= width:
                    continue
                h = flat[:, :-last] * np.uint32(0x9E3779B1)
                for at in pattern:
                    h = (h + flat[:, at : width - last + at]) * np.uint32(0x85EBCA77)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                columns.append(np.where(flat[:, last:] > 0, 1 + ((h >> np.uint32(8)) & np.uint32(BUCKETS - 2)), 0))
                weights.append(np.full(width - last, w))
                total += np.maximum(sizes[part] - last, 0) * float(w) ** 2
            yield part, np.concatenate(columns, axis=1).astype(np.int32), np.concatenate(weights), np.sqrt(total)


@dataclass(frozen=True)
class ToxicityModel:
    """table: a weight for each subsequence; bias: of a sentence's margin; text: weights of a text's evidence, the constant last."""

    table: np.ndarray
    bias: float
    text: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """What each unit adds to the margin of its sentence."""
        out = np.zeros(len(words))
        for part, columns, weights, norms in subsequences(words):
            out[part] = (self.table[columns] @ weights) / norms
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.text[:-1] + self.text[-1], -30, 30)))


class Scorer(Splitter):
    """Margins of texts by one model; a task has its own, which keeps the margins of its units."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        super().__init__()

    def begin(self) -> None:
        super().begin()
        self.held = np.zeros(0)

    def texts(self, texts: list[str | None]):
        """For each group of texts: its sentences and their margins."""
        for some in grouped(texts):
            found = self.group(some)
            self.held = np.append(self.held, self.model.margins(found.names[len(self.held) :]))
            sums = np.add.reduceat(self.held[found.units], found.starts[:-1])
            yield found, sums / np.sqrt(np.diff(found.starts) + SHORT) + self.model.bias

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the greatest three margins of its sentences (NONE for one that is not there) and the log of their number."""
        out, i = np.full((len(texts), EVIDENCE), NONE), 0
        for found, margins in self.texts(texts):
            for begin, end in itertools.pairwise(found.bounds.tolist()):
                top = -np.sort(-margins[begin:end])[: EVIDENCE - 1]
                out[i, : len(top)] = top
                out[i, -1] = np.log1p(end - begin)
                i += 1
        return out


def kernel(a: list[str], b: list[str], rarity: np.ndarray) -> float:
    """The kernel of two sentences, written out; `rarity` weighs each subsequence."""

    def features(sentence):
        out = np.zeros(BUCKETS)
        for _, columns, weights, norms in subsequences(sentence):
            np.add.at(out, columns, weights[None, :] / norms[:, None])
        out[0] = 0
        return out * rarity / np.sqrt(len(sentence) + SHORT)

    return float(features(a) @ features(b))


def _landmark_table(marks: list, rarity: np.ndarray) -> np.ndarray:
    """A column of weighed subsequences for each landmark."""
    out = np.zeros((BUCKETS, len(marks)), np.float32)
    for i, s in enumerate(marks):
        s = s.split(" ") if isinstance(s, str) else s
        for _, columns, weights, norms in subsequences(s):
            np.add.at(out[:, i], columns, weights[None, :] / norms[:, None] / np.sqrt(len(s) + SHORT))
    out[0] = 0
    out *= rarity.astype(np.float32)[:, None]
    return out


def _kernel_rows(some: list, weighed: np.ndarray) -> np.ndarray:
    """The kernel of each sentence (units, or these joined by blanks) with all landmarks, whose weighed subsequences times rarity are `weighed` (a row for each subsequence)."""
    out = np.zeros((len(some), weighed.shape[1]), np.float32)
    for k in range(0, len(some), 2048):
        part = [s.split(" ") if isinstance(s, str) else s for s in some[k : k + 2048]]
        words = sorted({w for s in part for w in s})
        number = {w: i for i, w in enumerate(words)}
        by_word = np.zeros((len(words), weighed.shape[1]), np.float32)
        for at, columns, weights, norms in subsequences(words, 64):
            by_word[at] = np.tensordot(weights, weighed[columns], axes=(0, 1)) / norms[:, None]
        n = np.array([len(s) for s in part])
        flat = np.array([number[w] for s in part for w in s])
        out[k : k + 2048] = np.add.reduceat(by_word[flat], np.cumsum(n) - n) / np.sqrt(n + SHORT)[:, None]
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3, rows: int = 4096) -> tuple[np.ndarray, float]:
    """Weights and bias of least ridge * |w|^2 + sum of weights * max(0, 1 - y(zw + b))^2, by Newton's steps over `rows` rows at a time."""
    w, weights = np.zeros(z.shape[1] + 1), weights / weights.sum()
    penalty = np.append(np.full(z.shape[1], ridge), 1e-9)

    def slack(v: np.ndarray) -> np.ndarray:
        return np.maximum(0, 1 - y * (z @ v[:-1].astype(z.dtype) + v[-1]))

    def loss(v: np.ndarray) -> float:
        return float(penalty @ (v * v) + weights @ slack(v) ** 2)

    for _ in range(40):
        left = slack(w)
        gradient, curve = 2 * penalty * w, np.diag(2 * penalty + 1e-9)
        for k in range(0, len(z), rows):
            inside = k + np.flatnonzero(left[k : k + rows])
            x = np.column_stack([z[inside], np.ones(len(inside))]).astype(float)
            gradient -= 2 * x.T @ (weights[inside] * y[inside] * left[inside])
            curve += 2 * (x.T * weights[inside]) @ x
        step, before, size = np.linalg.solve(curve, gradient), loss(w), 1.0
        while loss(w - size * step) > before and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_machine(toxic: list, clean: list, rarity: np.ndarray, *, landmarks: int = LANDMARKS, seed: int = 5) -> tuple[np.ndarray, float]:
    """table and bias of a linear machine on the Nystrom map of labelled sentences, which are lists of units or these joined by blanks."""
    rng = np.random.default_rng(seed)
    half = landmarks // 2
    some = [toxic[i] for i in rng.permutation(len(toxic))[:half]]
    some += [clean[i] for i in rng.permutation(len(clean))[: landmarks - len(some)]]
    weighed = _landmark_table(some, rarity)
    values, vectors = np.linalg.eigh((weighed.T @ weighed).astype(float))
    fit = values > 1e-4 * values.max()
    root = vectors[:, fit] / np.sqrt(values[fit])
    weighed *= rarity.astype(np.float32)[:, None]
    z = _kernel_rows(toxic + clean, weighed) @ root.astype(np.float32)
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    weights = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean))
    w, bias = squared_hinge(z, y, weights)
    return (weighed @ (root @ w)).astype(np.float32), bias


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def _presence_task(batches):
    """How many texts of either label have each subsequence."""
    counts, split = np.zeros((2, BUCKETS), np.int64), Splitter()
    for b in batches:
        labels = iter(b.column(1).to_pylist())
        for some in grouped(b.column(0).to_pylist()):
            found = split.group(some)
            used, place = np.unique(found.units, return_inverse=True)
            buckets = [None] * len(used)
            for part, columns, _, _ in subsequences([found.names[k] for k in used]):
                for k, row in zip(part.tolist(), columns):
                    buckets[k] = row
            for begin, end in itertools.pairwise(found.starts[found.bounds].tolist()):
                seen = np.zeros(BUCKETS, bool)
                if begin < end:
                    seen[np.concatenate([buckets[k] for k in set(place[begin:end].tolist())])] = True
                counts[int(next(labels) > 0.5)] += seen
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "clean", "toxic"])


def _choose_task(model: ToxicityModel):
    """Of each text: its worst sentence, of a toxic one WORST at most that are found toxic, and of a clean one another by chance, so that plain sentences are seen too."""

    def task(batches):
        scorer = Scorer(model)
        for b in batches:
            rows, labels = [], iter(b.column(1).to_pylist())
            for found, margins in scorer.texts(b.column(0).to_pylist()):
                for begin, end in itertools.pairwise(found.bounds.tolist()):
                    y = next(labels)
                    if begin < end:
                        m = margins[begin:end]
                        worst = np.argsort(-m, kind="stable")[: WORST if y > 0.5 else 1]
                        rows += [(y, found.sentence(begin + i)) for k, i in enumerate(worst) if not k or m[i] > 0]
                        if y <= 0.5:
                            rows.append((y, found.sentence(begin + sum(map(len, found.sentence(begin))) % (end - begin))))
            # units hold no blanks
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([" ".join(r[1]) for r in rows], pa.string())], names=["y", "sentence"])

    return task


def _evidence_task(model: ToxicityModel):
    def task(batches):
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer.evidence(b.column(0).to_pylist()).tolist(), pa.list_(pa.float64())), b.column(1)], names=["evidence", "y"])

    return task


def _score_task(model: ToxicityModel):
    def task(batches):
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(scorer.evidence(b.column(1).to_pylist())), pa.float64())], names=["_keep", "score"])

    return task


def sampled_texts(labelled: DataFrame, most: int) -> DataFrame:
    """(text, y) of (text, label, h): each different text once with the share of label 1 among its rows, the `most` least by h, its hash.

    The cut is the hash that many texts reach, so that copies change neither the number of texts nor the draw.
    """
    known = labelled.select("text", "h", (F.col("label").cast("double") > 0.5).cast("double").alias("y")).where("text IS NOT NULL AND y IS NOT NULL")
    last = known.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return known.where(F.col("h") <= F.lit(last)).groupBy("text").agg(F.avg("y").alias("y"))


def learn_toxicity(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", hash_col: str | None = None, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> ToxicityModel:
    """Fit on (text, label) rows: at most train_rows different texts, in order of a hash of the text; nulls are left out.

    A text counts once, as toxic if more than half of its rows are. With no labelled rows, or only one label, every
    text's score is the smoothed share of label 1 over the texts. WORST sentences a text come to the driver at most.
    hash_col: xxhash64 of the text, for rows that come of a join, which then deals out no text that is not fitted on.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    known = stored(sampled_texts(labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), (F.col(hash_col) if hash_col else F.xxhash64(text_col)).alias("h")), train_rows), "toxicity-texts")
    bad, n = known.agg(F.coalesce(F.sum((F.col("y") > 0.5).cast("long")), F.lit(0)), F.count("*")).first()
    if not bad or bad == n:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, np.append(np.zeros(EVIDENCE), np.log((bad + 0.5) / (n - bad + 0.5)) if n else -4.0))
    counts = np.zeros((2, BUCKETS))
    seen = known.mapInArrow(_presence_task, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    counts[:, seen["bucket"]] = seen["clean"], seen["toxic"]
    rarity = np.log((n - bad + 2.0) / (counts[0] + 1.0))
    odds = np.log((counts[1] + 1) / (bad + 2)) - np.log((counts[0] + 1) / (n - bad + 2))
    sure = odds / np.sqrt(1 / (counts[1] + 1) + 1 / (counts[0] + 1))
    model = ToxicityModel((rarity * np.where(sure > 3, odds, 0)).astype(np.float32), 0.0, np.zeros(EVIDENCE + 1))
    for _ in range(rounds):
        chosen = known.mapInArrow(_choose_task(model), "y double, sentence string").toPandas()
        # in one order whatever the tasks' order was
        parts = [sorted(chosen["sentence"][rows]) for rows in (chosen["y"] > 0.5, chosen["y"] <= 0.5)]
        if not all(parts):
            break
        model = ToxicityModel(*fit_machine(*parts, rarity, landmarks=landmarks), np.zeros(EVIDENCE + 1))
    got = sorted((*r["evidence"], float(r["y"] > 0.5)) for r in known.mapInArrow(_evidence_task(model), "evidence array<double>, y double").collect())
    return ToxicityModel(model.table, model.bias, _logistic(np.array(got)[:, :-1], np.array(got)[:, -1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default doc_id), score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have the score of a text without words; repeated rows are scored alike; the names in keep may be
    any.
    """
    rows = packed_rows(docs, keep, text_col)
    scored = rows.mapInArrow(_score_task(model), f"_keep {rows.schema['_keep'].dataType.simpleString()}, score double")
    return unpacked_rows(scored, F.col("score").alias("score"), (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A model from the labelled documents that are not held out, scores for all."""
    marked = docs.select("doc_id", "text", held_out(5, 0).alias("held_out"))
    labelled = marked.where(~F.col("held_out")).withColumn("h", F.xxhash64("text")).join(labels.select("doc_id", "toxic"), "doc_id").select("text", "toxic", "h")
    return score_toxicity(marked, learn_toxicity(labelled, hash_col="h"), keep=["doc_id", "held_out"])
