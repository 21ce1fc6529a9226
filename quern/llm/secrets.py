"""Secret scans by one deterministic automaton for all rules.

How a match of each rule begins is a regex of a fixed length. These are joined into one nondeterministic automaton that may
start anywhere, made deterministic by subset construction over byte classes, and minimised by partition refinement. A
text's UTF-8 bytes go through its transition arrays once; each state that shows a beginning gives a place where the rule
may match. From those places alone the rule's own automaton, compiled in the same way, runs on to the longest match.
Matches of a rule are taken from the left, without overlap, and too short ones are dropped after they have been taken.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from operator import length_hint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, packed_rows, unpacked_rows


@dataclass(frozen=True)
class Rule:
    """starts: regexes of a fixed length, one of which each match begins with, after `lead` bytes that are no part of it; match: the whole match; head: its part that does not count for `least`."""

    kind: str
    starts: tuple[str, ...]
    match: str
    head: str = ""
    least: int = 0
    lead: int = 0
    any_case: bool = False
    base: bool = False


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Base rules first, in the order in which kinds are listed; then those that the scan adds.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), _KEY + "[A-Za-z0-9+/_.=-]+", head=_KEY, least=8, any_case=True, base=True),
    Rule("access", ("AKIA[A-Z0-9]{12}",), "AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", ("[^0-9a-f][0-9a-f]{32}",), "[0-9a-f]+", least=32, lead=1, base=True),
    Rule("private_key", ("-----BEGIN ",), "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", ("gh[pousr]_[A-Za-z0-9]{4}",), "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", ("xox[abprs]-",), "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", ("AIza[A-Za-z0-9_-]",), "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", ("[sr]k_live_[A-Za-z0-9]",), "[sr]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", ("eyJ[A-Za-z0-9_-]{4}",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


class _Nfa:
    """Thompson's construction from a regex over bytes: literals, classes, groups, |, ?, *, + and counts."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, regex: str, at: int, any_case: bool) -> int:
        """The state that is reached from `at` by a match."""
        end, left = self._either(regex, at, any_case)
        if left:
            raise ValueError(f"a rule's regex has no automaton from {left!r} on")
        return end

    def _either(self, rest: str, at: int, any_case: bool) -> tuple[int, str]:
        end = self.state()
        while True:
            first = self.state()
            self.empty[at].append(first)
            last, rest = self._sequence(rest, first, any_case)
            self.empty[last].append(end)
            if not rest.startswith("|"):
                return end, rest
            rest = rest[1:]

    def _sequence(self, rest: str, at: int, any_case: bool) -> tuple[int, str]:
        while rest and rest[0] not in "|)":
            if rest[0] in "^$.*+?{":
                raise ValueError(f"a rule uses {rest[0]!r}, which has no automaton here")
            if rest[0] == "(":
                # the group is read for its end; each copy of it is read again
                _, after = self._either(rest[1:], self.state(), any_case)
                if not after.startswith(")"):
                    raise ValueError("a rule's group has no end")
                inner, rest = rest[1 : len(rest) - len(after)], after[1:]
                copy = lambda s, inner=inner: self._either(inner, s, any_case)[0]
            else:
                found, rest = _one(rest)
                if any_case:
                    found |= {ord(x) for b in found if b < 128 for x in (chr(b).lower(), chr(b).upper())}
                copy = functools.partial(self._step, frozenset(found))
            low, high, rest = _count(rest)
            for _ in range(low):
                at = copy(at)
            end = self.state()
            self.empty[at].append(end)
            if high is None:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[copy(loop)] += [loop, end]
            else:
                for _ in range(high - low):
                    at = copy(at)
                    self.empty[at].append(end)
            at = end
        return at, rest

    def _step(self, found: frozenset[int], at: int) -> int:
        after = self.state()
        self.moves[at].append((found, after))
        return after

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in out:
                    out.add(n)
                    todo.append(n)
        return frozenset(out)


def _character(rest: str) -> tuple[int, str]:
    if rest[0] != "\\":
        return ord(rest[0]), rest[1:]
    if rest[1] == "x":
        return int(rest[2:4], 16), rest[4:]
    return ord(rest[1]), rest[2:]


def _one(rest: str) -> tuple[set[int], str]:
    """The bytes of one character or class, and what follows it."""
    if rest[0] != "[":
        b, rest = _character(rest)
        return {b}, rest
    rest, inverse, found = rest[1:], False, set()
    if rest[0] == "^":
        rest, inverse = rest[1:], True
    while rest[0] != "]":
        first, rest = _character(rest)
        last = first
        if rest[0] == "-" and rest[1] != "]":
            last, rest = _character(rest[1:])
        found |= set(range(first, last + 1))
    return set(range(256)) - found if inverse else found, rest[1:]


def _count(rest: str) -> tuple[int, int | None, str]:
    """Least and most repetitions (None: any number), and what follows."""
    if rest[:1] in ("?", "*", "+"):
        return {"?": (0, 1), "*": (0, None), "+": (1, None)}[rest[0]] + (rest[1:],)
    if rest[:1] == "{":
        low, comma, high = rest[1 : rest.index("}")].partition(",")
        return int(low), int(low) if not comma else int(high) if high else None, rest[rest.index("}") + 1 :]
    return 1, 1, rest


@dataclass(frozen=True)
class Automaton:
    """classes: byte to class; rows: for each state, the next state by class; marks: for each state, what it shows; state 0 begins."""

    classes: bytes
    rows: list[list[int]]
    marks: list[frozenset[int]]


def deterministic(regexes: tuple[tuple[str, bool], ...], anywhere: bool) -> Automaton:
    """The minimal automaton of (regex, whether case is ignored); a state shows the numbers of the regexes that match up to it, from anywhere or from the first byte on."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for i, (regex, any_case) in enumerate(regexes):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(regex, first, any_case)] = i
    by_use = defaultdict(list)
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    for b in range(256):
        by_use[tuple(b in s for s in sets)].append(b)
    classes = bytearray(256)
    for c, found in enumerate(by_use.values()):
        for b in found:
            classes[b] = c
    one = [found[0] for found in by_use.values()]
    begin = nfa.closure([start])
    # only states with moves and ends tell subsets apart
    telling = frozenset(s for s in range(len(nfa.moves)) if nfa.moves[s] or s in ends)
    reach = [[frozenset() if not hit else nfa.closure(hit) & telling for b in one for hit in ([t for found, t in moves if b in found],)] for moves in nfa.moves]
    begin &= telling
    always = begin if anywhere else frozenset()
    number, subsets, rows = {begin: 0}, [begin], []
    for subset in subsets:  # grows while it is walked
        row = []
        for c in range(len(one)):
            after = always.union(*(reach[s][c] for s in subset))
            if after not in number:
                number[after] = len(subsets)
                subsets.append(after)
            row.append(number[after])
        rows.append(row)
    return _minimised(bytes(classes), rows, [frozenset(ends[s] for s in subset if s in ends) for subset in subsets])


def _minimised(classes: bytes, rows: list[list[int]], marks: list[frozenset[int]]) -> Automaton:
    """States that no text tells apart become one: parts are split by mark and by the parts they lead to, until nothing changes."""
    part, n = {m: i for i, m in enumerate(dict.fromkeys(marks))}, 0
    of = [part[m] for m in marks]
    while n != len(part):
        n = len(part)
        keys = [(of[s], *(of[t] for t in row)) for s, row in enumerate(rows)]
        part = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        of = [part[k] for k in keys]
    out_rows, out_marks = [[]] * n, [frozenset()] * n
    for s, row in enumerate(rows):
        out_rows[of[s]], out_marks[of[s]] = [of[t] for t in row], marks[s]
    return Automaton(classes, out_rows, out_marks)


class _Shown:
    """A state that shows a beginning: not to be indexed, so that the pass stops there and nowhere else."""

    __slots__ = ("marks", "row")


class _Longest:
    """The longest match of one regex from a place on."""

    def __init__(self, regex: str, any_case: bool):
        a = deterministic(((regex, any_case),), anywhere=False)
        # no way leads from the empty subset to a match
        alive = {s for s, m in enumerate(a.marks) if m}
        while True:
            more = {s for s, row in enumerate(a.rows) if s not in alive and alive.intersection(row)}
            if not more:
                break
            alive |= more
        self.rows = [[row[c] if row[c] in alive else -1 for c in a.classes] for row in a.rows]
        self.ends = [bool(m) for m in a.marks]

    def end(self, data: bytes, at: int) -> int:
        """Where it ends, or -1 for no match."""
        state, rows, ends = 0, self.rows, self.ends
        last = at if ends[0] else -1
        for at in range(at, len(data)):
            state = rows[state][data[at]]
            if state < 0:
                break
            if ends[state]:
                last = at + 1
        return last


def _fixed_length(regex: str) -> int:
    """Bytes of every match of a regex of a fixed length."""
    n = 0
    while regex:
        _, regex = _one(regex)
        low, high, regex = _count(regex)
        if low != high:
            raise ValueError("a rule's beginning must have a fixed length")
        n += low
    return n


class Scanner:
    """All rules over whole texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        starts = [(i, s) for i, r in enumerate(rules) for s in r.starts]
        self.automaton = deterministic(tuple((s, rules[i].any_case) for i, s in starts), anywhere=True)
        self.beginnings = [(i, _fixed_length(s) - rules[i].lead) for i, s in starts]
        self.matches = [_Longest(r.match, r.any_case) for r in rules]
        self.heads = [_Longest(r.head, r.any_case) if r.head else None for r in rules]
        nodes = [_Shown() if m else [] for m in self.automaton.marks]
        for node, row, marks in zip(nodes, self.automaton.rows, self.automaton.marks):
            full = [nodes[row[c]] for c in self.automaton.classes]
            if marks:
                node.marks, node.row = sorted(marks), full
            else:
                node.extend(full)
        # as if a line had ended before the text, for beginnings with a lead
        first = nodes[0].row if isinstance(nodes[0], _Shown) else nodes[0]
        self.start = first[10]

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """(place, rule's number) where a rule's match may begin, in one pass over the bytes."""
        state, rest, out, n = self.start, iter(data), [], len(data)
        while True:
            try:
                for b in rest:
                    state = state[b]
                break
            except TypeError:
                # the byte after the shown state has been taken from the iterator
                end = n - length_hint(rest) - 1
                out += [(end - self.beginnings[m][1], self.beginnings[m][0]) for m in state.marks]
                state = state.row[b]
        if isinstance(state, _Shown):
            out += [(n - self.beginnings[m][1], self.beginnings[m][0]) for m in state.marks]
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule's number, end) in code points, in order."""
        data = text.encode()
        found = self.places(data)
        if not found:
            return []
        out, done = [], [0] * len(self.rules)
        for start, i in sorted(found):
            if start < done[i]:
                continue
            end = self.matches[i].end(data, start)
            if end >= 0:
                done[i] = end
                counted = self.heads[i].end(data, start) if self.heads[i] else start
                if end - counted >= self.rules[i].least:
                    out.append((start, i, end))
        if len(data) != len(text):
            # continuation bytes are no code points of their own
            out = [(len(data[:s].decode()), i, len(data[:e].decode())) for s, i, e in out]
        return out


@functools.cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One scanner for each process and set of rules."""
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _found(rules: tuple[Rule, ...], column: pa.Array) -> Iterator[tuple[str | None, list[tuple[int, int, int]]]]:
    scan = scanner(rules)
    return ((t, scan.spans(t) if t else []) for t in column.to_pylist())


def _spans_task(rules: tuple[Rule, ...]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches):
        for b in batches:
            spans = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in x] for _, x in _found(rules, b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["_keep", "spans"])

    return task


def _mask_task(rules: tuple[Rule, ...], mask: str):
    def task(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redacted(t, s, mask) for t, s in _found(rules, b.column(1))], pa.string())], names=["_row", "_masked"])

    return task


def redacted(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    """The text with each run of covered characters replaced by the mask."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start > at or not out and start == at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of keep (default doc_id) and `spans`, an array of (kind, start, end) in code points, by start and then rule.

    Null and empty texts have no spans; repeated rows are scanned alike; the result has a row for each row of docs. A kept
    column named spans gives way to the result.
    """
    rows = packed_rows(docs, keep, text_col)
    found = rows.mapInArrow(_spans_task(rules), f"_keep {rows.schema['_keep'].dataType.simpleString()}, spans {SPANS}")
    return unpacked_rows(found, "spans")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by the mask; texts without spans stay as they are, and so do all other columns."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text_col]
    # the other columns travel as one, so that none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(text_col).alias("_text")) if names else docs.select(F.lit(1).alias("_row"), F.col(text_col).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_mask_task(rules, mask), f"_row {kind}, _masked string")
    return out.select(*(F.col("_masked").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and the joined spans."""
    spans = secret_spans(docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in RULES if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of a list of spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
