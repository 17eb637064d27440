"""Operator 10. Secret scans by one deterministic automaton.

A rule is a lead, then a run of body characters, with a least length of the run or of the whole. For each rule the regular
expression "lead and the first body characters" is turned into a nondeterministic automaton; all are joined behind "any
bytes", made deterministic by subset construction over byte classes, and minimised by partition refinement. The result is an
array of 256 successors for each state. A scan follows it once, byte by byte, for all rules; where a state accepts, the lead is
measured by a reversed automaton of the rule's lead, and the run's end by its body set. A match covers its run even if it is
too short to count, so matches of a rule never overlap, leftmost first. A rule with a tail ends at the first tail after its lead that
only body characters lead to, so a private key is found from its first line to its last. A key that has no last line is taken
with the unbroken characters after its first line.

Null texts are empty. Offsets are code points, end exclusive. A null doc_id stays null, repeated rows give equal rows, an empty
table an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches


@dataclass(frozen=True)
class Rule:
    kind: str
    lead: str
    body: str
    least_body: int = 1
    least_all: int = 1
    base: bool = False
    tail: str = ""

    def whole(self) -> str:
        """The rule as one expression, where a tail ends it."""
        return f"{self.lead}{self.body}*{self.tail}"


#: Fixed formats of secrets. The first three are the base. Keys that are not ended (OPEN) count only outside whole ones.
OPEN, ENDED = "private_key_open", "private_key"
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?""", r"[A-Za-z0-9+/_.=-]", least_body=6, base=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", least_all=20, base=True),
    Rule("hex", r"", r"[0-9a-f]", least_body=24, base=True),
    Rule("private_key", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----", "[A-Za-z0-9+/=:,. \t\r\n-]", tail=r"-----END( [A-Z]+)* PRIVATE KEY-----"),
    Rule("private_key_open", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----", "[A-Za-z0-9+/=\r\n]"),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", least_body=36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", least_body=24),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_.-]", least_body=60),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]", least_body=35),
)


class _Nfa:
    """States with byte sets and empty moves, built from a regular expression of characters, classes, groups, |, ?, * and +."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, rule: str, backwards: bool = False) -> tuple[int, int]:
        self.text, self.at = rule, 0
        tree = self._either()
        if self.at != len(rule):
            raise ValueError(f"{rule}: can't read what begins at {self.at}")
        return self._build(tree, backwards)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self):
        ways = [self._row()]
        while self._peek() == "|":
            self._take()
            ways.append(self._row())
        return ("or", ways)

    def _row(self):
        parts = []
        while self._peek() and self._peek() not in "|)":
            part = self._atom()
            while self._peek() and self._peek() in "?*+":
                part = (self._take(), part)
            parts.append(part)
        return ("row", parts)

    def _atom(self):
        c = self._take()
        if c == "(":
            part = self._either()
            self._take()
            return part
        if c != "[":
            return ("set", frozenset([ord(self._take() if c == "\\" else c)]))
        members: set[int] = set()
        while (c := self._take()) != "]":
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._take()
                members.update(range(ord(c), ord(self._take()) + 1))
            else:
                members.add(ord(c))
        return ("set", frozenset(members))

    def _build(self, tree, backwards: bool) -> tuple[int, int]:
        a, b = self.state(), self.state()
        kind, x = tree
        if kind == "set":
            self.moves[a].append((x, b))
        elif kind == "row":
            last = a
            for part in reversed(x) if backwards else x:
                i, j = self._build(part, backwards)
                self.free[last].append(i)
                last = j
            self.free[last].append(b)
        else:
            for way in x if kind == "or" else [x]:
                i, j = self._build(way, backwards)
                self.free[a].append(i)
                self.free[j].append(b)
                if kind in "*+":
                    self.free[j].append(i)
            if kind in "*?":
                self.free[a].append(b)
        return a, b


def compile_rules(parts: list[str], anywhere: bool, backwards: bool = False) -> tuple[np.ndarray, list[int]]:
    """(successors[states, 256], accepted rules of each state as bits); state 0 is the start. With `anywhere` a match may begin at any byte."""
    nfa = _Nfa()
    ends = [nfa.add(p, backwards) for p in parts]
    accepts = {b: 1 << k for k, (_, b) in enumerate(ends)}

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for y in nfa.free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)

    begin = closure([a for a, _ in ends])
    sets = {s for moves in nfa.moves for s, _ in moves}
    classes: dict[tuple, list[int]] = {}
    for byte in range(256):
        classes.setdefault(tuple(byte in s for s in sets), []).append(byte)
    number, todo, rows = {begin: 0}, [begin], {}
    while todo:
        now = todo.pop()
        row = rows[number[now]] = []
        for members in classes.values():
            to = {y for x in now for s, y in nfa.moves[x] if members[0] in s}
            to = closure(to) | begin if anywhere else closure(to)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
    table = np.array([rows[i] for i in range(len(rows))])
    accepted = np.zeros(len(rows), np.int64)
    for states, i in number.items():
        accepted[i] = sum(accepts[x] for x in states if x in accepts)
    block = np.unique(accepted, return_inverse=True)[1]
    while True:  # states stay together whose successors are together
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    order = {b: n for n, b in enumerate(dict.fromkeys(block.tolist()))}  # the start's block first
    pick = {order[b]: i for i, b in reversed(list(enumerate(block.tolist())))}
    small = np.array([[order[int(block[t])] for t in table[pick[n]]] for n in range(len(order))])
    wide = np.zeros((len(small), 256), np.int64)
    for c, members in enumerate(classes.values()):
        wide[:, members] = small[:, [c]]
    return wide, [int(accepted[pick[n]]) for n in range(len(order))]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        #: A rule without a lead fires when its run is long enough, others at the run's first byte, for a short run is consumed too.
        self.need = [1 if r.lead else max(r.least_body, r.least_all) for r in rules]
        table, accepted = compile_rules([r.whole() if r.tail else r.lead + r.body * n for r, n in zip(rules, self.need, strict=True)], anywhere=True)
        self.states: list[list] = [[] for _ in table]
        for state, row, bits in zip(self.states, table.tolist(), accepted, strict=True):
            state += [self.states[t] for t in row]
            state.append([k for k in range(len(rules)) if bits >> k & 1])
        self.leads = [compile_rules([r.whole() if r.tail else r.lead], anywhere=False, backwards=True) if r.lead else None for r in rules]
        self.bodies = [frozenset(np.flatnonzero(compile_rules([r.body], anywhere=False)[0][0] != self._dead(r.body)).tolist()) for r in rules]

    @staticmethod
    def _dead(body: str) -> int:
        table, accepted = compile_rules([body], anywhere=False)
        return next(i for i, row in enumerate(table.tolist()) if not accepted[i] and set(row) == {i})

    def _begin(self, data: bytes, k: int, at: int, low: int) -> int | None:
        """Where the lead of rule k that ends before `at` begins, not before `low`; None if there is none."""
        table, accepted = self.leads[k]
        state, best = 0, None
        for i in range(at - 1, low - 1, -1):
            state = int(table[state, data[i]])
            if accepted[state]:
                best = i
            elif (table[state] == state).all():
                break
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start."""
        out, last, state = [], [0] * len(self.rules), self.states[0]
        for at, byte in enumerate(data):
            state = state[byte]
            if state[256]:
                for k in state[256]:
                    if at < last[k]:
                        continue
                    rule = self.rules[k]
                    body = at + 1 if rule.tail else at - self.need[k] + 1
                    start = self._begin(data, k, body, last[k]) if self.leads[k] else body
                    if start is None or start < last[k]:
                        if rule.tail:
                            last[k] = at + 1  # what doesn't begin before this end doesn't for a later one
                        continue
                    end, members = at + 1, self.bodies[k]
                    while not rule.tail and end < len(data) and data[end] in members:
                        end += 1
                    last[k] = end
                    if end - body >= rule.least_body * (not rule.tail) and end - start >= rule.least_all:
                        out.append((k, start, end))
        out = sorted(out, key=lambda x: (x[1], x[0]))
        if not any(self.rules[k].kind == OPEN for k, _, _ in out):
            return out
        kept, within = [], -1
        for k, a, b in out:
            if self.rules[k].kind == ENDED:
                within = b
            if self.rules[k].kind != OPEN or a >= within:
                kept.append((k, a, b))
        return kept


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, stop, base) of each document, by start, then in the order of the rules."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        for table in text_batches(batches):
            out = []
            for t in table["text"]:
                data, found = (t.as_py() or "").encode("utf-8", "surrogatepass"), []
                plain, byte, point = data.isascii(), 0, 0
                for k, a, b in scanner.spans(data):
                    point += a - byte if plain else len(data[byte:a].decode("utf-8", "surrogatepass"))
                    byte, start = a, point
                    found.append({"kind": rules[k].kind, "start": start, "stop": start + b - a, "base": rules[k].base})  # spans are ASCII
                out.append(found)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(out, span)], names=["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:int,stop:int,base:boolean>>")
