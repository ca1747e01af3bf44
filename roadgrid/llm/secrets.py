"""Secret scans by one deterministic automaton for all rules, run over each text's bytes once."""

from __future__ import annotations

import itertools
import operator
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import mapped
from roadgrid.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are scanned at once, but for a longer text.
CHUNK = 1 << 20
#: No UTF-8 text has it: ends every match between two texts.
END = 0xFF


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group of the match (0: all) has at least so many characters, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 24),
)
RULES = BASE_RULES + MORE_RULES


# --- regex to NFA ------------------------------------------------------------
# The syntax that rules use: literals, \xHH and escaped literals, classes with
# ranges, groups, (?i:...), alternation, ? * +. Bytes are ASCII.


class _Nfa:
    """Thompson's construction; edges[state] = [(set of bytes, state)], free[state] = [state]."""

    def __init__(self, pattern: str):
        self.p, self.at, self.edges, self.free = pattern, 0, [], []
        self.start, self.accept = self._either(False)
        if self.at != len(pattern):
            raise ValueError(f"unbalanced: {pattern}")

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _either(self, fold: bool):
        ends = [self._row(fold)]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            ends.append(self._row(fold))
        if len(ends) == 1:
            return ends[0]
        a, b = self._state(), self._state()
        for x, y in ends:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def _row(self, fold: bool):
        a = b = self._state()
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            x, y = self._atom(fold)
            sign = self.p[self.at : self.at + 1]
            if sign and sign in "?*+":
                self.at += 1
                s, t = self._state(), self._state()
                self.free[s].append(x)
                self.free[y].append(t)
                if sign in "?*":
                    self.free[s].append(t)
                if sign in "*+":
                    self.free[y].append(x)
                x, y = s, t
            self.free[b].append(x)
            b = y
        return a, b

    def _one(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c == "\\":
            c = self.p[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.p[self.at - 2 : self.at], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c}")
        return ord(c)

    def _atom(self, fold: bool):
        if self.p[self.at] == "(":
            self.at += 1
            if self.p.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self.p.startswith("?:", self.at):
                self.at += 2
            ends = self._either(fold)
            self.at += 1
            return ends
        if self.p[self.at] == "[":
            self.at, chars = self.at + 1, set()
            while self.p[self.at] != "]":
                low = high = self._one()
                if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                    self.at += 1
                    high = self._one()
                chars.update(range(low, high + 1))
            self.at += 1
        elif self.p[self.at] in ".^$*+?{":
            raise ValueError(f"{self.p[self.at]} in {self.p}")
        else:
            chars = {self._one()}
        if fold:
            chars |= {ord(f(chr(c))) for c in chars for f in (str.lower, str.upper)}
        a, b = self._state(), self._state()
        self.edges[a].append((frozenset(chars), b))
        return a, b

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def move(self, states, byte: int) -> frozenset:
        return self.closed({t for s in states for chars, t in self.edges[s] if byte in chars})

    def reversed(self) -> _Nfa:
        out = object.__new__(_Nfa)
        out.edges, out.free = [[] for _ in self.edges], [[] for _ in self.free]
        for s, row in enumerate(self.edges):
            for chars, t in row:
                out.edges[t].append((chars, s))
        for s, row in enumerate(self.free):
            for t in row:
                out.free[t].append(s)
        out.start, out.accept = self.accept, self.start
        return out


def _tables(start, step, bytes_of: int = 256):
    """Subset construction: the transition table and the states, in order of discovery."""
    number, states, table, k = {start: 0}, [start], [], 0
    while k < len(states):
        row = []
        for b in range(bytes_of):
            new = step(states[k], b)
            if new not in number:
                number[new] = len(states)
                states.append(new)
            row.append(number[new])
        table.append(row)
        k += 1
    return np.array(table, np.int32), states


def _stream(nfa: _Nfa):
    """A table that finds the leftmost longest matches one after the other, and for each state whether one has just ended.

    A state has the threads of matches begun and not dead, the leftmost first,
    and whether its only thread has matched; no later match begins then.
    """
    begin = nfa.closed({nfa.start})

    def step(state, byte):
        threads, matched, _ = state
        new, seen = [], set()
        for thread in threads if matched else (*threads, begin):
            after = nfa.move(thread, byte) - seen
            if after:
                new.append(frozenset(after))
                seen |= after
        ends = [nfa.accept in t for t in new]
        if matched and not new:
            return (*step(((), False, False), byte)[:2], True)
        if matched and not ends[0] or not matched and any(ends) and not ends[0]:
            raise ValueError("a match has to last until its pattern fails")
        return ((new[0],), True, False) if any(ends) else (tuple(new), False, False)

    table, states = _tables(((), False, False), step)
    return table, np.array([s[2] for s in states], np.int64)


def _backward(nfa: _Nfa):
    """A table over reversed bytes and which states accept; state 0 is dead."""
    back = nfa.reversed()
    table, states = _tables(back.closed({back.start}), lambda s, b: back.move(s, b))
    dead = states.index(frozenset()) if frozenset() in states else -1
    return table.tolist(), [back.accept in s for s in states], dead


@dataclass
class Automaton:
    """All rules as one minimal Moore machine: next state by state and byte class; the rules (as bits) whose match has just ended."""

    classes: np.ndarray
    table: np.ndarray
    ended: np.ndarray
    backward: list


def _scanned_pattern(rule: Rule) -> str:
    """The rule's pattern; a run of one class with its least length spelt out, so that shorter runs end no match."""
    run = re.fullmatch(r"(\[[^]]+\])\+", rule.pattern)
    return run[1] * rule.least + run[1] + "*" if run and not rule.group else rule.pattern


def compile_rules(rules=RULES) -> Automaton:
    streams, backward = [], []
    for rule in rules:
        nfa = _Nfa(_scanned_pattern(rule))
        streams.append(_stream(nfa))
        backward.append(_backward(nfa))
    columns = np.concatenate([t for t, _ in streams])
    _, first, classes = np.unique(columns, axis=1, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)
    narrow = [t[:, first].tolist() for t, _ in streams]
    table, states = _tables((0,) * len(rules), lambda s, c: tuple(n[x][c] for n, x in zip(narrow, s)), len(first))
    ended = np.array([sum(int(e[x]) << k for k, ((_, e), x) in enumerate(zip(streams, s))) for s in states], np.int64)
    block = np.unique(ended, return_inverse=True)[1].reshape(-1)
    while True:  # states of a block that some class takes to different blocks part
        _, at, finer = np.unique(np.column_stack((block, block[table])), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # The block of the start state comes first.
    order = np.argsort(np.arange(len(at)) != finer[0], kind="stable")
    new = np.empty(len(at), np.int64)
    new[order] = np.arange(len(at))
    return Automaton(classes, new[finer][table[at[order]]].astype(np.int32), ended[at[order]], backward)


class Scanner:
    """The automaton as rows that hold the rows they lead to; a row's last item says which rules have ended (0: none)."""

    def __init__(self, machine: Automaton, rules=RULES):
        self.rules, self.backward = rules, machine.backward
        kinds = np.unique(np.append(machine.ended, 0))
        self.masks = kinds.tolist()
        if len(self.masks) > 256:
            raise ValueError("too many sets of rules end together")
        rows = [[] for _ in machine.table]
        for row, after, mask in zip(rows, machine.table[:, machine.classes].tolist(), np.searchsorted(kinds, machine.ended).tolist()):
            row.extend([rows[t] for t in after])
            row.append(mask)
        self.first, self.checks = rows[0], [re.compile(r.pattern) for r in rules]

    def start(self, rule: int, data: bytes, least: int, end: int) -> int:
        """Where the leftmost match that ends at end starts, not before least."""
        table, accepts, dead = self.backward[rule]
        state, found, at = 0, -1, end
        while at > least and state != dead:
            at -= 1
            state = table[state][data[at]]
            if accepts[state]:
                found = at
        return found

    def scan(self, data: bytes, ends: list) -> list:
        """(text, rule, start, end) in bytes of the texts in data, each of which is followed by END; ends are the places after it."""
        marks = bytes(map(operator.itemgetter(256), itertools.accumulate(data, operator.getitem, initial=self.first)))
        out, last, text, base = [], [0] * len(self.rules), 0, 0
        for place in np.flatnonzero(np.frombuffer(marks, np.uint8)).tolist():
            end = place - 1
            while end >= ends[text]:
                base, text = ends[text], text + 1
            mask = self.masks[marks[place]]
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    begin = self.start(k, data, max(base, last[k]), end)
                    last[k] = end
                    own = data[begin:end].decode()
                    if len(own if not rule.group else self.checks[k].fullmatch(own)[rule.group]) >= rule.least:
                        out.append((text, k, begin - base, end - base))
        return out


def scanned(texts: list, scanner: Scanner) -> list:
    """[(rule, start, end)] in code points for each text."""
    out, row = [[] for _ in texts], 0
    while row < len(texts):
        parts, size, ends = [], 0, []
        while row + len(parts) < len(texts) and (not parts or size < CHUNK):
            parts.append((texts[row + len(parts)] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            ends.append(size)
        for text, k, start, end in scanner.scan(b"\xff".join(parts) + b"\xff", ends):
            out[row + text].append((k, start, end))
        for n, own in enumerate(parts):
            if out[row + n] and not own.isascii():
                points = np.concatenate(([0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)))
                out[row + n] = [(k, int(points[a]), int(points[b])) for k, a, b in out[row + n]]
        row += len(parts)
    return out


def _finder(machine: Automaton, rules):
    def find(batches):
        scanners = kept("scanners")
        if (key := repr(rules)) not in scanners:
            scanners[key] = Scanner(machine, rules)
        scanner = scanners[key]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        out = pa.schema([("doc_id", pa.int64()), ("spans", kind)])
        for batch in batches:
            found = scanned(batch.column(1).to_pylist(), scanner)
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted((a, k, b) for k, a, b in own)] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], schema=out)

    return find


def find(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row of docs(doc_id, text).

    Spans are leftmost, longest and of one kind apart, in code points, the end
    exclusive; ordered by start, then by the rules' order. Null and empty texts
    have none. Repeated rows are scanned one by one; other columns aren't read.
    A text is scanned whole, however long, in one pass; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(docs, _finder(compile_rules(rules), rules), "doc_id long, spans array<struct<kind string, start long, end long>>")
