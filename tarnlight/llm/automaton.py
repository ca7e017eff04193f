"""Regular expressions over bytes, compiled to one minimal deterministic automaton.

Syntax: literals, \\xHH and other escapes, classes [..] and [^..], groups (..), (?i:..), alternation, ? * + {n} {n,}
{n,m}. Subset construction runs on byte classes; Moore's partition refinement minimises; the result is a flat
transition array. Several rules can share one automaton: a state knows which rules end there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

ALL = (1 << 256) - 1


def _bits(chars) -> int:
    out = 0
    for c in chars:
        out |= 1 << c
    return out


class _Parser:
    """Pattern -> tree of ("set", bits) ("cat", a, b) ("alt", a, b) ("rep", a, least, most) ("empty",)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        tree = self.alt()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} in {self.p!r}")
        return tree

    def alt(self):
        tree = self.cat()
        while self.peek() == "|":
            self.take()
            tree = ("alt", tree, self.cat())
        return tree

    def cat(self):
        tree = ("empty",)
        while self.peek() and self.peek() not in "|)":
            part = self.repeat()
            tree = part if tree == ("empty",) else ("cat", tree, part)
        return tree

    def repeat(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                most = int(low) if "," not in self.p[self.i : end] else int(high) if high else None
                self.i = end + 1
                tree = ("rep", tree, int(low), most)
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        if c.isalnum():
            return {"n": 10, "t": 9, "r": 13}[c]
        return ord(c)

    def folded(self, bits: int) -> int:
        if self.fold:
            for c in range(26):
                pair = 1 << 65 + c | 1 << 97 + c
                if bits & pair:
                    bits |= pair
        return bits

    def atom(self):
        c = self.take()
        if c == "(":
            fold, before = self.p.startswith("?i:", self.i), self.fold
            if fold:
                self.i += 3
                self.fold = True
            tree = self.alt()
            if self.take() != ")":
                raise ValueError("missing )")
            self.fold = before
            return tree
        if c == "[":
            return ("set", self.folded(self.klass()))
        return ("set", self.folded(1 << (self.escape() if c == "\\" else ord(c))))

    def klass(self) -> int:
        negate = self.peek() == "^"
        if negate:
            self.take()
        bits = 0
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                d = self.take()
                bits |= _bits(range(low, (self.escape() if d == "\\" else ord(d)) + 1))
            else:
                bits |= 1 << low
        return ALL ^ bits if negate else bits


def reverse(tree):
    kind, *rest = tree
    if kind == "cat":
        return ("cat", reverse(rest[1]), reverse(rest[0]))
    if kind == "alt":
        return ("alt", reverse(rest[0]), reverse(rest[1]))
    return ("rep", reverse(rest[0]), *rest[1:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.moves: list[tuple[int, int] | None] = []  # (bits, target)
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def build(self, tree, end: int) -> int:
        """The state from which `tree` leads to `end`."""
        kind, *rest = tree
        if kind == "empty":
            return end
        if kind == "set":
            s = self.state()
            self.moves[s] = (rest[0], end)
            return s
        if kind == "cat":
            return self.build(rest[0], self.build(rest[1], end))
        if kind == "alt":
            s = self.state()
            self.free[s] = [self.build(rest[0], end), self.build(rest[1], end)]
            return s
        inner, least, most = rest
        if most is None:
            loop = self.state()
            self.free[loop] = [self.build(inner, loop), end]
            at = loop
        else:
            at = end
            for _ in range(most - least):
                s = self.state()
                self.free[s] = [self.build(inner, at), end]
                at = s
        for _ in range(least):
            at = self.build(inner, at)
        return at


class Automaton:
    """next[state * n_classes + class of byte] is the next state times n_classes; state 0 is the start."""

    def __init__(self, trees: Sequence, search: bool):
        nfa = _Nfa()
        ends = [nfa.state() for _ in trees]
        starts = [nfa.build(t, e) for t, e in zip(trees, ends)]
        rule_of = {e: 1 << k for k, e in enumerate(ends)}
        self.classes, reps = self._classes({m[0] for m in nfa.moves if m})
        n = self.n_classes = len(reps)
        hits = [[k for k in range(n) if m and m[0] >> reps[k] & 1] for m in nfa.moves]

        def closure(states) -> frozenset[int]:
            seen, todo = set(), list(states)
            while todo:
                if (s := todo.pop()) not in seen:
                    seen.add(s)
                    todo += nfa.free[s]
            return frozenset(s for s in seen if nfa.moves[s] or s in rule_of)

        begin = closure(starts)
        number, todo, table, accept = {begin: 0}, [begin], [], []
        for now in todo:
            to: list[set[int]] = [set() for _ in range(n)]
            for s in now:
                for k in hits[s]:
                    to[k].add(nfa.moves[s][1])
            row = []
            for targets in to:
                target = closure(targets)
                if search:
                    target |= begin
                if target not in number:
                    number[target] = len(todo)
                    todo.append(target)
                row.append(number[target])
            table.append(row)
            accept.append(sum(rule_of.get(s, 0) for s in now))
        self._minimise(np.array(table), np.array(accept, np.int64))

    @staticmethod
    def _classes(sets: set[int]) -> tuple[np.ndarray, list[int]]:
        seen: dict[tuple, int] = {}
        ordered, reps, out = sorted(sets), [], np.zeros(256, np.int32)
        for b in range(256):
            sig = tuple(s >> b & 1 for s in ordered)
            if sig not in seen:
                seen[sig] = len(reps)
                reps.append(b)
            out[b] = seen[sig]
        return out, reps

    def _minimise(self, table: np.ndarray, accept: np.ndarray) -> None:
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        # the start first, then by what they accept, states that accept last
        _, some = np.unique(block, return_index=True)
        order = sorted(range(len(some)), key=lambda b: (b != block[0], accept[some[b]] > 0 and 1))
        rank = np.empty(len(some), np.int64)
        rank[order] = np.arange(len(some))
        pick = some[order]
        self.table = rank[block[table[pick]]].astype(np.int32)
        self.accept = accept[pick]
        self.next = (self.table * self.n_classes).astype(np.int32).ravel()
        self.n_states = len(pick)
        ends = np.flatnonzero(self.accept[1:]) + 1
        self.first_accept = int(ends[0]) if len(ends) else self.n_states
        if self.accept[0]:
            raise ValueError("a rule matches the empty text")
        #: bytes after which the automaton is in its start state, whatever came before
        self.resets = (self.table == 0).all(axis=0)[self.classes]
        self.dead = next((s for s in range(self.n_states) if not self.accept[s] and (self.table[s] == s).all()), -1)

    def longest(self, data: bytes, at: int, to: int, step: int = 1) -> int:
        """The furthest position of an anchored match from `at` towards `to`, or -1."""
        s, best = 0, -1
        rows, classes, accept = self.table, self.classes, self.accept
        while at != to:
            s = rows[s, classes[data[at if step > 0 else at - 1]]]
            at += step
            if accept[s]:
                best = at
            elif s == self.dead:
                break
        return best

    def ends(self, data: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(positions after each byte at which some rule ends, the rules' bits there), in one pass over the bytes.

        The pass runs over many lanes side by side, which begin after reset bytes; a stretch without such bytes
        is scanned byte by byte.
        """
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cls = self.classes[data]
        safe = np.flatnonzero(self.resets[data]) + 1
        want = np.searchsorted(safe, np.arange(lane, n, lane))
        starts = np.unique(np.concatenate([[0], safe[want[want < len(safe)]]]))
        starts = starts[starts < n]
        sizes = np.diff(starts, append=n)
        out_at, out_state = [], []
        long = sizes > 8 * lane
        for a, size in zip(starts[long].tolist(), sizes[long].tolist()):
            s, table = 0, self.next.tolist()
            edge = self.first_accept * self.n_classes
            for k, c in enumerate(cls[a : a + size].tolist()):
                s = table[s + c]
                if s >= edge:
                    out_at.append(np.array([a + k + 1]))
                    out_state.append(np.array([s]))
        starts, sizes = starts[~long], sizes[~long]
        if len(starts):
            order = np.argsort(-sizes, kind="stable")
            starts, sizes = starts[order], sizes[order]
            active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # lanes longer than each step
            state = np.zeros(len(starts), np.int32)
            edge = self.first_accept * self.n_classes
            for t, m in enumerate(active.tolist()):
                now = np.take(self.next, state[:m] + cls[starts[:m] + t])
                state[:m] = now
                hit = now >= edge
                if hit.any():
                    w = np.flatnonzero(hit)
                    out_at.append(starts[w] + t + 1)
                    out_state.append(now[w])
        if not out_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, state = np.concatenate(out_at), np.concatenate(out_state)
        order = np.argsort(at, kind="stable")
        return at[order], self.accept[state[order] // self.n_classes]


def parse(pattern: str):
    return _Parser(pattern).parse()
