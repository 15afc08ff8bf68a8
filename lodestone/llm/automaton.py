"""Byte automata: a small regex dialect, subset construction, minimisation, and transition arrays."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

# ---------------------------------------------------------------------- patterns
# A parsed pattern is nested tuples: ("set", frozenset of bytes), ("cat", parts), ("alt", parts), ("rep", part, low, high or None).


class _Parser:
    """Literals, classes with ranges, groups, ``|``, ``? * +``, ``{m}``, ``{m,}``, ``{m,n}``, ``\\xHH`` and escaped characters."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.text, self.at, self.ignore_case = pattern, 0, ignore_case

    def parse(self) -> tuple:
        out = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return out

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", tuple(parts))

    def repeated(self) -> tuple:
        part = self.atom()
        while self.peek() in ("?", "*", "+", "{"):
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                part = ("rep", part, int(low), int(high) if high else (None if comma else int(low)))
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            out = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"a group is not closed in {self.text!r}")
            self.take()
            return out
        if c == "[":
            found: set[int] = set()
            while self.peek() != "]":
                low = self.byte(self.take())
                high = low
                if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    high = self.byte(self.take())
                found |= set(range(low, high + 1))
            self.take()
            return ("set", self.folded(found))
        return ("set", self.folded({self.byte(c)}))

    def byte(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.ignore_case:
            found = found | {b ^ 32 for b in found if chr(b).isalpha()}
        return frozenset(found)


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    return _Parser(pattern, ignore_case).parse()


@dataclass
class _Nfa:
    empty: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    moves: dict[int, list[tuple[frozenset[int], int]]] = field(default_factory=lambda: defaultdict(list))
    size: int = 0

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, tree: tuple, start: int) -> int:
        """Thompson's construction; returns the state in which ``tree``, begun at ``start``, has matched."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.empty.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + class_of[byte]]`` is the next state; state 0 is the start. ``accept`` has a bit for each pattern."""

    table: np.ndarray
    class_of: np.ndarray
    classes: int
    accept: np.ndarray
    dead: int  # a state without a way to any match, or -1

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        table, class_of, k, accept = self.table, self.class_of, self.classes, self.accept
        state, end = 0, start if accept[0] else -1
        for at in range(start, len(data)):
            state = table[state * k + class_of[data[at]]]
            if state == self.dead:
                break
            if accept[state]:
                end = at + 1
        return end


def compile_all(trees: list[tuple], anywhere: bool = False, stop_at_match: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    ``anywhere`` lets a match begin at any byte; ``stop_at_match`` makes all matching states one that is never left.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = []
    for tree in trees:
        own = nfa.state()
        nfa.empty[start].append(own)
        ends.append(nfa.add(tree, own))
    # bytes that no set tells apart are one class
    sets = sorted({s for moves in nfa.moves.values() for s, _ in moves}, key=sorted)
    signature: dict[tuple, int] = {}
    class_of = np.zeros(256, np.uint8)
    for b in range(256):
        class_of[b] = signature.setdefault(tuple(b in s for s in sets), len(signature))
    k = len(signature)
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(k)]
    def mask(states: set[int]) -> int:
        return sum(1 << t for t in nfa.closure(states))

    # sets of states are bit masks; step[c][s] is where state s goes on class c, closed
    step: list[dict[int, int]] = [{} for _ in range(k)]
    for s, moves in nfa.moves.items():
        for c in range(k):
            if to := {t for chars, t in moves if sample[c] in chars}:
                step[c][s] = mask(to)
    first, final = mask({start}), sum(1 << e for e in set(ends))
    number, rows, accept, todo, hit = {first: 0}, [], [], [first], -1
    for now in todo:  # grows while it is read
        accept.append(sum(1 << i for i, e in enumerate(ends) if now >> e & 1))
        if stop_at_match and now & final:
            rows.append([number[now]] * k)
            continue
        states = [s for s in range(nfa.size) if now >> s & 1]
        row = []
        for moves in step:
            then = first if anywhere else 0
            for s in states:
                then |= moves.get(s, 0)
            if stop_at_match and then & final and hit >= 0:
                row.append(hit)
                continue
            if then not in number:
                number[then] = len(number)
                todo.append(then)
                if stop_at_match and then & final:
                    hit = number[then]
            row.append(number[then])
        rows.append(row)
    table = np.array(rows)
    accept_of = np.array(accept, np.int64)
    # Moore's refinement: split by acceptance, then by where the classes lead, until nothing splits
    group = np.unique(accept_of, return_inverse=True)[1].ravel()
    while True:
        whole = np.ascontiguousarray(np.column_stack([group, group[table]]).astype(np.int32))
        split = np.unique(whole.view(f"V{whole.shape[1] * 4}").ravel(), return_inverse=True)[1].ravel()
        if split.max() == group.max():
            break
        group = split
    leader = np.unique(group, return_index=True)[1]
    renumber = np.full(len(leader), -1)
    order = sorted(range(len(leader)), key=lambda g: (g != group[0], leader[g]))
    renumber[order] = np.arange(len(leader))
    chosen = leader[order]
    small = renumber[group[table[chosen]]]
    accept_of = accept_of[chosen]
    loops = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (accept_of == 0))
    return Automaton(small.astype(np.int32).ravel(), class_of, k, accept_of, int(loops[0]) if len(loops) and not anywhere else -1)


def resets(automaton: Automaton) -> np.ndarray:
    """For each byte, whether it takes every state but one that is never left back to the start: texts may be cut there."""
    table = automaton.table.reshape(-1, automaton.classes)
    stay = (table == np.arange(len(table))[:, None]).all(axis=1)
    stay[0] = False
    return (table[~stay] == 0).all(axis=0)[automaton.class_of]


def scan(automaton: Automaton, data: np.ndarray, cuts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of ``data`` in which an automaton compiled with ``anywhere`` and ``stop_at_match`` matches.

    Stretches lie between reset bytes and ``cuts`` (offsets of rows). All of them advance together, one byte a step, so
    each byte is looked at once; those shorter than ``shortest`` cannot match.
    """
    reset = np.flatnonzero(resets(automaton)[data])
    edges = np.unique(np.concatenate([cuts, reset, [0, len(data)]]))
    starts, ends = edges[:-1], edges[1:]
    long_enough = ends - starts >= shortest
    starts, lengths = starts[long_enough], (ends - starts)[long_enough]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    classes = automaton.class_of[data]
    hit = np.flatnonzero(automaton.accept)[0]
    state = np.zeros(len(starts), np.int32)
    falling = -lengths
    k = np.int32(automaton.classes)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        active = np.searchsorted(falling, -t, side="left")
        state[:active] = automaton.table[state[:active] * k + classes[starts[:active] + t]]
    found = np.flatnonzero(state == hit)
    found = found[np.argsort(starts[found])]
    return starts[found], starts[found] + lengths[found]
