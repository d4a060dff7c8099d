"""Regular expressions over bytes as one minimal automaton, and its scan over long byte arrays.

Rules are parsed by Python's own expression parser; groups, alternatives, classes, ``? * + {m,n}``
and the case flag are supported. All rules become one nondeterministic automaton, which subset
construction and partition refinement turn into a transition array over byte classes.

The scan cuts the bytes into blocks of equal length and moves all blocks forward together,
one byte a step. The entry state of a block is first guessed (the start state) and blocks
whose guess proves wrong are run again, until every block starts where the one before it
ended; automata of search rules forget their past after a few bytes, so this takes two or
three rounds.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, items, start: int, fold: bool, backwards: bool) -> int:
        """Add a sequence after ``start``; returns its last state."""
        for code, arg in reversed(list(items)) if backwards else items:
            start = self._one(code, arg, start, fold, backwards)
        return start

    def _one(self, code, arg, start: int, fold: bool, backwards: bool) -> int:
        if code in (op.LITERAL, op.IN):
            end = self.state()
            self.moves[start].append((_bytes(code, arg, fold), end))
            return end
        if code is op.SUBPATTERN:
            return self.build(arg[3], start, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I, backwards)
        if code is op.BRANCH:
            end = self.state()
            for choice in arg[1]:
                self.empty[self.build(choice, start, fold, backwards)].append(end)
            return end
        if code is op.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                start = self.build(body, start, fold, backwards)
            if high is op.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.build(body, loop, fold, backwards)].append(loop)
                return loop
            end = self.state()
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.build(body, start, fold, backwards)
                self.empty[start].append(end)
            return end
        raise ValueError(f"not supported in a rule: {code}")

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _bytes(code, arg, fold: bool) -> frozenset[int]:
    if code is op.LITERAL:
        found = {arg}
    else:
        found, negate = set(), False
        for kind, value in arg:
            if kind is op.NEGATE:
                negate = True
            elif kind is op.LITERAL:
                found.add(value)
            elif kind is op.RANGE:
                found.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {kind}")
        if negate:
            found = set(range(256)) - found
    if fold:
        found |= {b ^ 0x20 for b in found if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(found)


class Automaton:
    """``table[state * n_classes + class]`` is the next state times ``n_classes``; ``accepts`` has a bit per rule."""

    def __init__(self, rules: list[bytes], anchored: bool = False, backwards: bool = False) -> None:
        nfa = _Nfa()
        first = nfa.state()
        final: dict[int, int] = {}
        for bit, rule in enumerate(rules):
            tree = parser.parse(rule)
            start = nfa.state()
            nfa.empty[first].append(start)
            end = nfa.build(tree, start, bool(tree.state.flags & re.I), backwards)
            final[end] = 1 << bit
        self.classes, members = _byte_classes(nfa)
        table, masks = _subsets(nfa, first, final, members, anchored)
        table, masks = _minimal(table, masks)
        self.n_classes = len(members)
        self.table = (table * self.n_classes).astype(np.int32).ravel()
        self.accepts = np.repeat(masks, self.n_classes).astype(np.uint8)
        self.start = 0

    def resets(self, byte: int) -> bool:
        """Whether this byte leads from every state to the start."""
        return bool((self.table[int(self.classes[byte]) :: self.n_classes] == self.start).all())

    def accepted(self, data: np.ndarray, block: int = 256) -> np.ndarray:
        """For every byte, the rules that a match ends with it, as bits."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint8)
        rows = -(-n // block)
        codes = np.zeros(rows * block, np.uint8)
        codes[:n] = self.classes[data]
        codes = np.ascontiguousarray(codes.reshape(rows, block).T)
        out = np.empty((block, rows), np.uint8)
        entry = np.full(rows, self.start, np.int32)
        leave = np.empty(rows, np.int32)
        todo = np.arange(rows)
        while len(todo):
            state = entry[todo]
            part = codes if len(todo) == rows else codes[:, todo]
            for i in range(block):
                state = self.table[state + part[i]]
                out[i, todo] = self.accepts[state]
            leave[todo] = state
            due = np.concatenate([entry[:1], leave[:-1]])
            todo = np.flatnonzero(due != entry)
            entry = due
        return out.T.ravel()[:n]

    def longest(self, data: bytes) -> int:
        """Length of the longest accepted prefix of ``data``, 0 if there is none (for anchored automata)."""
        state, best, dead = self.start, 0, -1
        for i, byte in enumerate(data):
            nxt = int(self.table[state + int(self.classes[byte])])
            if nxt == state == dead:
                break
            if not self.accepts[nxt] and (self.table[nxt : nxt + self.n_classes] == nxt).all():
                dead = nxt
            state = nxt
            if self.accepts[state]:
                best = i + 1
        return best


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that no rule tells apart share a class; also one member of each class."""
    sets = sorted({m for moves in nfa.moves for m, _ in moves}, key=sorted)
    keys: dict[tuple, int] = {}
    classes, members = np.zeros(256, np.uint8), []
    for byte in range(256):
        key = tuple(byte in s for s in sets)
        if key not in keys:
            keys[key] = len(members)
            members.append(byte)
        classes[byte] = keys[key]
    return classes, members


def _subsets(nfa: _Nfa, first: int, final: dict[int, int], members: list[int], anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    begin = nfa.closure([first])
    numbers, order, table = {begin: 0}, [begin], []
    closures: dict[frozenset[int], frozenset[int]] = {}
    moves = [[(byte, to) for chars, to in m for byte in members if byte in chars] for m in nfa.moves]
    for states in order:
        row, targets = [], {byte: set() if anchored else {first} for byte in members}
        for s in states:
            for byte, to in moves[s]:
                targets[byte].add(to)
        for moved in map(frozenset, targets.values()):
            nxt = closures.get(moved)
            if nxt is None:
                nxt = closures[moved] = nfa.closure(moved)
            if nxt not in numbers:
                numbers[nxt] = len(order)
                order.append(nxt)
            row.append(numbers[nxt])
        table.append(row)
    masks = [sum(bit for s, bit in final.items() if s in states) for states in order]
    return np.array(table, np.int64), np.array(masks, np.int64)


def _minimal(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart (partition refinement); state 0 stays the start."""
    label = np.unique(masks, return_inverse=True)[1]
    while True:
        rows = np.concatenate([label[:, None], label[table]], axis=1)
        refined = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        if refined.max() == label.max():
            break
        label = refined
    _, first, label = np.unique(label, return_index=True, return_inverse=True)
    order = np.argsort(first)  # number the merged states by their first member
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[label.ravel()[table[first[order]]]], masks[first[order]]
