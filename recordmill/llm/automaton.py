"""Byte automata: rule patterns to one deterministic, minimal transition table.

A pattern may hold literals, ``[...]`` classes, ``(...)`` groups, ``|``, and the repeats ``? * + {m} {m,} {m,n}``; it works on
bytes. Patterns are compiled together by subset construction and then minimised, each state knowing which rules end in it.
"""

from __future__ import annotations

import re

import numpy as np

_TOKEN = re.compile(r"\\x[0-9a-fA-F]{2}|\\.|\[\^?\]?(?:\\.|[^\]])*\]|\{\d+(?:,\d*)?\}|.", re.S)


def _members(token: str) -> frozenset[int]:
    """Bytes that a literal, an escape or a class stands for."""
    if token[0] != "[":
        return frozenset([int(token[2:], 16) if token.startswith("\\x") else ord(token[-1])])
    body = [min(_members(t)) if t[0] == "\\" else t if t == "-" else ord(t) for t in _TOKEN.findall(token[1 + (token[1] == "^") : -1])]
    out: set[int] = set()
    i = 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-" and body[i + 2] != "-":
            out.update(range(body[i], body[i + 2] + 1))
            i += 3
        else:
            out.add(ord("-") if body[i] == "-" else body[i])
            i += 1
    return frozenset(range(256)) - out if token[1] == "^" else frozenset(out)


class _Moves:
    """A nondeterministic automaton under construction: empty moves and byte moves of numbered states."""

    def __init__(self, fold: bool) -> None:
        self.empty: list[list[int]] = []
        self.by_byte: list[tuple[frozenset[int], int] | None] = []
        self.fold = fold

    def state(self) -> int:
        self.empty.append([])
        self.by_byte.append(None)
        return len(self.empty) - 1

    def choice(self, tokens: list[str]) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence(tokens)
            self.empty[start].append(a)
            self.empty[b].append(end)
            if not tokens or tokens[0] != "|":
                return start, end
            tokens.pop(0)

    def sequence(self, tokens: list[str]) -> tuple[int, int]:
        start = at = self.state()
        while tokens and tokens[0] not in "|)":
            before = list(tokens)
            self.skip_atom(tokens)
            atom = before[: len(before) - len(tokens)]
            least, most = self.repeat(tokens)
            for i in range(least if most is None else most):
                a, b = self.atom(list(atom))
                self.empty[at].append(a)
                if i >= least:
                    self.empty[at].append(b)
                at = b
            if most is None:
                a, b = self.atom(list(atom))
                after = self.state()
                self.empty[at] += [a, after]
                self.empty[b] += [a, after]
                at = after
        return start, at

    def skip_atom(self, tokens: list[str]) -> None:
        depth = 0
        while True:
            token = tokens.pop(0)
            depth += (token == "(") - (token == ")")
            if not depth:
                return

    def repeat(self, tokens: list[str]) -> tuple[int, int | None]:
        if tokens and (tokens[0] in "?*+" or len(tokens[0]) > 2 and tokens[0][0] == "{"):
            token = tokens.pop(0)
            if token in "?*+":
                return {"?": (0, 1), "*": (0, None), "+": (1, None)}[token]
            low, comma, high = token[1:-1].partition(",")
            return int(low), int(high) if high else None if comma else int(low)
        return 1, 1

    def atom(self, tokens: list[str]) -> tuple[int, int]:
        token = tokens.pop(0)
        if token == "(":
            return self.choice(tokens)
        members = _members(token)
        if self.fold:
            members = members | {m ^ 32 for m in members if chr(m).isascii() and chr(m).isalpha()}
        a, b = self.state(), self.state()
        self.by_byte[a] = (members, b)
        return a, b


def _subsets(moves: _Moves, starts: list[int], restart: bool) -> tuple[np.ndarray, list[frozenset[int]]]:
    """Subset construction; ``restart``: a match may begin at every byte."""
    classes, inverse = np.unique(
        np.array([[b in m[0] for b in range(256)] for m in moves.by_byte if m]).astype(np.uint8), axis=1, return_inverse=True)
    inverse = inverse.ravel()
    sample = [int(np.flatnonzero(inverse == c)[0]) for c in range(classes.shape[1])]

    closed: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closed:
            seen, todo = {state}, [state]
            while todo:
                for nxt in moves.empty[todo.pop()]:
                    if nxt not in seen:
                        seen.add(nxt)
                        todo.append(nxt)
            closed[state] = frozenset(s for s in seen if moves.by_byte[s] or not moves.empty[s])
        return closed[state]

    begin = frozenset().union(*(closure(s) for s in starts))
    number, sets, rows = {begin: 0}, [begin], []
    for now in sets:
        row = []
        for byte in sample:
            to = set(begin) if restart else set()
            for s in now:
                if (m := moves.by_byte[s]) and byte in m[0]:
                    to |= closure(m[1])
            key = frozenset(to)
            if key not in number:
                number[key] = len(sets)
                sets.append(key)
            row.append(number[key])
        rows.append(row)
    return np.array(rows)[:, inverse], sets


def compile_rules(patterns: list[tuple[str, bool]], restart: bool) -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, bit mask of the rules that end in a state), state 0 first; at most 64 rules.

    ``patterns``: text and whether letters match in either case. With ``restart`` the table finds matches that begin
    anywhere; without, only those that begin at the first byte.
    """
    moves, starts, ends = _Moves(False), [], []
    for text, fold in patterns:
        moves.fold = fold
        tokens = _TOKEN.findall(text)
        a, b = moves.choice(tokens)
        if tokens:
            raise ValueError(f"unbalanced pattern: {text}")
        starts.append(a)
        ends.append(b)
    table, sets = _subsets(moves, starts, restart)
    mask = np.array([sum(1 << r for r, e in enumerate(ends) if e in s) for s in sets], np.uint64)
    # Minimise: refine the classes of states until no class holds two with different successors.
    _, group = np.unique(mask, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    order = np.argsort(np.where(first == first[group[0]], -1, first))  # the start state stays 0
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[group[table[first[order]]]], mask[first[order]]
