"""Weighted acyclic automata over word sequences of up to three words: built from sorted n-grams, united, composed.

The arc labels of a path are the words of a phrase, and the weight of a path is how often the phrase
was counted. Phrases that begin alike share their first states, and states with the same arcs
and weights are one state. Labels are numbers of a sorted word list that travels with the automaton.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Sizes that a packed array may have per number.
_KINDS = ("u1", "<u2", "<u4", "<u8")


@dataclass
class Paths:
    """Phrases with their weights: word numbers ``a``, ``b`` and ``c`` (-1 for none), sorted by them, and ``n``."""

    words: list[bytes]
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    n: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    def take(self, rows: np.ndarray) -> Paths:
        """The given rows (a mask or ascending numbers), with only the words that they use."""
        a, b, c = self.a[rows], self.b[rows], self.c[rows]
        used = np.zeros(len(self.words) + 1, bool)
        for x in (a, b, c):
            used[x] = True
        used[-1] = False
        new = np.cumsum(used) - 1
        new[-1] = -1
        return Paths([self.words[i] for i in np.flatnonzero(used)], new[a], new[b], new[c], self.n[rows])

    def phrase(self, row: int) -> bytes:
        return b" ".join(self.words[i] for i in (self.a[row], self.b[row], self.c[row]) if i >= 0)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns takes a new value."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _put(parts: Iterable[np.ndarray]) -> bytes:
    out = []
    for p in parts:
        kind = next(k for k, most in enumerate((1 << 8, 1 << 16, 1 << 32, 1 << 64)) if not len(p) or int(p.max()) < most)
        data = p.astype(_KINDS[kind]).tobytes()
        out.append(struct.pack("<BQ", kind, len(data)) + data)
    return b"".join(out)


def _got(blob: memoryview, count: int) -> tuple[list[np.ndarray], int]:
    at, out = 0, []
    for _ in range(count):
        kind, size = struct.unpack_from("<BQ", blob, at)
        at += 9
        out.append(np.frombuffer(blob[at : at + size], _KINDS[kind]).astype(np.int64))
        at += size
    return out, at


def pack(paths: Paths) -> bytes:
    """The automaton of sorted paths.

    The first words leave the start state, the second words the states behind them; both carry the weight
    of the phrase that ends there (0 for none). A state behind a second word is a list of last words
    with weights: it is looked up in the register of finished states and added only if it is new.
    """
    one = _starts(paths.a)
    weight1 = np.where(paths.b[one] < 0, paths.n[one], 0)
    longer = np.flatnonzero(paths.b >= 0)
    a, b, c, n = paths.a[longer], paths.b[longer], paths.c[longer], paths.n[longer]
    two = _starts(a, b)
    weight2 = np.where(c[two] < 0, n[two], 0)
    fan1 = np.bincount(np.searchsorted(paths.a[one], a[two]), minlength=len(one))
    arcs = np.flatnonzero(c >= 0)
    label, weight = c[arcs], n[arcs]
    fan2 = np.bincount(np.searchsorted(two, arcs, "right") - 1, minlength=len(two))
    first = np.cumsum(fan2) - fan2

    state = np.zeros(len(two), np.int64)  # state 0 has no arcs
    single = np.flatnonzero(fan2 == 1)
    order = np.lexsort((weight[first[single]], label[first[single]]))
    kept = _starts(label[first[single]][order], weight[first[single]][order])
    number = np.zeros(len(order), np.int64)
    number[kept] = 1
    state[single[order]] = np.cumsum(number)
    sources, lengths = [first[single][order][kept]], [np.ones(len(kept), np.int64)]
    register: dict[bytes, int] = {}
    met = len(kept) + 1
    both = np.stack([label, weight], 1)
    several, at = [], []
    for i in np.flatnonzero(fan2 > 1):
        key = both[first[i] : first[i] + fan2[i]].tobytes()
        found = register.get(key)
        if found is None:
            found = register[key] = met + len(register)
            several.append(fan2[i])
            at.append(first[i])
        state[i] = found
    sources.append(np.array(at, np.int64))
    lengths.append(np.array(several, np.int64))
    fan3 = np.concatenate(lengths)
    taken = _ranges(np.concatenate(sources), fan3)
    return _put([paths.a[one], weight1, fan1, b[two], weight2, state, fan3, label[taken], weight[taken]]) + b" ".join(paths.words)


def unpack(blob: bytes) -> Paths:
    """All paths of an automaton that carry a weight, in order."""
    (label1, weight1, fan1, label2, weight2, state, fan3, label3, weight3), at = _got(memoryview(blob), 9)
    words = blob[at:].split(b" ") if at < len(blob) else []
    start3 = np.concatenate([[0], np.cumsum(fan3)])
    fan3 = np.concatenate([[0], fan3])
    start3 = np.concatenate([[0], start3[:-1]])
    a2 = np.repeat(label1, fan1)
    fan2 = fan3[state]
    arcs = _ranges(start3[state], fan2)
    none = lambda k: np.full(k, -1, np.int64)
    a = np.concatenate([label1, a2, np.repeat(a2, fan2)])
    b = np.concatenate([none(len(label1)), label2, np.repeat(label2, fan2)])
    c = np.concatenate([none(len(label1) + len(label2)), label3[arcs]])
    n = np.concatenate([weight1, weight2, weight3[arcs]])
    held = np.flatnonzero(n > 0)
    order = held[np.lexsort((c[held], b[held], a[held]))]
    return Paths(words, a[order], b[order], c[order], n[order])


def _relabelled(paths: Paths, number: dict[bytes, int]) -> list[np.ndarray]:
    new = np.fromiter((number.get(w, -2) for w in paths.words), np.int64, len(paths.words))
    new = np.append(new, -1)
    return [new[x] for x in (paths.a, paths.b, paths.c)]


def united(parts: list[Paths]) -> Paths:
    """One path for each phrase of any part; weights of equal phrases are added up."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: i for i, w in enumerate(words)}
    moved = [_relabelled(p, number) for p in parts]
    a, b, c = (np.concatenate([m[i] for m in moved]) if moved else np.zeros(0, np.int64) for i in range(3))
    n = np.concatenate([p.n for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    starts = _starts(a, b, c)
    return Paths(words, a[starts], b[starts], c[starts], np.add.reduceat(n, starts) if len(n) else n)


def _step(parent: np.ndarray, label: np.ndarray, of: np.ndarray, wanted: np.ndarray, labels: int) -> np.ndarray:
    """The arc that leaves state ``of`` with label ``wanted``, or -1, where arcs are sorted by state and label."""
    key, ask = parent * (labels + 2) + label + 1, of * (labels + 2) + wanted + 1
    at = np.searchsorted(key, ask)
    at[at == len(key)] = 0
    hit = (of >= 0) & (wanted >= 0) & (key[at] == ask) if len(key) else np.zeros(len(ask), bool)
    return np.where(hit, at, -1)


def composed(counts: Paths, asked: Paths) -> np.ndarray:
    """For each path of ``asked`` its row in ``counts``, or -1: both automata are walked arc by arc.

    The states of ``asked`` are renumbered by the words of ``counts``; a walk goes on only while both have the
    arc, so a path of the composition is a phrase of both, with the weight of ``counts``.
    """
    number = {w: i for i, w in enumerate(counts.words)}
    a, b, c = _relabelled(asked, number)
    labels = len(counts.words)
    one = _starts(counts.a)
    two_rows = np.flatnonzero(counts.b >= 0)
    two = two_rows[_starts(counts.a[two_rows], counts.b[two_rows])]
    three = np.flatnonzero(counts.c >= 0)
    parent1 = np.zeros(len(one), np.int64)
    parent2 = np.searchsorted(counts.a[one], counts.a[two])
    parent3 = np.searchsorted(two, three, "right") - 1
    at1 = _step(parent1, counts.a[one], np.zeros(len(a), np.int64), a, labels)
    at2 = _step(parent2, counts.b[two], at1, b, labels)
    at3 = _step(parent3, counts.c[three], at2, c, labels)
    rows = np.full(len(a), -1, np.int64)
    for at, starts, wanted, ends in ((at1, one, (b == -1) & (c == -1), counts.b), (at2, two, (b != -1) & (c == -1), counts.c), (at3, three, c != -1, None)):
        hit = np.flatnonzero((at >= 0) & wanted)
        row = starts[at[hit]]
        rows[hit] = row if ends is None else np.where(ends[row] < 0, row, -1)
    return rows
