"""Acyclic count transducers over word sequences: a path spells a phrase, the weights along it add up to its count.

A transducer is built in one pass over sorted phrases: what the next phrase no longer shares with the last one is frozen, and
equal frozen states become one. Weights move as far to the front as they are common, so that equal ends are found more often.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

Phrase = tuple[bytes, ...]


class Builder:
    """``add`` takes phrases in rising order, each once; ``finish`` gives the transducer."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.path: list[list] = [[-1, []]]  # open states: weight of an end here (-1: none), arcs [word, weight, target]
        self.last: Phrase = ()

    def add(self, phrase: Phrase, weight: int) -> None:
        shared = 0
        for a, b in zip(phrase, self.last):
            if a != b:
                break
            shared += 1
        self.freeze(shared)
        for i in range(shared):
            arc = self.path[i][1][-1]
            common = min(arc[1], weight)
            if arc[1] != common:
                below = self.path[i + 1]
                for other in below[1]:
                    other[1] += arc[1] - common
                if below[0] >= 0:
                    below[0] += arc[1] - common
                arc[1] = common
            weight -= common
        for i in range(shared, len(phrase)):
            word = self.words.setdefault(phrase[i], len(self.words))
            self.path[i][1].append([word, weight, -1])
            self.path.append([-1, []])
            weight = 0
        self.path[len(phrase)][0] = weight
        self.last = phrase

    def freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            end, arcs = self.path.pop()
            self.path[-1][1][-1][2] = self.state(end, arcs)

    def state(self, end: int, arcs: list) -> int:
        key = (end, *[tuple(a) for a in arcs])
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.states)
            self.states.append(key)
        return found

    def finish(self) -> "Transducer":
        self.freeze(0)
        self.state(*self.path[0])
        root = self.register[(self.path[0][0], *[tuple(a) for a in self.path[0][1]])]
        return Transducer([w for w, _ in sorted(self.words.items(), key=lambda x: x[1])], self.states, root)


class Transducer:
    def __init__(self, words: list[bytes], states: list[tuple], root: int) -> None:
        self.words, self.states, self.root = words, states, root

    def dump(self) -> bytes:
        ends = np.array([s[0] for s in self.states], np.int64)
        counts = np.array([len(s) - 1 for s in self.states], np.int64)
        arcs = np.array([a for s in self.states for a in s[1:]], np.int64).reshape(-1, 3)
        words = b" ".join(self.words)
        return struct.pack("<4q", len(words), len(ends), len(arcs), self.root) + words + ends.tobytes() + counts.tobytes() + arcs.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "Transducer":
        n_words, n, n_arcs, root = struct.unpack_from("<4q", raw)
        at = 32 + n_words
        words = raw[32:at].split(b" ") if n_words else []
        ends, counts = np.frombuffer(raw, np.int64, 2 * n, at).reshape(2, n)
        arcs = list(map(tuple, np.frombuffer(raw, np.int64, 3 * n_arcs, at + 16 * n).reshape(-1, 3).tolist()))
        edges = np.concatenate(([0], np.cumsum(counts))).tolist()
        return cls(words, [(e, *arcs[a:b]) for e, a, b in zip(ends.tolist(), edges, edges[1:])], root)

    def __iter__(self) -> Iterator[tuple[Phrase, int]]:
        """All phrases in rising order with their weights."""
        words, states = self.words, self.states

        def walk(state: int, phrase: Phrase, weight: int) -> Iterator[tuple[Phrase, int]]:
            end, *arcs = states[state]
            if end >= 0:
                yield phrase, weight + end
            for word, w, target in arcs:
                yield from walk(target, (*phrase, words[word]), weight + w)

        return walk(self.root, (), 0)


def build(phrases: Iterable[tuple[Phrase, int]]) -> Transducer:
    builder = Builder()
    for phrase, weight in phrases:
        builder.add(phrase, weight)
    return builder.finish()


def compose(acceptor: Transducer, counts: Transducer) -> Iterator[tuple[Phrase, int]]:
    """The phrases of ``acceptor`` that ``counts`` spells too, with the weights of ``counts``: both are walked at once."""
    known = {w: i for i, w in enumerate(counts.words)}
    same = [known.get(w) for w in acceptor.words]
    arcs_of: dict[int, dict[int, tuple[int, int]]] = {}

    def walk(asked: int, state: int, phrase: Phrase, weight: int) -> Iterator[tuple[Phrase, int]]:
        end, *wanted = acceptor.states[asked]
        if end >= 0 and counts.states[state][0] >= 0:
            yield phrase, weight + counts.states[state][0]
        arcs = arcs_of.get(state)
        if arcs is None:
            arcs = arcs_of[state] = {w: (out, to) for w, out, to in counts.states[state][1:]}
        for word, _, target in wanted:
            met = arcs.get(same[word])
            if met:
                yield from walk(target, met[1], (*phrase, acceptor.words[word]), weight + met[0])

    return walk(acceptor.root, counts.root, (), 0)
