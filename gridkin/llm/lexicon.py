"""A minimal acyclic transducer over byte strings, kept in one memory-mapped file.

Words are added in sorted order; states with equal outgoing edges are merged, so common endings are shared.
Every edge carries a number, and the sum along a word's path is the word's position in sorted order.  That
position finds the word's output ids.  Look-ups walk many words at once, one byte column after the other.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

import numpy as np

from gridkin.llm.common import ragged_gather

_PARTS = ("keys", "target", "number", "final", "starts", "ids")


def _minimal_edges(words: Sequence[bytes]) -> list[tuple[tuple[tuple[int, int], ...], bool]]:
    """States as (edges, final); the last one is the start.  ``words`` are sorted and distinct."""
    states: list[tuple[tuple[tuple[int, int], ...], bool]] = []
    known: dict[tuple[tuple[tuple[int, int], ...], bool], int] = {}
    # The path of the last word: edges so far, and whether a word ends there.
    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]

    def close(depth: int, last: bytes) -> None:
        while len(path) - 1 > depth:
            edges, final = path.pop()
            shape = (tuple(edges), final)
            state = known.get(shape)
            if state is None:
                state = known[shape] = len(states)
                states.append(shape)
            path[-1][0].append((last[len(path) - 1], state))

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same, last)
        path.extend(([], False) for _ in word[same:])
        path[-1] = (path[-1][0], True)
        last = word
    close(0, last)
    states.append((tuple(path[0][0]), path[0][1]))
    return states


def write_lexicon(path: str | Path, entries: dict[bytes, Sequence[int]]) -> None:
    """Compile words with their output ids into one file."""
    words = sorted(entries)
    states = _minimal_edges(words)
    below = [0] * len(states)
    keys, target, number = [], [], []
    for state, (edges, final) in enumerate(states):  # targets come before their sources
        seen = int(final)
        for byte, to in edges:
            keys.append(state << 8 | byte)
            target.append(to)
            number.append(seen)
            seen += below[to]
        below[state] = seen
    lengths = [len(entries[w]) for w in words]
    parts = {
        "keys": np.array(keys, np.int64),
        "target": np.array(target, np.int32),
        "number": np.array(number, np.int32),
        "final": np.array([f for _, f in states], np.uint8),
        "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for w in words for i in entries[w]], np.int32),
    }
    head, at = {}, 0
    for name in _PARTS:
        head[name] = (parts[name].dtype.str, len(parts[name]), at)
        at += -(-parts[name].nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    with open(path, "wb") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for name in _PARTS:
            raw = parts[name].tobytes()
            out.write(raw + bytes(-len(raw) % 8))


class Lexicon:
    """The file, mapped into memory: all workers of a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        data = np.memmap(path, np.uint8, "r")
        for name, (kind, n, at) in head.items():
            start = 8 + size + at
            part = data[start : start + n * np.dtype(kind).itemsize].view(kind)
            setattr(self, f"_{name}", part)
        self._start = len(self._final) - 1

    def positions(self, words: Sequence[bytes]) -> np.ndarray:
        """Position of each word in sorted order, -1 where it is unknown."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(n, self._start, np.int64)
        total = np.zeros(n, np.int64)
        alive = np.arange(n)
        step = 0
        while len(self._keys) and len(alive := alive[lengths[alive] > step]):
            key = state[alive] << 8 | flat[starts[alive] + step]
            edge = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[edge] == key
            state[alive[~hit]] = -1
            alive, edge = alive[hit], edge[hit]
            state[alive] = self._target[edge]
            total[alive] += self._number[edge]
            step += 1
        known = (state >= 0) & (self._final[np.maximum(state, 0)] == 1)
        if not len(self._keys):
            known &= lengths == 0
        return np.where(known, total, -1)

    def outputs(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words in a row, and how many each word has."""
        starts = self._starts[positions]
        lengths = self._starts[positions + 1] - starts
        return ragged_gather(self._ids, starts, lengths)[0], lengths
