"""Words of many texts at once as 64-bit hashes, with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of text that are hashed at a time; longer texts are cut between words.
PORTION_BYTES = 2_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _WORD[_low : _high + 1] = True


@dataclass
class Words:
    """Hashes of words in order, and the places of the words in the bytes."""

    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


class WordHasher:
    """A word is a run of letters, digits and characters beyond ASCII; its hash depends on its bytes alone."""

    def __init__(self):
        self.powers = np.ones(0, np.uint64)
        self.inverse = self.powers

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            steps = np.full(size, _MULTIPLIER, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = pow(_MULTIPLIER, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)

    def words(self, text: bytes) -> Words:
        parts, at = [], 0
        while at < len(text):
            stop = min(len(text), at + PORTION_BYTES)
            if stop < len(text):
                gaps = np.flatnonzero(~_WORD[np.frombuffer(text, np.uint8, stop - at, at)])
                stop = at + int(gaps[-1]) + 1 if len(gaps) else len(text)
            parts.append(self._part(np.frombuffer(text, np.uint8, stop - at, at), at))
            at = stop
        if not parts:
            return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(parts) == 1:
            return parts[0]
        return Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("hashes", "starts", "sizes")))

    def _part(self, data: np.ndarray, shift: int) -> Words:
        self._grow(len(data))
        inside = _WORD[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return Words(np.zeros(0, np.uint64), starts, starts)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)]
        terms[~inside] = 0
        mixed = np.add.reduceat(terms, starts) * self.inverse[starts]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return Words(mixed, starts + shift, stops - starts)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + size]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


class Lookup:
    """Places of hashes in a sorted table; most strangers are turned away by a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are in the table, and their places there."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        held = self.keys[place] == hashes[at]
        return at[held], place[held]
