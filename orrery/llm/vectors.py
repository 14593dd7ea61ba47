"""Word hashes of whole texts and look-up of 64-bit keys, without a Python loop over either."""

from __future__ import annotations

import numpy as np

from .text import mixed

_RNG = np.random.default_rng(11)
_OF_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at once; a piece ends with a word.
PIECE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def _hashed(piece: np.ndarray) -> np.ndarray:
    space = _SPACE[piece]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(piece) + 1)
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_OF_BYTE[_LOWER[piece]] * up[: len(piece)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the whole text in order, A-Z taken as a-z."""
    if not text:
        return np.zeros(0, np.uint64)
    whole, found, at = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), [], 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        while end < len(whole):  # up to the next white space
            gap = np.flatnonzero(_SPACE[whole[end : end + 4096]])
            end = min(len(whole), end + (int(gap[0]) if len(gap) else 4096))
            if len(gap):
                break
        found.append(_hashed(whole[at:end]))
        at = end
    return found[0] if len(found) == 1 else np.concatenate(found)


class Table:
    """Open addressing from 64-bit keys to values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys, self.values = np.ascontiguousarray(keys, np.uint64), values
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = self.slots[slot]
            hit = (at >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = at[hit]
            go = (at >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out
