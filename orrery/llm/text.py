"""Words and word shingles as every operator here reads them."""

from __future__ import annotations

import numpy as np
import xxhash

#: A word: a run of anything but the ASCII white space that ``bytes.split()`` knows.
WORD = r"[^\x20\x09-\x0D]+"
#: The same for a Java regular expression inside a Spark SQL function.
WORD_JAVA = "[^\\x20\\x09-\\x0D]+"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CACHED = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z in lower case; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every space-joined shingle, repeats included; fewer words than ``size`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


class WordHashes(dict):
    """XXH64 by word; a bounded memory of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def rolling_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words from the words' hashes; fewer words are one run."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + hashes[i : i + n]
    return mixed(out)
