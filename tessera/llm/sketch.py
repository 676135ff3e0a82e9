"""Words, shingle hashes and min-hash sketches of batches of texts, in numpy; shared by the near-duplicate operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tessera.llm.confusables import ordinary

_WORD = re.compile(r"[^\W_]+")
_DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹", "0123456789")
MEMO = 300_000
_memo: dict[str, int] = {}


def raw_words(text: str) -> list[str]:
    """Runs of letters or digits of the ordinary form, as they stand."""
    return _WORD.findall(ordinary(text))


def split_ordinary(text: str) -> list[str]:
    """Runs of letters or digits of a text in ordinary form."""
    return _WORD.findall(text)


def normal(word: str) -> str:
    """A word in lower case with ASCII digits."""
    return word.lower().translate(_DIGITS)


def words(text: str) -> list[str]:
    """Lower-case runs of letters or digits of the ordinary form, digits in ASCII."""
    return [normal(w) for w in raw_words(text)]


def word_hashes(listed: list[str]) -> list[int]:
    """64-bit hash of the normal form of each raw word, memoised."""
    memo = _memo
    try:
        return [memo[w] for w in listed]
    except KeyError:
        if len(memo) > MEMO:
            memo.clear()
        for w in listed:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(normal(w))
        return [memo[w] for w in listed]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts one after another, offsets); a text of fewer than ``width`` words has none."""
    counts = np.maximum(sizes - width + 1, 0)
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(3) + hashes[at + k])
    return out, offsets


def minima(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Min-hash of each text (rows) under each seed (columns); texts without shingles get the largest number."""
    n = len(offsets) - 1
    out = np.full((n, len(seeds)), np.iinfo(np.uint64).max, dtype=np.uint64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        at = offsets[:-1][filled]
        for j, seed in enumerate(seeds):
            out[filled, j] = np.minimum.reduceat(ordered(values, seed), at)
    return out


def ordered(values: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Places of hashes in the pseudo-random order of a seed: a xor, an odd multiplier and a shift."""
    h = (values ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= seed | np.uint64(1)
    return h


def seeds(count: int, salt: int) -> np.ndarray:
    """Fixed pseudo-random seeds."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def combine(columns: list[np.ndarray], salt: int) -> np.ndarray:
    """One 64-bit key of several columns."""
    out = np.full(len(columns[0]), salt, dtype=np.uint64)
    for c in columns:
        out = mix(out * np.uint64(3) + c)
    return out


class Batch:
    """Words of a list of texts with their hashes laid out one after another."""

    def __init__(self, listed: list[list[str]]):
        self.sizes = np.array([len(x) for x in listed], dtype=np.int64)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.hashes = np.array([h for x in listed for h in word_hashes(x)], dtype=np.uint64)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return shingles(self.hashes, self.starts, self.sizes, width)
