"""Words, word hashes and shingles shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Cached word hashes; emptied when it reaches the bound, so a worker's memory doesn't follow the vocabulary.
CACHE_BOUND = 400_000
_cache: dict[str, int] = {}


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_BOUND:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


_find = re.compile(r"[^\W_]+").findall


def split_words(text: str | None) -> list[str]:
    """The maximal runs of letters or digits of the lower-cased text; none for null."""
    return _find(text.lower()) if text else []


def hash_words(split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the offsets of the texts in it (one more than texts)."""
    offsets = np.zeros(len(split) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in split], out=offsets[1:])
    look = _hashes.__getitem__
    flat = np.fromiter((look(w) for s in split for w in s), dtype=np.uint64, count=int(offsets[-1]))
    return flat, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: the bits of the result depend on all bits of `x`."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words inside a text: (hash, text number, word position in the text).

    A text with fewer words has none, or one made of all its words if `whole_if_short`.
    """
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - n + 1, 0))
    first = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(lengths - n + 1, 0)) - np.maximum(lengths - n + 1, 0), np.maximum(lengths - n + 1, 0))
    at = offsets[owner] + first
    value = np.zeros(len(at), dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(n):
        value = value * base + flat[at + j]
    value = mix(value)
    if whole_if_short:
        short = np.flatnonzero((lengths < n) & (lengths > 0))
        extra = np.array([int(np.bitwise_xor.reduce(mix(flat[offsets[i] : offsets[i + 1]] * base + np.arange(lengths[i], dtype=np.uint64)))) for i in short], dtype=np.uint64)
        value, owner, first = np.concatenate([value, extra]), np.concatenate([owner, short]), np.concatenate([first, np.zeros(len(short), dtype=np.int64)])
    return value, owner, first
