"""Words and word n-grams as 64-bit keys, computed with numpy over many texts at once."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, islice

import numpy as np
import xxhash

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed bijection of 64-bit keys."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordKeys:
    """Dense ids and xxh3 keys of the words met so far by one Python worker; forgets all when over limit words. What others keep by id holds for one generation."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.generation = limit, 0
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.keys = np.empty(0, U64)
        self.generation += 1

    def lookup(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self._clear()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        if new := len(self.ids) - len(self.keys):
            fresh = list(islice(reversed(self.ids), new))[::-1]
            self.keys = np.concatenate([self.keys, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), U64, new)])
        return ids


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, A-Z in lower case, and the offsets of each text's words."""
    parts = [t.lower().split() for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=at[1:])
    return list(chain.from_iterable(parts)), at


def shingles(keys: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all width-word shingles of each text in order, and their offsets. A text of fewer words, but not of none, is one shingle."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(count, out=out_at[1:])
    out = np.empty(int(out_at[-1]), U64)
    full = max(0, len(keys) - width + 1)
    rolled = np.zeros(full, U64)
    for i in range(width):
        rolled = mix(rolled + keys[i : i + full] + U64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(n >= width)
    take = np.repeat(at[long] - out_at[long], count[long])
    where = _ranges(out_at[long], count[long])
    out[where] = rolled[take + where]
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = np.array([n[i]], U64)
        for k in keys[at[i] : at[i + 1]]:
            h = mix(h * U64(0xD6E8FEB86659FD93) + k)
        out[out_at[i]] = h[0]
    return out, out_at


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] values each."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.repeat(start - first, count) + np.arange(total)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return _ranges(np.asarray(start, np.int64), np.asarray(count, np.int64))
