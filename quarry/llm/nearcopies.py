"""Shared parts of the near-copy operators: words, shingle sketches, bands, edit distance."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import regex
import xxhash

_ASCII = re.compile(r"[a-z0-9]+")
_MIXED = re.compile(r"[A-Za-z0-9]+")
_ANY = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words(text: str) -> list[str]:
    """Runs of letters, combining marks and digits, in lower case."""
    text = text.lower()
    return (_ASCII if text.isascii() else _ANY).findall(text)


def spots(text: str) -> Iterator[tuple[str, int, int]]:
    """Words as they stand, with their places."""
    return ((m.group(), m.start(), m.end()) for m in (_MIXED if text.isascii() else _ANY).finditer(text))


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = x = xxhash.xxh64_intdigest(w)
        return x


_word_hash = _Hashes().__getitem__


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX2


def hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash, ws), np.uint64, len(ws))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words in their order (of all words, if there are fewer), from the
    ``hashes`` of the words."""
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : i + len(out)])
    return out


def shingles(ws: list[str], k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words (of all words, if there are fewer) with their occurrence
    number, so that a text of repeated sentences has as many as any other."""
    h = np.sort(runs(hashes(ws), k))
    first = np.concatenate([[True], h[1:] != h[:-1]])
    number = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return np.where(first, h, _mixed(h + number.astype(np.uint64) * _MIX))


def openings_in(n: int, least: int) -> int:
    """How many openings of ``least``, ``2 * least``, ... words a text of ``n`` words has."""
    return (n // least).bit_length()


class Sketch:
    """Minwise hashes of shingle sets in bands of ``rows``."""

    CHUNK = 4096

    def __init__(self, bands: int, rows: int, k: int, seed: int = 11):
        self.bands, self.rows, self.k = bands, rows, k
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)
        self.number = np.arange(bands, dtype=np.uint64)

    def keys(self, ws: list[str]) -> list[int]:
        """One signed 64-bit key for each band."""
        return self._banded(self._least(shingles(ws, self.k)), np.uint64(0)).tolist()

    def openings(self, ws: list[str], least: int) -> np.ndarray:
        return self.openings_of(hashes(ws), least)

    def openings_of(self, h: np.ndarray, least: int) -> np.ndarray:
        """The keys of the first ``least``, ``2 * least``, ... words, as far as the text goes, one row for
        each opening. Keys of different lengths differ; every word is hashed once."""
        sizes = []
        while least << len(sizes) <= len(h):
            sizes.append(least << len(sizes))
        if not sizes:
            return np.zeros((0, self.bands), np.int64)
        x = runs(h, self.k)
        ends = [max(1, n - self.k + 1) for n in sizes]
        if ends[-1] <= self.CHUNK:
            seg = np.minimum.reduceat(self.a * x[None, : ends[-1]] + self.b, [0, *ends[:-1]], axis=1)
            low = np.minimum.accumulate(seg, axis=1).T
        else:
            rows, at, last = [], 0, None
            for to in ends:
                last = self._least(x[at:to], last)
                rows.append(last)
                at = to
            low = np.stack(rows)
        return self._banded(low, np.array(sizes, np.uint64)[:, None])

    def openings_of_all(self, h: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """``openings_of`` every one of several texts, below each other; ``h`` holds the hashes of their
        words in one row, ``sizes`` how many are whose, ``least`` and more of each."""
        x, last = runs(h, self.k), np.cumsum(sizes)
        many = np.array([openings_in(n, least) for n in sizes.tolist()])
        text = np.repeat(np.arange(len(sizes)), many)
        number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        words = least << number
        # where the part of each opening begins that the one before has not; behind the longest one, a rest
        ends = (last - sizes)[text] + np.maximum(words - self.k + 1, 1)
        first = number == 0
        begins = np.where(first, (last - sizes)[text], np.roll(ends, 1))
        low = np.minimum.reduceat(np.concatenate([x[:, None] * self.a.T + self.b.T, np.zeros((1, len(self.a)), np.uint64)]), np.stack([begins, ends], 1).ravel(), axis=0)[::2]
        for i in range(1, int(many.max())):
            at = np.flatnonzero(number == i)
            low[at] = np.minimum(low[at], low[at - 1])
        return self._banded(low, words.astype(np.uint64)[:, None])

    def _least(self, x: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        if low is None:
            low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), self.CHUNK):
            # the high bits of a product depend on all bits of the factor
            low = np.minimum(low, (self.a * x[None, i : i + self.CHUNK] + self.b).min(axis=1))
        return low

    def _banded(self, low: np.ndarray, salt) -> np.ndarray:
        """The keys of the minima in the last axis of ``low``."""
        key = self.number + np.uint64(self.bands) * salt
        parts = low.reshape(*low.shape[:-1], self.bands, self.rows)
        for r in range(self.rows):
            key = _mixed(key + parts[..., r])
        return key.view(np.int64)


def successions(ws: list[str], h: np.ndarray | None = None) -> np.ndarray:
    """A signed 32-bit hash of each word but the last and the first character after it: item ``k - 1``
    tells of the words ``k - 1`` and ``k``. ``h``: the words' ``hashes``, if known."""
    if len(ws) < 2:
        return np.zeros(0, np.int32)
    h = hashes(ws) if h is None else h
    first = np.frombuffer("".join([w[0] for w in ws[1:]]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (_mixed(h[:-1] + first * _MIX2) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprint(ws: list[str]) -> int:
    """Signed 64-bit hash of a word sequence."""
    x = xxhash.xxh3_64_intdigest(" ".join(ws))
    return x - (1 << 64) if x >> 63 else x


#: longs that hold the parities of a text
WIDTH = 8


def parities(ws: list[str]) -> list[int]:
    """For each of ``64 * WIDTH`` kinds of words a bit that tells whether their number is odd. Inserting
    or deleting a word changes one bit, replacing one at most two."""
    kinds = 64 * WIDTH
    odd = np.bincount((hashes(ws) & np.uint64(kinds - 1)).astype(np.int64), minlength=kinds) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def jaccard(a: list[str], b: list[str], k: int) -> float:
    """Similarity of two texts' runs of ``k`` words, repeated ones counted."""
    x, y = (Counter(zip(*(ws[i:] for i in range(k)))) for ws in (a, b))
    both = (x & y).total()
    return both / ((x.total() + y.total() - both) or 1)


def edits(a: list[str], b: list[str], most: int) -> int | None:
    """Least number of inserted, deleted or replaced words between ``a`` and ``b``, or None if it
    exceeds ``most``. Furthest points of each diagonal, so the work grows with the distance."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if a == b:
        return 0
    left, right = Counter(a), Counter(b)
    if max((left - right).total(), (right - left).total()) > most:
        return None
    goal = m - n
    reach: dict[int, int] = {}
    for e in range(most + 1):
        new: dict[int, int] = {}
        for d in range(-e, e + 1):
            if e == 0:
                i = 0
            else:
                i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            new[d] = i
            if d == goal and i >= n:
                return e
        reach = new
    return None
