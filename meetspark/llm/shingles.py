"""Hashes of words and of runs of words, computed over whole batches of texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from meetspark.llm.common import balanced, mix64

#: Bytes that are hashed at once.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: By byte, whether it separates words: the six white space characters; or all of ASCII but letters and digits.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_CODES = mix64(np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint64) + np.uint64(0x51ED270B))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK * 2, 1 << (n + 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_hashes(texts: list[bytes], separators: np.ndarray = WHITE) -> Iterator[np.ndarray]:
    """For each UTF-8 text, a 64-bit hash of each of its words, A-Z lower-cased; words are what stands between separators.

    A word's hash is the difference of two running sums of its bytes' codes times powers of a base, moved to the first power.
    """
    for part in balanced([len(x) + 1 for x in texts], BLOCK):
        some = texts[part]
        data = np.frombuffer(b"\n".join([b"", *some, b""]), np.uint8)
        up, down = _power_tables(len(data))
        apart = separators[data]
        edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        sums = np.cumsum(_CODES[data] * up[: len(data)], dtype=np.uint64)
        hashes = mix64((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in some]))
        yield from (hashes[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct runs of `size` words as sorted 64-bit hashes; fewer words make one run; no words make none."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    total = np.full(n - k + 1, (k * 0xD6E8FEB86659FD93) % 2**64, np.uint64)
    for i in range(k):
        total = mix64(total + words[i : n - k + 1 + i]) if i == k - 1 else (total + words[i : n - k + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i)
    return np.unique(total)
