"""A minimal perfect hash over 64-bit keys, as bytes: levels of bit arrays, each with the keys that met no other there.

A key's place is the number of set bits before its own; keys that met others on a level go on to the next. Where the levels
are used up, what is left is kept sorted. Each place stores a fingerprint of its key, so a key that was never put in is
turned away (but for one in 2**32).
"""

from __future__ import annotations

import struct

import numpy as np

from meetspark.llm.common import mix64

MAGIC, LEVELS, ROOM = b"MPH1", 24, 2.0


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 99) >> np.uint64(32)).astype("<u4")


def build(keys: np.ndarray, values: np.ndarray) -> bytes:
    """An index of distinct keys (int64); values: a row of 64-bit integers for each."""
    left, levels = np.arange(len(keys)), []
    placed: list[np.ndarray] = []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(ROOM * len(left)) + 63 & ~63)
        at = (_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        levels.append(np.packbits(bits, bitorder="little"))
        placed.append(left[alone][np.argsort(at[alone], kind="stable")])
        left = left[~alone]
    rest = left[np.argsort(keys[left], kind="stable")]
    order = np.concatenate([*placed, rest]).astype(np.int64)
    table = np.ascontiguousarray(values[order], dtype="<i8")
    head = struct.pack("<4sIIII", MAGIC, len(levels), len(order), len(rest), table.shape[1])
    return b"".join([head, *(struct.pack("<I", len(x)) + x.tobytes() for x in levels), keys[rest].astype("<i8").tobytes(), _prints(keys[order]).tobytes(), table.tobytes()])


class Index:
    """A built index; each lookup looks at as many bits as it has levels, whatever the number of keys."""

    def __init__(self, data: bytes):
        magic, levels, self.n, rest, width = struct.unpack_from("<4sIIII", data)
        if magic != MAGIC:
            raise ValueError("these bytes are no index")
        at, self.levels, before = struct.calcsize("<4sIIII"), [], 0
        for _ in range(levels):
            (size,) = struct.unpack_from("<I", data, at)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at + 4), bitorder="little")
            ranks = np.cumsum(bits, dtype=np.int64) + before
            before = int(ranks[-1])
            self.levels.append((bits, ranks))
            at += 4 + size
        self.rest = np.frombuffer(data, "<i8", rest, at)
        self.prints = np.frombuffer(data, "<u4", self.n, at := at + 8 * rest)
        self.values = np.frombuffer(data, "<i8", self.n * width, at + 4 * self.n).reshape(self.n, width)
        self.before = before

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 for one that was never put in."""
        keys = np.asarray(keys, dtype=np.int64)
        place, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            at = (_hash(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            place[left[hit]] = ranks[at[hit]] - 1
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            place[left[hit]] = self.before + at[hit]
        known = place >= 0
        known[known] = self.prints[place[known]] == _prints(keys[known])
        return np.where(known, place, -1)
