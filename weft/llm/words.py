"""Words and their 64-bit hashes for whole Arrow batches, byte by byte in numpy.

A word's hash is a polynomial of its bytes, mixed; words of more than LONG bytes, of which texts could be made whose
polynomials agree, have 64 bits of BLAKE2b.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .base import utf8

LONG = 256
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)]


def classes(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """By byte: what it becomes (A-Z are lowered), and whether it's part of a word. Bytes from 128 on are parts."""
    low, part = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if lower:
        low[65:91] += 32
    part[list(separators)] = False
    return low, part


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z.
ALNUM = classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: [^\x20\x09-\x0D]+ after lowering A-Z.
SPACED = classes(bytes([0x20, *range(0x09, 0x0E)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        _powers[0] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, BASE)]))
    return _powers[0]


@dataclass
class Words:
    """Words of a chunk in order: [start, end) in `low`, hash; `first` has the first word of each document and the end."""

    low: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find(texts: pa.Array, kinds: tuple[np.ndarray, np.ndarray], hashed: bool = True) -> Words:
    data, offsets = utf8(texts)
    low, part = kinds[0][data], kinds[1][data]
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    if len(low):
        before[1:], after[:-1] = part[:-1], part[1:]
        inner = offsets[(offsets > 0) & (offsets < len(low))]
        before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1
    size = end - start
    h = np.zeros(0, np.uint64)
    if hashed and len(start):
        lead = np.cumsum(size) - size
        place = np.arange(size.sum(), dtype=np.int32)
        place -= np.repeat(lead.astype(np.int32), size)
        signs = powers(min(int(size.max()), LONG + 1))[np.minimum(place, LONG)]
        del place
        signs *= low[part].astype(np.uint64) + np.uint64(1)
        h = np.add.reduceat(signs, lead)
        h = mix(h + size.astype(np.uint64) * STEP)
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = int.from_bytes(blake2b(low[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return Words(low, offsets, start, end, h, np.searchsorted(start, offsets))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes, by its first place; the last n-1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, last = np.zeros(len(h) - n + 1, np.uint64), len(h) - n + 1
    for k in range(n):
        out = out * BASE + h[k : k + last]
    return mix(out + np.uint64(n))


class HashTable:
    """Distinct 64-bit keys and a value each, probed for whole arrays; about 2-4 slots a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.mask, self.rounds = np.uint64((1 << bits) - 1), 0
        self.slots, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
        self.values = np.zeros((1 << bits, *values.shape[1:]), values.dtype)
        left = np.arange(len(keys))
        while len(left):
            slot = ((keys[left] + np.uint64(self.rounds)) & self.mask).astype(np.int64)
            free = ~self.used[slot]
            slot, took = np.unique(slot[free], return_index=True)
            won = left[free][took]
            self.slots[slot], self.used[slot], self.values[slot] = keys[won], True, values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.rounds += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not held."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k in range(self.rounds):
            slot = ((keys[left] + np.uint64(k)) & self.mask).astype(np.int64)
            hit = self.used[slot] & (self.slots[slot] == keys[left])
            out[left[hit]] = slot[hit]
            left = left[~hit & self.used[slot]]
            if not len(left):
                break
        return out
