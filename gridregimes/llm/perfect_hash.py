"""Minimal perfect hashing of 32-bit keys in slices: a slot for each key, a few bits a key, no key stored for it.

A slice's keys are hashed into a bit array of twice their number; keys that meet nobody set their bit, the others go on
to the next, smaller array. A key's slot is the number of set bits before its own. Slices are built by tasks on their
own and put side by side: their arrays follow each other, so the slot counts on over all slices.
"""

from __future__ import annotations

import numpy as np

#: Bits of an array for each key that is hashed into it.
ROOM = 2


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the arrays in bits, their bits one array after the other, the keys by slot) of different keys."""
    sizes, arrays, placed = [], [], []
    while len(keys):
        size = ROOM * len(keys)
        at = (_mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        order = np.argsort(at[alone])
        placed.append(keys[alone][order])
        arrays.append(bits)
        sizes.append(size)
        keys = keys[~alone]
    none = np.zeros(0, np.uint8)
    return np.array(sizes, np.int64), np.concatenate([none, *arrays]), np.concatenate([np.zeros(0, np.uint32), *placed])


class Slices:
    """Slices put side by side. ``ids``: the slices' numbers, ascending; ``n_slices``: how many there are in all."""

    def __init__(self, ids: list[int], n_slices: int, sizes: list[np.ndarray], bits: list[np.ndarray], keys: list[np.ndarray]):
        self.row = np.full(n_slices, -1, np.int64)
        self.row[ids] = np.arange(len(ids))
        depth = max(map(len, sizes), default=0)
        self.sizes = np.array([np.r_[x, np.zeros(depth - len(x), np.int64)] for x in sizes], np.int64).reshape(len(sizes), depth)
        self.begin = (np.cumsum(self.sizes.ravel()) - self.sizes.ravel()).reshape(self.sizes.shape)
        every = np.packbits(np.concatenate([np.zeros(0, np.uint8), *bits]), bitorder="little")
        self.words = np.concatenate([every, np.zeros(-len(every) % 8, np.uint8)]).view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate([np.zeros(0, np.uint32), *keys])
        self.ends = np.cumsum([len(x) for x in keys]).astype(np.int64)
        self.ids = ids

    def _set(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether bits are set, and how many set ones are before each."""
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        one = np.uint64(1)
        return word >> bit & one == one, self.before[at >> 6] + np.bitwise_count(word & ((one << bit) - one))

    def slots(self, keys: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for a key that is not here, as the key in its slot shows."""
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(self.row[slices] >= 0)
        row = self.row[slices[left]]
        for k in range(self.sizes.shape[1]):
            size = self.sizes[row, k]
            left, row, size = left[size > 0], row[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.begin[row, k] + (_mix(keys[left], k) % size.astype(np.uint64)).astype(np.int64)
            found, slot = self._set(at)
            slot = slot[found]
            out[left[found]] = np.where(self.keys[slot] == keys[left[found]], slot, -1)
            left, row = left[~found], row[~found]
        return out
