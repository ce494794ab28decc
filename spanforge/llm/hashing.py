"""Hashes as numpy arrays, and tables that are looked up by them."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(SPREAD)
    h ^= h >> U(29)
    h = h * U(BASE)
    return h ^ (h >> U(32))


class Table:
    """Values by distinct, evenly spread 64-bit keys, looked up many at a time: open addressing at half load at most.
    Pickled, it is its keys and values; slots are made again where it is read."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.values = values
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, U)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free  # of several for one slot, the last is in
            placed = self.slots[at[left]] == left
            left = left[~placed]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        full = self.slots >= 0
        self.keys[full] = keys[self.slots[full]]

    def __reduce__(self) -> tuple:
        full = self.slots >= 0
        keys = np.zeros(len(self.values), U)
        keys[self.slots[full]] = self.keys[full]
        return Table, (keys, self.values)

    def __len__(self) -> int:
        return len(self.values)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key's value is, or -1."""
        if not len(self.values):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found[left] = self.slots[at[left]]
            left = left[(found[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return found

    def get(self, keys: np.ndarray, default: np.ndarray | float, column: int = 0) -> np.ndarray:
        at = self.find(keys)
        if not len(self.values):
            return np.broadcast_to(np.asarray(default, float), len(keys)).copy()
        return np.where(at >= 0, self.values[at, column], default)


class Grown:
    """An array that grows at its end, in doubled room."""

    def __init__(self, kind: type) -> None:
        self.room, self.n = np.zeros(16, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]
