"""Cuckoo filters over 128-bit keys: 16-bit fingerprints, four to a bucket, filled and emptied in whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Rounds of moving entries on before what is left starts another layer.
ROUNDS = 64


class CuckooFilter:
    """A stack of tables of one width. ``has`` never misses what was added and not removed; it is wrong for about
    8 in 65,536 of other keys a layer. Entries that find no place in a layer go to the next, so nothing is refused.

    Keys come as two arrays of 64-bit halves. The upper bits of the first half choose the bucket, 16 bits of the second
    are the fingerprint, and the other bucket follows from bucket and fingerprint alone.
    """

    def __init__(self, expected: int):
        self.tables = np.zeros((1, max(64, 1 << int(expected / 3).bit_length()), SLOTS), np.uint16)

    @classmethod
    def load(cls, raw: bytes, buckets: int) -> CuckooFilter:
        out = cls.__new__(cls)
        out.tables = np.frombuffer(raw, np.uint16).reshape(-1, buckets, SLOTS).copy()
        return out

    def dump(self) -> tuple[bytes, int]:
        return self.tables.tobytes(), self.tables.shape[1]

    def _places(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (second.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return ((first.view(np.uint64) >> np.uint64(20)) & np.uint64(self.tables.shape[1] - 1)).astype(np.int64), prints

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (self.tables.shape[1] - 1))

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at, prints = self._places(first, second)
        found = np.zeros(len(at), bool)
        for table in self.tables:
            found |= (table[at] == prints[:, None]).any(1) | (table[self._other(at, prints)] == prints[:, None]).any(1)
        return found

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        at, prints = self._places(first, second)
        layer = 0
        while len(at):
            if layer == len(self.tables):
                self.tables = np.concatenate([self.tables, np.zeros_like(self.tables[:1])])
            at, prints = self._fill(self.tables[layer], at, prints)
            layer += 1

    def _fill(self, table: np.ndarray, at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts entries where there is room; returns those (bucket, fingerprint) that found none."""
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            at, prints = at[order], prints[order]
            rank = _rank(at)
            free = table[at] == 0
            fits = rank < free.sum(1)
            slot = (np.cumsum(free, 1) <= rank[:, None]).sum(1)
            table[at[fits], slot[fits]] = prints[fits]
            at, prints = at[~fits], prints[~fits]
            if not len(at):
                break
            if turn:  # one entry a bucket takes the place of another, which moves on
                taking = _rank(at) == 0
                slot = (np.arange(len(at)) + turn) % SLOTS
                out = table[at[taking], slot[taking]].copy()
                table[at[taking], slot[taking]] = prints[taking]
                prints[taking] = out
            at = self._other(at, prints)
        return at, prints

    def remove(self, first: np.ndarray, second: np.ndarray) -> None:
        """Takes out one entry a key; the keys must have been added."""
        at, prints = self._places(first, second)
        for table in self.tables:
            for turn in range(2):
                order = np.lexsort((prints, at))
                at, prints = at[order], prints[order]
                rank = _rank(at * 65536 + prints)
                same = table[at] == prints[:, None]
                there = rank < same.sum(1)
                slot = (np.cumsum(same, 1) <= rank[:, None]).sum(1)
                table[at[there], slot[there]] = 0
                at, prints = at[~there], prints[~there]
                at = self._other(at, prints)


def _rank(ordered: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value of an ordered array."""
    n = np.arange(len(ordered))
    return n - np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]][: len(n)], n, 0))
