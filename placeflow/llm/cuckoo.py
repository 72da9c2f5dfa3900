"""Cuckoo filters over 16-byte keys, as flat numpy arrays that travel in one binary cell per shard."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_EMPTY = 0


class CuckooFilter:
    """Partial-key cuckoo hashing with 16-bit fingerprints and four slots a bucket.

    Insert and delete keep one fingerprint per inserted key, so deletions never disturb other keys. A filter that cannot
    place a fingerprint doubles its buckets from the exact table of its owner: insert then returns the keys it could not place.
    """

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) uint16, buckets a power of two

    @classmethod
    def sized_for(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.6)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        out = cls.sized_for(len(keys))
        while len(out.insert(keys)):
            out = cls(np.zeros((2 * len(out.table), SLOTS), np.uint16))
        return out

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets of (n, 2) uint64 keys; either bucket gives the other."""
        mask = np.uint64(len(self.table) - 1)
        print_ = (keys[:, 0] >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == _EMPTY, np.uint16(1), print_)
        one = keys[:, 1] & mask
        return print_, one.astype(np.int64), self._other(one, print_).astype(np.int64)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.uint64) ^ (print_.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def _place(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts each fingerprint into a free slot of its bucket as far as there are any; which ones found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = np.cumsum(self.table == _EMPTY, axis=1)
        fits = rank < free[b, -1]
        slot = np.argmax(free[b[fits]] == (rank[fits] + 1)[:, None], axis=1)
        self.table[b[fits], slot] = print_[order[fits]]
        return np.sort(order[~fits])

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds (n, 2) uint64 keys; the indices of those for which there was no room."""
        if not len(keys):
            return np.zeros(0, np.int64)
        print_, one, two = self._places(keys)
        left = self._place(print_, one)
        if len(left):
            left = left[self._place(print_[left], two[left])]
        failed = [i for i in left.tolist() if not self._kick(int(print_[i]), int(two[i]))]
        return np.array(failed, np.int64)

    def _kick(self, print_: int, bucket: int, most: int = 500) -> bool:
        trail = []
        for step in range(most):
            row = self.table[bucket]
            free = np.flatnonzero(row == _EMPTY)
            if len(free):
                row[free[0]] = print_
                return True
            slot = (step * 7 + bucket) % SLOTS
            trail.append((bucket, slot, int(row[slot])))
            print_, row[slot] = int(row[slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_]))[0])
        for bucket, slot, old in reversed(trail):
            self.table[bucket, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint for each key; the keys must have been inserted."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                slot = np.flatnonzero(self.table[bucket] == p)
                if len(slot):
                    self.table[bucket, slot[0]] = _EMPTY
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        return (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)
