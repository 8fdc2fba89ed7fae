"""A cuckoo filter over 128-bit keys: a set that may say yes wrongly, never no, and that forgets single keys."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_MOVES = 500


class CuckooFilter:
    """A table of buckets of four 16-bit marks; a key's mark lies in one of two buckets.

    Removing a key that was added takes away one equal mark; other keys with that mark keep theirs.
    """

    def __init__(self, capacity: int = 64):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> "CuckooFilter":
        """A filter of these keys, as large as they need."""
        capacity = max(64, 2 * len(keys))
        while not (out := cls(capacity)).add(keys):
            capacity *= 2
        return out

    @staticmethod
    def split(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hash and mark (never zero) of 16-byte keys."""
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        marks = (words[:, 1] >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        return words[:, 0] >> np.uint64(8), marks

    def _other(self, bucket, mark):
        """The other bucket of a mark; the other of the other is the bucket itself."""
        spread = (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(5)) | np.uint64(1)
        return (np.asarray(bucket, np.uint64) ^ spread) & np.uint64(len(self.table) - 1)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        if keys:
            hashes, marks = self.split(keys)
            first = hashes & np.uint64(len(self.table) - 1)
            for bucket in (first, self._other(first, marks)):
                found |= (self.table[bucket.astype(np.int64)] == marks[:, None]).any(axis=1)
        return found

    def add(self, keys: list[bytes]) -> bool:
        """False if the table is too full; the caller then builds a larger one from all its keys."""
        return all(self._put(int(h), int(mark)) for h, mark in zip(*self.split(keys)))

    def _put(self, h: int, mark: int) -> bool:
        bucket = h & (len(self.table) - 1)
        for move in range(MAX_MOVES):
            for b in (bucket, int(self._other(bucket, mark))):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    return True
            slot = move % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(bucket, mark))
        return False

    def remove(self, keys: list[bytes]) -> None:
        for h, mark in zip(*self.split(keys)):
            first = int(h) & (len(self.table) - 1)
            for b in (first, int(self._other(first, int(mark)))):
                places = np.flatnonzero(self.table[b] == mark)
                if len(places):
                    self.table[b, places[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        out = cls()
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out
