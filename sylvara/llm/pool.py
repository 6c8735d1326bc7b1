"""Token ids of short pieces of text, each encoded once while it stays in a bounded table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class _Places(dict):
    """Place of each piece; an unknown piece gets the next place and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class Pool:
    """encode_many(pieces) gives the ids of pieces end to end and how many each has."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000) -> None:
        self.encode_many, self.limit = encode_many, limit
        self._clear()

    def _clear(self) -> None:
        self.places = _Places()
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def _thin(self) -> None:
        """Keep the pieces that were looked up most, half the limit at most and none that came only once."""
        n = len(self.places)
        hits = self.hits[:n]
        least = max(2, int(np.partition(hits, -(self.limit // 2))[-(self.limit // 2)]) + 1) if n > self.limit // 2 else 2
        keep = np.flatnonzero(hits >= least)
        names = list(self.places)
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        hits = hits[keep] // 2
        self._clear()
        self.places.update((names[k], i) for i, k in enumerate(keep.tolist()))
        self.ids, self.used = self._room(self.ids, len(ids)), len(ids)
        self.ids[: len(ids)] = ids
        for name, values in (("starts", ends - sizes), ("sizes", sizes), ("hits", hits)):
            array = self._room(getattr(self, name), len(keep))
            array[: len(keep)] = values
            setattr(self, name, array)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        more = np.zeros(max(n, len(array) * 3 // 2), array.dtype)
        more[: len(array)] = array
        return more

    def lookup(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and the number of ids of each piece."""
        if len(self.places) > self.limit:
            self._thin()
        at = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        if self.places.new:
            new, self.places.new = self.places.new, []
            ids, sizes = self.encode_many(new)
            had = len(self.places) - len(new)
            self.ids = self._room(self.ids, self.used + len(ids))
            self.starts, self.sizes, self.hits = (self._room(x, len(self.places)) for x in (self.starts, self.sizes, self.hits))
            self.ids[self.used : self.used + len(ids)] = ids
            self.sizes[had : had + len(new)] = sizes
            self.starts[had : had + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
        self.hits[: len(self.places)] += np.bincount(at, minlength=len(self.places))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)
        return self.ids[where], sizes
