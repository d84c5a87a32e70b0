"""Token ids of short byte strings, worked out once per Python worker."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

#: Strings remembered per Python worker; when full, the memory starts anew.
REMEMBERED = 300_000


class SliceMemory:
    """``encode_many`` gives the ids of new strings; those seen before are found by their bytes."""

    def __init__(self, encode_many: Callable[[list[bytes]], list[list[int]]]):
        self.encode_many = encode_many
        self.cuts = False  # for users that cut some tokenizers' strings further
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each string in ``begins`` and ``counts``, which lead to its ids in ``flat``."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        found = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(pieces[i] for i in missing.tolist()))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            ids = self.encode_many(new)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begins = np.append(self.begins, len(self.flat) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.flat = np.append(self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())))
            found[missing] = [known[pieces[i]] for i in missing.tolist()]
        return found
