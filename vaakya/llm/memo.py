"""Ids of pieces of text met before, in flat arrays."""

from __future__ import annotations

import sys
from collections.abc import Hashable, Sequence

import numpy as np
from pyspark import cloudpickle


class Memo:
    """Maps a key to its run of ids; whole texts are gathered at once."""

    def __init__(self) -> None:
        self.index: dict[Hashable, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def __len__(self) -> int:
        return len(self.index)

    def add(self, keys: Sequence[Hashable], ids: np.ndarray, lengths: np.ndarray) -> None:
        """``ids`` are those of all keys, one key after the other."""
        base = len(self.index)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(keys) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[base : base + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[base : base + len(keys)] = lengths
        self.index.update(zip(keys, range(base, base + len(keys))))
        self.used += len(ids)

    def gather(self, keys: Sequence[Hashable]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
