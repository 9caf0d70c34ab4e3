"""A growing multiset of numbers with logarithmic insertion and selection."""

from __future__ import annotations

import numpy as np


class OrderTree:
    """A Fenwick tree of counts over the sorted distinct values that may occur."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.tree = [0] * (len(self.values) + 1)
        self.top = 1 << max(0, len(self.values).bit_length() - 1)
        self.size = 0

    def fill(self, values: np.ndarray) -> None:
        """Insert many at once, in time linear in the distinct values."""
        counts = np.bincount(np.searchsorted(self.values, values), minlength=len(self.values))
        sums = np.concatenate([[0], np.cumsum(counts)])
        self.tree = [a + int(sums[i] - sums[i - (i & -i)]) for i, a in enumerate(self.tree)]
        self.size += len(values)

    def places(self, values: np.ndarray) -> list[int]:
        return np.searchsorted(self.values, values).tolist()

    def insert(self, place: int) -> None:
        i, n, tree = place + 1, len(self.tree), self.tree
        while i < n:
            tree[i] += 1
            i += i & -i
        self.size += 1

    def select(self, rank: int) -> float:
        """The rank-th smallest, from 1."""
        i, step, tree, n = 0, self.top, self.tree, len(self.tree)
        while step:
            j = i + step
            if j < n and tree[j] < rank:
                i, rank = j, rank - tree[j]
            step >>= 1
        return float(self.values[i])
