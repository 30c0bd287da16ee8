"""Best-fit-decreasing packing of lengths into sequences of one capacity."""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity.

    A node counts the open bins whose remaining capacity lies in its range,
    so the fullest bin that still fits a length is found in O(log capacity).
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, bin_no: int, room: int) -> None:
        self.bins[room].append(bin_no)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(bin, room) with the least room >= length, taken out of the tree."""
        count, node = self.count, length + self.leaves
        while not count[node]:  # climb until a right sibling holds a bin
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node <<= 1
            if not count[node]:
                node += 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length (1..capacity) and the number of bins.

    Equal lengths keep their input order, so the packing is reproducible.
    """
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = CapacityTree(capacity), 0
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(length) if length < capacity else None
        if found is None:
            found, n = (n, capacity), n + 1
        at, room = found
        bin_of[i], offset[i] = at, capacity - room
        if room > length:
            tree.add(at, room - length)
    return bin_of, offset, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions.

    Two families over all their parameters: the threshold function (lengths
    above capacity - t count a whole bin, those below t nothing, the rest
    their share) and the rounding function floor((k + 1) x) / k, which keeps
    x where (k + 1) x is whole.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(number: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from the number of pieces of each length, 0 to capacity."""
    if not number.sum():
        return 0
    size = np.arange(capacity + 1)
    weight = np.cumsum(number * size)
    many = np.cumsum(number)
    t = np.arange(capacity // 2 + 1)
    whole = many[-1] - many[capacity - t]
    middle = weight[capacity - t] - np.where(t > 0, weight[t - 1], 0)
    best = int((whole - (-middle // capacity)).max())  # ceil, as whole is an integer
    used = np.flatnonzero(number)
    for k in range(1, 64):
        scaled = (k + 1) * used
        exact = scaled % capacity == 0
        # numerators over the common denominator k * capacity
        value = np.where(exact, used * k, scaled // capacity * capacity)
        best = max(best, int(-(-(number[used] * value).sum() // (k * capacity))))
    return best
