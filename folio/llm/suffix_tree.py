"""Suffix trees of sequences of numbers, and longest common extensions by them.

The tree is Ukkonen's, built in one pass; its Euler tour of string depths makes the
longest common extension of two places a range minimum, answered in constant time
(and for many pairs at once) from minima of blocks.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32


class RangeMin:
    """Minima of ranges of an array: prefix and suffix minima of blocks, a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = np.full((-(-n // BLOCK), BLOCK), np.iinfo(values.dtype).max, values.dtype)
        blocks.reshape(-1)[:n] = values
        self.values = values
        self.prefix = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value of places ``min(a, b)`` to ``max(a, b)``, for each pair."""
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.suffix[lo], self.prefix[hi])
        near = np.flatnonzero(first == last)
        if len(near):
            at, end = lo[near], hi[near]
            least = self.values[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            out[near] = least
        far = np.flatnonzero(last - first > 1)
        if len(far):
            s, e = first[far] + 1, last[far]
            level = np.frexp((e - s).astype(float))[1] - 1
            for k in np.unique(level):
                pick = far[level == k]
                s, e = first[pick] + 1, last[pick]
                out[pick] = np.minimum(out[pick], np.minimum(self.table[k][s], self.table[k][e - (1 << k)]))
        return out


class SuffixTree:
    """The tree of ``codes`` (numbers from 1 to ``kinds``) and an end mark, smaller than all of them."""

    def __init__(self, codes: np.ndarray, kinds: int):
        self.n = len(codes)
        self._build([*codes.tolist(), 0], kinds + 1)

    def _build(self, s: list[int], base: int) -> None:
        """Ukkonen: ``to`` maps (node, first number of an edge) to the node below it."""
        n = len(s)
        start, stop, link, suffix = [0], [0], [0], [-1]
        to: dict[int, int] = {}
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            waits = 0
            while left:
                if not length:
                    edge = i
                key = node * base + s[edge]
                below = to.get(key)
                if below is None:
                    to[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    suffix.append(i - left + 1)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    size = min(stop[below], i + 1) - start[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    if s[start[below] + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    split = len(start)
                    start += (start[below], i)
                    stop += (start[below] + length, n)
                    link += (0, 0)
                    suffix += (-1, i - left + 1)
                    start[below] += length
                    to[key] = split
                    to[split * base + c] = split + 1
                    to[split * base + s[start[below]]] = below
                    if waits:
                        link[waits] = split
                    waits = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        keys = np.fromiter(to.keys(), np.int64, len(to))
        nodes = np.fromiter(to.values(), np.int64, len(to))
        order = np.argsort(keys)  # by parent, then by number
        parents = keys[order] // base
        self.marked = (keys[order] % base == 0).tolist()
        self.kids = nodes[order].tolist()
        self.at = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        self.size = (np.array(stop) - np.array(start)).tolist()
        self.suffix = suffix

    def tour(self) -> np.ndarray:
        """Walk the tree once in order: sets up ``extension`` and returns the rank of every suffix."""
        kids, at, size, suffix = self.kids, self.at, self.size, self.suffix
        seen, place, leaves = [0], [0] * (self.n + 1), []
        next_kid = at[:]
        stack, depths = [0], [0]
        while stack:
            node = stack[-1]
            k = next_kid[node]
            if k < at[node + 1]:
                next_kid[node] = k + 1
                kid = kids[k]
                deep = depths[-1] + size[kid]
                if suffix[kid] >= 0:
                    place[suffix[kid]] = len(seen)
                    leaves.append(suffix[kid])
                    seen += (deep, depths[-1])
                else:
                    seen.append(deep)
                    stack.append(kid)
                    depths.append(deep)
            else:
                stack.pop()
                depths.pop()
                if stack:
                    seen.append(depths[-1])
        self.place = np.array(place)
        self.minima = RangeMin(np.array(seen, np.int32))
        return self._ranks(leaves)

    def _ranks(self, leaves: list[int]) -> np.ndarray:
        out = np.empty(len(leaves), np.int64)
        out[leaves] = np.arange(len(leaves))
        return out

    def ranks_reversed(self) -> np.ndarray:
        """The rank of every suffix where larger numbers come first; the end mark stays the smallest."""
        kids, at, suffix, marked = self.kids, self.at, self.suffix, self.marked
        leaves, stack = [], [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                continue
            lo, hi = at[node], at[node + 1]
            if marked[lo]:
                stack += kids[lo + 1:hi]
                stack.append(kids[lo])
            else:
                stack += kids[lo:hi]
        return self._ranks(leaves)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from places ``i`` and ``j`` on (different, up to the length) agree; after ``tour``."""
        return self.minima.query(self.place[i], self.place[j]).astype(np.int64)
