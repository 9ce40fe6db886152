"""A cuckoo filter on numpy arrays, filled and emptied in bulk.

Buckets have four slots of 16-bit fingerprints, 0 meaning free. A key may be
put in more than once; ``copies`` counts the slots that hold its fingerprint,
so it is never less than the copies put in and not taken out. A shard's state is
a chain of filters: what does not fit the last one goes to a new one. All have
as many buckets as the first, so two keys that look alike in one filter look alike in
all, and taking either out leaves what the other needs.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8
KICKS = 64
#: Buckets of a filter at least: a shard that starts small may grow.
LEAST = 1024


def new_filter(keys: int) -> np.ndarray:
    buckets = max(LEAST, 1 << int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
    return np.zeros((buckets, SLOTS), np.uint16)


def _places(buckets: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and the two buckets of each key (128-bit digests as two int64 arrays)."""
    mark = np.maximum((lo.view(np.uint64) >> np.uint64(48)).astype(np.uint16), 1)
    one = (hi.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64)
    return mark, one, _other(buckets, one, mark)


def _other(buckets: int, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
    step = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return at ^ (step & np.uint64(buckets - 1)).astype(np.int64)


def _settle(slots: np.ndarray, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Put marks in free slots of bucket ``at``; returns which of them found one."""
    order = np.argsort(at, kind="stable")
    b = at[order]
    first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
    free = slots[b] == 0
    fits = rank < free.sum(1)
    nth = np.cumsum(free, 1) == (rank + 1)[:, None]
    slots[b[fits], np.argmax(nth & free, 1)[fits]] = mark[order][fits]
    done = np.zeros(len(at), bool)
    done[order] = fits
    return done


def put(slots: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Put keys in. Marks evicted without a place after KICKS rounds would be lost, so a
    round that cannot settle is undone: returns which keys are not in (all or none of a late rest)."""
    mark, at, other = _places(len(slots), hi, lo)
    left = np.arange(len(mark))
    left = left[~_settle(slots, at, mark)]
    left = left[~_settle(slots, other[left], mark[left])]
    out = np.zeros(len(mark), bool)
    if not len(left):
        return out
    saved = slots.copy()
    m, b, rng = mark[left], other[left], np.random.default_rng(7)
    for _ in range(KICKS):
        pick = np.unique(b, return_index=True)[1]  # one eviction a bucket and round
        rest = np.ones(len(b), bool)
        rest[pick] = False
        s = rng.integers(0, SLOTS, len(pick))
        evicted = slots[b[pick], s].copy()
        slots[b[pick], s] = m[pick]
        moved = _other(len(slots), b[pick], evicted)
        m, b = np.r_[m[rest], evicted], np.r_[b[rest], moved]
        ok = _settle(slots, b, m)
        m, b = m[~ok], b[~ok]
        if not len(m):
            return out
    slots[:] = saved
    out[left] = True
    return out


def copies(slots: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    mark, one, two = _places(len(slots), hi, lo)
    n = (slots[one] == mark[:, None]).sum(1)
    return n + np.where(one != two, (slots[two] == mark[:, None]).sum(1), 0)


def take(slots: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Take one copy of each key out where one is found; returns which were."""
    mark, one, two = _places(len(slots), hi, lo)
    done = np.zeros(len(mark), bool)
    for i in range(len(mark)):  # one after the other: keys may share a bucket and a mark
        for b in (one[i], two[i]):
            at = np.flatnonzero(slots[b] == mark[i])
            if len(at):
                slots[b, at[0]] = 0
                done[i] = True
                break
    return done


class Chain:
    """The filters of one shard."""

    def __init__(self, blobs: list[bytes] | None = None):
        self.filters = [np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy() for b in blobs or []]

    def blobs(self) -> list[bytes]:
        return [f.tobytes() for f in self.filters]

    def put(self, hi: np.ndarray, lo: np.ndarray) -> None:
        if self.filters and len(hi):
            last = self.filters[-1]
            room = max(0, int(last.size * LOAD) - np.count_nonzero(last))
            rest = np.r_[put(last, hi[:room], lo[:room]), np.ones(max(0, len(hi) - room), bool)]
            hi, lo = hi[rest], lo[rest]
        while len(hi):
            self.filters.append(np.zeros_like(self.filters[0]) if self.filters else new_filter(len(hi)))
            rest = put(self.filters[-1], hi, lo)
            hi, lo = hi[rest], lo[rest]

    def take(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for f in reversed(self.filters):
            gone = take(f, hi, lo)
            hi, lo = hi[~gone], lo[~gone]

    def copies(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return sum((copies(f, hi, lo) for f in self.filters), np.zeros(len(hi), np.int64))
