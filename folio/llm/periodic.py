"""Runs: the maximal stretches of a text in which some words repeat with a period.

A run's period is the length of its Lyndon root under one of two orders of the words, the
second being the first reversed. The longest Lyndon word at every place follows from the
ranks of the suffixes; it is extended in both directions by the longest common extension of
its two ends, forward in the suffix tree of the words and backward in that of their
reversal. What is at least two periods long is a run, and every run is found so.

Before that a sieve finds the stretches that can hold runs at all: in a run of ``LEAST`` words or
more every word is in a sequence of ``GRAM`` words that occurs twice in it. So words
outside such sequences part a text into stretches, which are sieved again while they get
smaller. Nothing is lost, and trees are built for the stretches left only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.llm.suffix_tree import SuffixTree

#: Words of the shortest run, and of the sequences that the sieve looks for: at most half of it.
LEAST = 12
GRAM = 6
#: Words looked at together by a worker.
WORDS_AT_ONCE = 200_000
#: The sieve is no more than a sieve: after so many turns the stretches go to the trees as they are.
SIEVES = 8
RESULT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon_ends(ranks: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place on ends: at the next smaller suffix."""
    n = len(ranks)
    ends, stack = [n] * n, []
    for i, r in enumerate(ranks.tolist()):
        while stack and stack[-1][0] > r:
            ends[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(ends)


def runs_of(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` words of one stretch, by start, then period."""
    _, codes = np.unique(codes, return_inverse=True)
    n, kinds = len(codes), int(codes.max()) + 1
    tree, back = SuffixTree(codes + 1, kinds), SuffixTree(codes[::-1] + 1, kinds)
    forward = tree.tour()[:n]
    back.tour()
    found = []
    for ranks in (forward, tree.ranks_reversed()[:n]):
        i, j = np.arange(n), lyndon_ends(ranks)
        # The place n is the end mark's; nothing agrees from there on.
        start, stop = i - back.extension(n - i, n - j), j + tree.extension(i, j)
        found.append(np.stack([start, stop - start, j - i], axis=1))
    every = np.concatenate(found)
    every = every[every[:, 1] >= np.maximum(least, 2 * every[:, 2])]
    every = np.unique(every, axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def stretches(codes: np.ndarray, owner: np.ndarray, least: int = LEAST, gram: int = GRAM) -> Iterator[np.ndarray]:
    """The places of each stretch that may hold a run; ``codes`` are the words of several texts, ``owner`` their text."""
    gram = min(gram, least // 2)
    at = np.arange(len(codes))
    for _ in range(SIEVES):
        if len(at) < least:
            return
        word, mixed = codes[at].astype(np.uint64), owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums = mixed[:len(at) - gram + 1]
        for k in range(gram):
            sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k:len(at) - gram + 1 + k]
        inside = np.flatnonzero(owner[gram - 1:] == owner[:len(at) - gram + 1])
        order = inside[np.argsort(sums[inside])]
        same = sums[order[1:]] == sums[order[:-1]]
        twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        edges = np.bincount(twice, minlength=len(at) + 1) - np.bincount(twice + gram, minlength=len(at) + 1)
        kept = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        if not len(kept):
            return
        # Stretches of neighbouring words of one owner; the short ones are left out.
        number = np.cumsum(np.r_[False, (np.diff(kept) > 1) | (np.diff(owner[kept]) != 0)])
        long_enough = (np.bincount(number) >= least)[number]
        before = len(at), int(np.count_nonzero(np.diff(owner))) + 1
        at, owner = at[kept[long_enough]], number[long_enough]
        if before == (len(at), len(np.unique(owner))):
            break
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(owner)) + 1)


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each list of words, as ``runs_of``."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    words = np.empty(sum(map(len, texts)), object)
    words[:] = [w for t in texts for w in t]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0, *map(len, texts)])
    codes = pd.factorize(words)[0] if len(words) else np.empty(0, np.int64)
    by: dict[int, list[np.ndarray]] = {}
    for at in stretches(codes, owner, least):
        k = int(owner[at[0]])
        runs = runs_of(codes[at], least)
        runs[:, 0] += at[0] - first[k]
        by.setdefault(k, []).append(runs)
    for k, parts in by.items():
        out[k] = np.concatenate(parts)
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, each run but its first period left out."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def periodic_runs(text: Column, least: int = LEAST) -> Column:
    """``(n_words, runs, collapsed)`` of a text column, whole texts.

    Words are parted by ASCII white space. ``runs``: (start, length, period) of every run of at least ``least`` words (and
    two periods), counted in words, by start, then period. ``collapsed``: the words joined by one space, without
    those that a run has after its first period. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``; equal rows give equal results.
    """
    @F.pandas_udf(RESULT)
    def find(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows: list[tuple] = []
            part: list[list[bytes]] = []

            def done(part=part, rows=rows) -> None:
                rows.extend((len(words), runs.tolist(), collapse(words, runs).decode("utf-8", "replace"))
                            for words, runs in zip(part, find_runs(part, least), strict=True))
                part.clear()

            held = 0
            for text in texts:
                # bytes.split parts at just the white space of ASCII.
                part.append((text or "").encode("utf-8", "surrogatepass").split())
                held += len(part[-1])
                if held > WORDS_AT_ONCE:
                    done()
                    held = 0
            done()
            yield pd.DataFrame({"n_words": [r[0] for r in rows],
                                "runs": [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r[1]] for r in rows],
                                "collapsed": [r[2] for r in rows]})

    return find(text)
