"""Distances of pairs of nodes by walks from both ends, within a task.

The graph lies in two files of the shared folder that workers map: the neighbours of all nodes one after the other, and where those
of a node begin. Pairs are dealt to tasks, and a task walks a few pairs at once from both their ends: what a walk holds are sorted
numbers of (pair, node), never a row a node that Spark would shuffle, so a walk takes no disk. A task holds the fronts of a few pairs, of
one pair at least; the mapped files are the system's cache and not its memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.frontiers import numbered

#: Pairs walked at once, and edges followed at once: pairs that come to more walk on in halves.
PAIRS, EDGES = 256, 1 << 20
#: Pairs a task.
TASK = 20_000
#: A key is a pair, a node of so many bits, and a tag of two.
NODE, TAG = 40, 2


def _write(path: str, kind: str):
    """Rows ``(place, value)`` into the file ``path`` of numbers of a ``kind``, places from 0; a task that runs again writes the same."""
    size = np.dtype(kind).itemsize

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "r+b", buffering=0) as f:
            for rows in frames:
                place, value = rows["place"].to_numpy(np.int64), rows["value"].to_numpy(kind)
                for run in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) != 1) + 1):
                    if len(run):
                        os.pwrite(f.fileno(), value[run].tobytes(), int(place[run[0]]) * size)
                yield pd.DataFrame({"n": [len(place)]})

    return write


class Graph:
    """The files of a graph, mapped where they are read."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        return np.memmap(f"{self.folder}/begin", "<i8", "r"), np.memmap(f"{self.folder}/near", self.kind, "r")


def stored(links: DataFrame, nodes: int, folder: str) -> Graph:
    """``links(u, v)``, every edge once in both directions, of nodes numbered from 1 to ``nodes``, each with a link, as files in ``folder``."""
    placed = numbered(links.repartitionByRange("u", "v").sortWithinPartitions("u", "v"), "place").withColumn("place", F.col("place") - 1)
    graph = Graph(folder, "<i4" if nodes < 1 << 31 else "<i8")
    os.makedirs(folder, exist_ok=True)
    total = placed.count()
    for name, size in (("near", total * np.dtype(graph.kind).itemsize), ("begin", 8 * (nodes + 1))):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(size)
    firsts = placed.groupBy("u").agg(F.min("place").alias("value")).select((F.col("u") - 1).alias("place"), "value")
    end = links.sparkSession.range(1).select(F.lit(nodes).cast("bigint").alias("place"), F.lit(total).cast("bigint").alias("value"))
    firsts = firsts.unionByName(end).repartitionByRange("place").sortWithinPartitions("place")
    for name, rows, kind in (("near", placed.select("place", (F.col("v") - 1).alias("value")), graph.kind), ("begin", firsts, "<i8")):
        rows.mapInPandas(_write(f"{folder}/{name}", kind), "n bigint").agg(F.sum("n")).collect()  # one row
    return graph


def _follow(keys: np.ndarray, begin: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The keys a step on from ``keys``, repeats among them."""
    out = [np.zeros(0, np.int64)]
    low, count = _links(keys, begin)
    pair, ends = keys >> NODE << NODE, np.cumsum(count)
    start = 0
    while start < len(keys):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EDGES, "right")))
        n = count[start:stop]
        at = np.arange(n.sum()) + np.repeat(low[start:stop] - (np.cumsum(n) - n), n)
        found = np.repeat(pair[start:stop], n) | near[at].astype(np.int64)
        out.append(found if stop - start == len(keys) else np.unique(found))
        start = stop
    return np.concatenate(out)


def _links(keys: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of the nodes of ``keys`` begin, and how many there are."""
    node = keys & ((1 << NODE) - 1)
    low = begin[node]
    return low, begin[node + 1] - low


def walked(a: np.ndarray, b: np.ndarray, begin: np.ndarray, near: np.ndarray, max_degree: int | None = None) -> np.ndarray:
    """The distances of nodes ``a`` from ``b``, another each; -1 where there is no way, or none of up to ``max_degree`` steps.

    Of each pair that end walks a step whose front has fewer links; a pair is settled where its fronts meet."""
    out = np.full(len(a), -1, np.int64)
    pairs = np.arange(len(a), dtype=np.int64) << NODE
    none = np.zeros(0, np.int64)
    # (degree so far, fronts of both ends, what is one step behind them)
    work = [(0, [pairs | a, pairs | b], [none, none])]
    while work:
        degree, front, back = work.pop()
        if not len(front[0]) or degree == max_degree:
            continue
        of = [keys >> NODE for keys in front]
        links = [np.bincount(p, _links(keys, begin)[1], len(a)) for p, keys in zip(of, front)]
        turn = links[0] <= links[1]
        cost = np.where(turn, *links)
        if cost.sum() > EDGES and len(there := np.flatnonzero(np.bincount(of[0], minlength=len(a)))) > 1:
            half = there[len(there) // 2] << NODE
            work += [(degree, [k[k < half] for k in front], [k[k < half] for k in back]),
                     (degree, [k[k >= half] for k in front], [k[k >= half] for k in back])]
            continue
        degree += 1
        behind = [k >> NODE for k in back]
        moves = [turn[of[0]], ~turn[of[1]]]
        mine = np.concatenate([k[m] for k, m in zip(front, moves)])
        theirs = np.concatenate([k[~m] for k, m in zip(front, moves)])
        old = np.concatenate([mine, back[0][turn[behind[0]]], back[1][~turn[behind[1]]]])
        # One sort: of a node, what was there before comes first, then the other end's front, then the steps that reach it.
        all_ = np.sort(np.concatenate([old << TAG, theirs << TAG | 1, _follow(mine, begin, near) << TAG | 2]))
        key = all_ >> TAG
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        first, last = all_[edge] & 3, all_[np.append(edge[1:], len(all_)) - 1] & 3
        fresh = (first > 0) & (last == 2)
        met = np.unique(key[edge[fresh & (first == 1)]] >> NODE)
        out[met] = degree
        new = key[edge[fresh]]
        # A pair goes on that has not met and has new nodes.
        on = np.zeros(len(a), bool)
        on[new >> NODE] = True
        on[met] = False
        new = new[on[new >> NODE]]
        side = turn[new >> NODE]
        kept = [on[p] for p in of]
        front, back = (
            [np.sort(np.concatenate([front[0][~moves[0] & kept[0]], new[side]])), np.sort(np.concatenate([front[1][~moves[1] & kept[1]], new[~side]]))],
            [np.concatenate([front[s][moves[s] & kept[s]], back[s][(turn[behind[s]] == bool(s)) & on[behind[s]]]]) for s in (0, 1)])
        work.append((degree, front, back))
    return out


def distances(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """``pairs`` with a ``degree``: the distance of the nodes numbered ``u`` and ``v``, two different ones; -1 as in ``walked``."""
    n = pairs.count()
    tasks = max(1, min(-(-n // PAIRS), max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK))))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, near = graph.open()
        for rows in frames:
            u, v = rows["u"].to_numpy(np.int64) - 1, rows["v"].to_numpy(np.int64) - 1
            parts = [walked(u[i:i + PAIRS], v[i:i + PAIRS], begin, near, max_degree) for i in range(0, len(u), PAIRS)]
            yield rows.assign(degree=np.concatenate([np.zeros(0, np.int64), *parts]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.repartition(tasks, "u", "v").mapInPandas(walk, f"{schema}, degree bigint")
