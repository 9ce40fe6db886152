"""The prefix trie of conversations, built as a burst trie.

A turn is known by two 64-bit hashes of its depth, role and text; a node by its depth and
the hashes of its turns, combined by exclusive or. Conversations are cut into segments of
``SEGMENT`` turns, each a suffix under the trie head that its earlier turns lead to; equal
segments of a head become one, with the number of their conversations and the smallest.

A container holds the suffixes under one head. One with over ``CONTAINER`` turns is burst: the
next turns become nodes (and heads) and the rest of each suffix moves into the container
of its next turn, until no container is too large. The containers left are dealt to
shards, sorted, and swept into nodes: neighbouring suffixes share a path as far as they
agree. What lies below a head is added to the nodes above it by pointer doubling over
the heads, so the number of rounds follows the logarithm of their depth.

No task holds more than one container or segment; copies are added up before they are
shuffled. The numbers of a conversation's turns are ranks over range partitions, so a
conversation may be larger than a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import col
from folio.session import bounded_broadcast, cut_lineage

SEGMENT = 64
#: Turns of the largest container that is swept as it is; not less than a segment.
CONTAINER = 20_000
#: Conversation ids whose list is one piece of a node's digest: at most two to this power.
PIECE_BITS = 16

HEAD = ["depth", "p1", "p2"]
NODE = "depth bigint, p1 bigint, p2 bigint"
SWEPT = ("head_depth bigint, head_p1 bigint, head_p2 bigint, " + NODE + ", n_convs bigint, conv_id bigint, "
         "parent_conv_id bigint, n_children bigint, n_leaves bigint, saved bigint, more boolean, top boolean")


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``(conv_id, pos, t1, t2, bytes)``: the turns of every conversation numbered from 1, as two hashes and the bytes of the text.

    Turns follow their number (null first), then role and text; a null role or text is empty. Repeated rows are
    turns of their own. Rows without a conversation id belong to none and are left out.
    """
    rows = turns.select(col(turns, id_col).cast("bigint").alias("conv_id"), col(turns, turn_col).alias("turn"),
                        F.coalesce(col(turns, role_col), F.lit("")).alias("role"), F.coalesce(col(turns, text_col), F.lit("")).alias("text"))
    first = F.col("turn").asc_nulls_first()
    rows = rows.where("conv_id is not null").repartitionByRange("conv_id", first).sortWithinPartitions("conv_id", first, "role", "text")
    # The rank within a range partition, and from the partitions' counts the rank within the conversation.
    rows = cut_lineage(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("t1"),
                                   F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.octet_length("text").cast("bigint").alias("bytes")))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("conv_id").orderBy("part")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("conv_id", "part", (F.sum("n").over(before) - F.col("n") - F.col("first") + 1).alias("shift"))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "t1", "t2", "bytes")


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """``(conv_id, depth, p1, p2, n, x1, x2, path, more)``: the suffix of ``n`` turns, at most ``size``, under the head
    ``(depth, p1, p2)``, with the exclusive or of its hashes; ``more`` if the conversation goes on."""
    e1, e2 = F.xxhash64("pos", "t1", "t2"), F.xxhash64(F.lit(7), "pos", "t1", "t2")
    rows = rows.select("conv_id", (F.floor((F.col("pos") - 1) / size) * size).alias("depth"), "pos", e1.alias("e1"), e2.alias("e2"), "bytes")
    out = rows.groupBy("conv_id", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(e1)").alias("x1"), F.expr("bit_xor(e2)").alias("x2"),
        F.sort_array(F.collect_list(F.struct("pos", "e1", "e2", "bytes"))).alias("path"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    for k in "12":
        out = out.withColumn(f"p{k}", F.coalesce(F.expr(f"bit_xor(x{k})").over(along.rowsBetween(Window.unboundedPreceding, -1)),
                                                 F.lit(0).cast("bigint")))
    return out.withColumn("more", F.lead("depth").over(along).isNotNull()).withColumn(
        "path", F.transform("path", lambda t: F.struct(t["e1"].alias("e1"), t["e2"].alias("e2"), t["bytes"].alias("bytes"))))


def _xor(k: str) -> Column:
    return F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}"))


def _as_head(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"head_{c}" for c in HEAD})


def _burst(suffixes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Containers of at most ``limit`` turns, and the nodes that stand for the burst ones (as ``SWEPT``)."""
    kept, nodes = [], []
    while True:
        over = cut_lineage(suffixes.groupBy(*HEAD).agg(F.sum("n").alias("turns")).where(F.col("turns") > limit).select(*HEAD))
        if over.isEmpty():
            break
        over = bounded_broadcast(over)
        kept.append(suffixes.join(over, HEAD, "left_anti"))
        large = suffixes.join(over, HEAD, "left_semi").withColumn("turn", F.get("path", F.lit(0)))
        large = large.withColumn("x1", F.col("turn.e1")).withColumn("x2", F.col("turn.e2")).withColumn("goes_on", F.col("more") | (F.col("n") > 1))
        node = large.groupBy(*HEAD, "x1", "x2").agg(F.sum("convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                                   F.max("turn.bytes").alias("bytes"), F.max("goes_on").alias("more"))
        node = node.select(*[F.col(c).alias(f"head_{c}") for c in HEAD], (F.col("depth") + 1).alias("depth"), _xor("1").alias("p1"),
                           _xor("2").alias("p2"), "n_convs", "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"),
                           F.lit(0).cast("bigint").alias("n_children"), (~F.col("more")).cast("bigint").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "more", F.lit(True).alias("top"))
        nodes.append(cut_lineage(node))
        suffixes = cut_lineage(large.where("n > 1").select(
            (F.col("depth") + 1).alias("depth"), _xor("1").alias("p1"), _xor("2").alias("p2"), (F.col("n") - 1).alias("n"),
            F.expr("slice(path, 2, int(n) - 1)").alias("path"), "convs", "conv_id", "more"))
    columns = [*HEAD, "n", "path", "convs", "conv_id", "more"]
    kept = reduce(DataFrame.unionAll, [k.select(*columns) for k in [*kept, suffixes]])
    return kept, reduce(DataFrame.unionAll, nodes) if nodes else kept.sparkSession.createDataFrame([], SWEPT)


class _Sweep:
    """The path from a container's head to the suffix last seen, and the nodes done."""

    E1, E2, P1, P2, BYTES, CONVS, LEAST, KIDS, LEAVES, SAVED, MORE, DONE = range(12)

    def __init__(self):
        self.head, self.path, self.out = None, [], []

    def cut(self, depth: int) -> None:
        """Nodes below ``depth`` are done: their counts go to their parents, their children get their least conversation."""
        path, (d, a, b) = self.path, self.head or (0, 0, 0)
        while len(path) > depth:
            node = path.pop()
            node[self.SAVED] += (node[self.CONVS] - 1) * node[self.BYTES]
            if not node[self.KIDS] and not node[self.MORE]:
                node[self.LEAVES] = 1
            self.out += [(d, a, b, *kid[:5], node[self.LEAST], *kid[5:], False) for kid in node[self.DONE]]
            row = (d + len(path) + 1, node[self.P1], node[self.P2], node[self.CONVS], node[self.LEAST],
                   node[self.KIDS], node[self.LEAVES], node[self.SAVED], node[self.MORE])
            if not path:
                self.out.append((d, a, b, *row[:5], None, *row[5:], True))
                continue
            up = path[-1]
            up[self.CONVS] += node[self.CONVS]
            up[self.LEAST] = min(up[self.LEAST], node[self.LEAST])
            up[self.KIDS] += 1
            up[self.LEAVES] += node[self.LEAVES]
            up[self.SAVED] += node[self.SAVED]
            up[self.DONE].append(row)

    def add(self, head: tuple, e1: list, e2: list, sizes: list, convs: int, least: int, more: bool) -> None:
        if head != self.head:
            self.cut(0)
            self.head = head
        path, same = self.path, 0
        while same < len(path) and same < len(e1) and path[same][self.E1] == e1[same] and path[same][self.E2] == e2[same]:
            same += 1
        self.cut(same)
        a, b = (path[-1][self.P1], path[-1][self.P2]) if path else head[1:]
        for k in range(same, len(e1)):
            a, b = a ^ e1[k], b ^ e2[k]
            path.append([e1[k], e2[k], a, b, sizes[k], 0, least, 0, 0, 0, False, []])
        end = path[-1]
        end[self.CONVS] += convs
        end[self.LEAST] = min(end[self.LEAST], least)
        end[self.MORE] = end[self.MORE] or more


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split(" ")[0] for f in SWEPT.split(", ")]
    types = {n: "boolean" if n in ("more", "top") else "Int64" for n in names}
    state = _Sweep()

    def done() -> pd.DataFrame:
        rows, state.out = state.out, []
        return pd.DataFrame(rows, columns=names).astype(types)

    for batch in batches:
        for d, a, b, e1, e2, sizes, convs, least, more in batch.itertuples(index=False, name=None):
            state.add((d, a, b), e1.tolist(), e2.tolist(), sizes.tolist(), convs, least, more)
        yield done()
    state.cut(0)
    yield done()


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies below the end of a suffix, for every node above that end within its container."""
    for batch in batches:
        for d, a, b, e1, e2, leaves, saved in batch.itertuples(index=False, name=None):
            n = len(e1) - 1
            if n:
                yield pd.DataFrame({"depth": d + 1 + np.arange(n), "p1": np.bitwise_xor.accumulate(e1[:-1]) ^ a,
                                    "p2": np.bitwise_xor.accumulate(e2[:-1]) ^ b, "n_leaves": leaves, "saved": saved})


def _below(units: DataFrame) -> DataFrame:
    """``(depth, p1, p2, n_children, n_leaves, saved)`` of every head, all below it included, by pointer doubling.

    ``units``: a row for each container's head with the sums of its own nodes and the head above (``up``, null at the root)."""
    units = cut_lineage(units)
    key = F.struct(*HEAD)
    while not units.where("up is not null").isEmpty():
        parts = units.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        over = units.select(F.struct(*HEAD).alias("up"), F.col("up").alias("next_up"))
        over = bounded_broadcast(over.join(parts.select("up"), "up", "left_semi"))
        units = units.join(over, "up", "left").join(parts.withColumnRenamed("up", "own"), key == F.col("own"), "left")
        units = cut_lineage(units.select(
            *HEAD, "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("next_up").alias("up")))
    return units.drop("up")


def _digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, p1, p2)`` -> the SHA-256 of each node's ids, ascending, joined by commas.

    Ids are joined in pieces of at most two to the power of ``PIECE_BITS``; the pieces of a node pass one task, one after the other."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *own, ids in batch.itertuples(index=False, name=None):
                if own == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=[*HEAD, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*HEAD, "ends_sha256"])

    pieces = ends.groupBy(*HEAD, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(*HEAD).sortWithinPartitions(*HEAD, "piece").select(*HEAD, "ids") \
        .mapInPandas(digest, NODE + ", ends_sha256 string")


def prefix_trie(rows: DataFrame, members: DataFrame, segment: int = SEGMENT, container: int = CONTAINER) -> DataFrame:
    """One row for every node of the trie of conversations.

    ``rows``: ``(conv_id, pos, t1, t2, bytes)`` as from ``numbered``, ``pos`` without gaps from 1. ``members``: ``(conv_id)`` of all
    conversations, those without turns included, each once. Returns ``(depth, p1, p2)``, which name the node; ``conv_id``, its smallest
    conversation; ``parent_conv_id``, that of its parent (null at the root); ``n_convs``; ``n_children``; ``n_leaves`` and ``saved_tokens``,
    the childless nodes and the sum of (conversations - 1) x bytes of the last text over its subtree; ``ends_sha256``, the
    SHA-256 of the comma-joined ids that end in it. The root is there if there is a conversation; without any there are no rows.
    """
    segments = cut_lineage(_segments(rows, segment))
    suffixes = segments.groupBy(*HEAD, "n", "x1", "x2").agg(F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("conv_id"),
                                                           F.max("more").alias("more"), F.first("path").alias("path"))
    containers, burst = _burst(cut_lineage(suffixes.drop("x1", "x2")), max(container, segment))
    paths = lambda df, *more: df.select(*HEAD, "path.e1", "path.e2", *more)
    swept = paths(containers.repartition(*HEAD).sortWithinPartitions(*HEAD, "path"), "path.bytes", "convs", "conv_id", "more").mapInPandas(_sweep, SWEPT)
    raw = cut_lineage(swept.unionAll(burst))

    # Containers under a head, and the head above each.
    folded = lambda k: F.aggregate("path", F.col(f"p{k}"), lambda x, t: x.bitwiseXOR(t[f"e{k}"]))
    tails = containers.where("more").withColumns({"end_depth": F.col("depth") + F.col("n"), "end_p1": folded("1"), "end_p2": folded("2")})
    up = F.struct(*[F.col(f"head_{c}").alias(c) for c in HEAD]).alias("up")
    above = _as_head(tails.select(*HEAD, *[f"end_{c}" for c in HEAD])).select(up, *[F.col(f"end_{c}").alias(c) for c in HEAD])
    above = above.unionAll(burst.where("more").select(up, *HEAD)).distinct()
    units = raw.where("top").groupBy(*[F.col(f"head_{c}").alias(c) for c in HEAD]).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    below = _below(units.join(above, HEAD, "left"))
    lower = paths(tails.join(below.select(*[F.col(c).alias(f"end_{c}") for c in HEAD], "n_leaves", "saved"), [f"end_{c}" for c in HEAD]),
                  "n_leaves", "saved").mapInPandas(_tails, NODE + ", n_leaves bigint, saved bigint")

    zero = F.lit(0).cast("bigint")
    root = members.agg(F.count("conv_id").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[zero.alias(c) for c in HEAD], "n_convs", "conv_id")
    heads = raw.where("more").select(*HEAD, "conv_id").unionAll(root.select(*HEAD, "conv_id"))
    heads = bounded_broadcast(_as_head(heads).withColumnRenamed("conv_id", "up_conv_id"))
    tops = raw.where("top").drop("parent_conv_id").join(heads, [f"head_{c}" for c in HEAD], "left").withColumnRenamed("up_conv_id", "parent_conv_id")
    ends = segments.where("not more").select("conv_id", (F.col("depth") + F.col("n")).alias("depth"), _xor("1").alias("p1"), _xor("2").alias("p2"))
    ends = ends.unionAll(members.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", *[zero.alias(c) for c in HEAD]))
    parts = [tops, raw.where("not top"), root, below, lower, _digests(ends)]
    values = {"n_convs": "bigint", "conv_id": "bigint", "parent_conv_id": "bigint", "n_children": "bigint", "n_leaves": "bigint",
              "saved": "bigint", "ends_sha256": "string"}
    every = reduce(DataFrame.unionAll, [p.select(*HEAD, *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in values.items()])
                                        for p in parts])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return every.groupBy(*HEAD).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        total("n_children").alias("n_children"), F.greatest(total("n_leaves"), F.lit(1)).alias("n_leaves"), total("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      segment: int = SEGMENT, container: int = CONTAINER) -> DataFrame:
    """``prefix_trie`` of a table of turns (see ``numbered``); a conversation is there if it has a row. Further columns are not read."""
    rows = cut_lineage(numbered(turns, id_col, turn_col, role_col, text_col))
    return prefix_trie(rows, rows.select("conv_id").distinct(), segment, container)
