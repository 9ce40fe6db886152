"""Best-fit packing of tokenised documents, in bulk-synchronous rounds.

Documents longer than a sequence are cut first; whole-sequence pieces are done.
Of the others, a round range-sorts pieces and gaps together by size and sweeps each
range partition once: every gap takes the largest piece below it that no
smaller gap has taken, as brackets are matched. What a partition cannot
match is resolved by rank between partitions, from the counts that each has left.
Gaps are updated, pieces that fit no gap open as many new sequences as their
tokens need (the largest first), and the next round follows until all are placed.

Only counts reach the driver: pieces by size (at most one row a token count) and
the rest of each range partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import col
from folio.llm.tokens import encoder
from folio.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: Rows that one task sweeps.
ROWS_A_TASK = 200_000
#: Characters tokenised at once by a worker.
CHARS_AT_ONCE = 1_000_000


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be short."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the pieces of every row of ``docs``.

    A document is its token ids and ``end_id``; a null or empty text is the end
    id alone. Repeated rows are documents of their own; a null id stays null.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    @F.pandas_udf(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    def cut(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer_path).encode
        for texts in series:
            out: list[list[tuple]] = []
            marks = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE
            for part in np.split(texts.to_numpy(), np.flatnonzero(np.diff(marks)) + 1):
                for ids in encode(part.tolist()):
                    ids += end
                    own = [(k, s, n, ids[4 * s:4 * (s + n)]) for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
                    out.append([(k, s, n, zlib.crc32(x), *([np.frombuffer(x, "<i4")] * with_ids)) for k, s, n, x in own])
            yield pd.Series(out, dtype=object)

    rows = docs.select(col(docs, id_col).alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range partition, sorted: pairs of piece and gap, and what is left with its rank."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    gap, ids = rows["gap"].to_numpy(bool), rows["id"].to_numpy(np.int64)
    mate, open_pieces = np.full(len(rows), -1, np.int64), []
    for i, is_gap in enumerate(gap.tolist()):
        if not is_gap:
            open_pieces.append(i)
        elif open_pieces:
            mate[i] = open_pieces.pop()
    paired, taken = mate >= 0, np.zeros(len(rows), bool)
    taken[mate[paired]] = True
    lone = ~paired & ~taken
    rank = np.where(gap, np.cumsum(lone & gap), np.cumsum(lone & ~gap)) - 1
    part = TaskContext.get().partitionId()
    size = rows["size"].to_numpy(np.int64)
    yield pd.DataFrame({"part": part, "gap": False, "rank": -1, "id": ids[mate[paired]],
                        "size": size[mate[paired]], "bin": ids[paired]})
    yield pd.DataFrame({"part": part, "gap": gap[lone], "rank": rank[lone], "id": ids[lone],
                        "size": size[lone], "bin": -1})


def _between(left: list) -> list[tuple]:
    """Match what partitions have left. ``left``: (part, gap, count). Returns intervals
    (part, gap, from rank, to rank, first match number, backwards)."""
    counts = {(r["part"], r["gap"]): r["count"] for r in left}
    stack, out, number = [], [], 0
    for p in sorted({p for p, _ in counts}):
        gaps, at = counts.get((p, True), 0), 0
        while at < gaps and stack:
            q, hi = stack.pop()
            k = min(gaps - at, hi)
            out += [(p, True, at, at + k, number, False), (q, False, hi - k, hi, number, True)]
            at, number = at + k, number + k
            if hi > k:
                stack.append((q, hi - k))
        if counts.get((p, False)):
            stack.append((p, counts[p, False]))
    return out


def match(todo: DataFrame, slots: DataFrame, rows: int) -> DataFrame:
    """Pieces ``(id, size)`` and gaps ``(id, size)`` -> ``(id, size, bin)``; each gap takes one piece at most."""
    spark = todo.sparkSession
    both = todo.select("size", F.lit(False).alias("gap"), "id").unionAll(
        slots.select("size", F.lit(True).alias("gap"), "id"))
    parts = -(-rows // ROWS_A_TASK)
    swept = cut_lineage(both.repartitionByRange(parts, "size", "gap", "id").sortWithinPartitions("size", "gap", "id")
                        .mapInPandas(_sweep, "part int, gap boolean, rank bigint, id bigint, size bigint, bin bigint"))
    lone = swept.where("rank >= 0")
    spans = _between(lone.groupBy("part", "gap").count().collect())
    paired = swept.where("rank < 0").select("id", "size", "bin")
    if not spans:
        return paired
    spans = spark.createDataFrame(spans, "part int, gap boolean, lo bigint, hi bigint, number bigint, back boolean")
    met = lone.join(F.broadcast(spans), ["part", "gap"]).where("rank >= lo and rank < hi").select(  # two rows a partition
        "gap", "id", "size", (F.col("number") + F.expr("if(back, hi - 1 - rank, rank - lo)")).alias("number"))
    across = met.where("not gap").join(met.where("gap").select("number", F.col("id").alias("bin")), "number")
    return paired.unionAll(across.select("id", "size", "bin"))


def _opening(sizes: list[tuple[int, int]], fit: int, capacity: int) -> tuple[int, int]:
    """Which pieces open sequences: all larger than the first number, and as many of just that size as the second
    number says. ``sizes``: (size, count), of which those over ``fit`` fit no gap."""
    lone = sorted(((s, n) for s, n in sizes if s > fit), reverse=True)
    need = max(-(-sum(s * n for s, n in lone) // capacity), sum(n for s, n in lone if 2 * s > capacity))
    for s, n in lone:
        if need <= n:
            return s, need
        need -= n
    return fit, 0


def _first(rows: DataFrame, n: int) -> DataFrame:
    """Just ``n`` of ``rows`` (which are written), from their partitions in turn: only a count a partition reaches the driver."""
    ranked = rows.withColumn("rank", F.monotonically_increasing_id())
    ranked = ranked.withColumn("part", F.shiftright("rank", 33)).withColumn("rank", F.col("rank").bitwiseAND((1 << 33) - 1))
    quotas = []
    for part, count in sorted(tuple(r) for r in ranked.groupBy("part").count().collect()):
        quotas.append((part, min(count, n)))
        n -= quotas[-1][1]
    quotas = rows.sparkSession.createDataFrame(quotas, "part bigint, quota bigint")
    return ranked.join(F.broadcast(quotas), "part").where("rank < quota").select(*rows.columns)  # a row a partition


def place(todo: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``(id bigint, size bigint)`` with unique ids, sizes 1 to ``capacity`` -> ``(id, size, bin)``."""
    todo = cut_lineage(todo)
    none = todo.sparkSession.createDataFrame([], "id bigint, size bigint")
    gaps, placed = none, []
    while sizes := [tuple(r) for r in todo.groupBy("size").count().collect()]:
        n_gaps, widest = gaps.agg(F.count(F.lit(1)), F.max("size")).first()
        least, most = min(s for s, _ in sizes), max(s for s, _ in sizes)
        fit = min(widest or 0, most)
        # A gap that holds several pieces of any size at hand is as many slots.
        done = []
        if fit >= least:
            slots = gaps.where(F.col("size") >= least)
            times = F.greatest(F.lit(1), F.floor(F.col("size") / fit)).cast("int")
            slots = slots.select("id", F.when(times > 1, F.lit(fit)).otherwise(F.col("size")).cast("bigint").alias("size"),
                                 F.explode(F.sequence(F.lit(1), times))).select("id", "size")
            done.append(match(todo.where(F.col("size") <= fit), slots, sum(n for _, n in sizes) + n_gaps))
        size, need = _opening(sizes, fit, capacity) if widest is None or most > widest else (capacity, 0)
        lone = todo.where(F.col("size") > fit)
        opening = [lone.where(F.col("size") > size)] + ([_first(lone.where(F.col("size") == size), need)] if need else [])
        done += [o.select("id", "size", F.col("id").alias("bin")) for o in opening]
        step = cut_lineage(reduce(DataFrame.unionAll, done))
        placed.append(step)
        todo = cut_lineage(todo.join(step.select("id"), "id", "left_anti"))
        used = step.groupBy("bin").agg(F.sum("size").alias("used"))
        opened = step.where("id = bin").select("id", F.lit(capacity).cast("bigint").alias("size"))
        gaps = gaps.unionAll(opened).join(used, F.col("id") == F.col("bin"), "left").select(
            "id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")).where("size > 0")
        gaps = cut_lineage(gaps)
    out = todo.select("id", "size", F.col("id").alias("bin"))
    for step in placed:
        out = out.unionAll(step)
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (see ``pieces``) with its ``sequence_id`` and ``offset`` there.

    Sequences hold ``capacity`` tokens at most, from 0 without gaps. An empty
    table gives no rows. Further columns of ``docs`` are not read.
    """
    cut = cut_lineage(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
                      .withColumn("id", F.monotonically_increasing_id()))
    short = place(cut.where(F.col("length") < capacity).select("id", F.col("length").alias("size")), capacity)
    before = F.sum("size").over(_in_sequence())
    short = short.withColumn("offset", before - F.col("size")).select("id", F.col("bin").alias("sequence_id"), "offset")
    whole = cut.where(F.col("length") >= capacity).select("*", F.col("id").alias("sequence_id"),
                                                          F.lit(0).cast("bigint").alias("offset"))
    return cut.where(F.col("length") < capacity).join(short, "id").select(whole.columns).unionAll(whole).drop("id")


def _in_sequence():
    from pyspark.sql import Window

    return Window.partitionBy("bin").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
