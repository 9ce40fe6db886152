"""Bit-parallel walks from many starts.

The starts are numbered, and a node holds the starts that reach it as words of 63 bits: one row a
node and word in which a bit is set, so a start that reaches few nodes costs a row each, and starts
that share their nodes share their rows. A level sends the bits that are new at a node along its
edges and unites them at the other end (``bit_or``, summed before the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import cut_lineage, written

#: Starts a word: the sign of a long stays free.
WORD = 63


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (written) with numbers from 1 (the first bit of the first word) without gaps; only a count a partition reaches the driver."""
    at = cut_lineage(rows).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    offsets, total = [], 1
    for part, n in sorted(tuple(r) for r in at.groupBy("part").count().collect()):
        offsets.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(offsets, "part bigint, offset bigint")
    number = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("offset")
    return at.join(F.broadcast(offsets), "part").select(*rows.columns, number.alias(name))  # a row a partition


def first_level(numbers: DataFrame) -> DataFrame:
    """``numbers(start, number)`` as a level ``(package, word, fresh)``, each start at itself."""
    bit = F.expr(f"shiftleft(1L, int((number - 1) % {WORD}))")
    rows = numbers.select(F.col("start").alias("package"), F.expr(f"(number - 1) div {WORD}").alias("word"), bit.alias("bit"))
    return rows.groupBy("package", "word").agg(F.bit_or("bit").alias("fresh"))


def next_level(front: DataFrame, adj: DataFrame, before: list[DataFrame]) -> DataFrame:
    """The bits of ``front`` one step of ``adj(src, dst)`` on, without those that the levels ``before`` have at the same node."""
    none = F.lit(0).cast("bigint")
    sent = front.join(adj, F.col("package") == F.col("src")).select(
        F.col("dst").alias("package"), "word", F.col("fresh").alias("came"), none.alias("seen"))
    old = [level.select("package", "word", none.alias("came"), F.col("fresh").alias("seen")) for level in before]
    both = reduce(DataFrame.unionByName, [sent, *old]).groupBy("package", "word").agg(F.bit_or("came").alias("came"), F.bit_or("seen").alias("seen"))
    return both.select("package", "word", F.col("came").bitwiseAND(F.bitwise_not("seen")).alias("fresh")).where("fresh <> 0")


def walk(adj: DataFrame, numbers: DataFrame, max_degree: int | None = None, both_ways: bool = False) -> Iterator[DataFrame]:
    """The levels of a walk over ``adj(src, dst)`` from ``numbers(start, number)``: ``(package, word, fresh)``, written; ``fresh`` has
    the starts that reach the package at just this level. Ends when nothing is new or after ``max_degree`` levels. With ``both_ways``,
    ``adj`` has every edge in both directions, and what a step meets again is in the last two levels."""
    levels = [cut_lineage(first_level(numbers))]
    yield levels[0]
    while max_degree is None or len(levels) <= max_degree:
        level = cut_lineage(next_level(levels[-1], adj, levels[-2:] if both_ways else levels))
        if level.isEmpty():
            return
        levels.append(level)
        yield level


def bits_of(rows: DataFrame, bits: str = "fresh") -> DataFrame:
    """``rows`` with a row for each set bit of their word: its ``number`` for ``word`` and ``bits``."""
    every = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col(bits), i) == 1)
    places = F.when(F.bit_count(bits) == 1, F.array(F.bit_count(F.col(bits) - 1))).otherwise(every)
    more = [c for c in rows.columns if c not in ("word", bits)]
    return rows.select(*more, "word", F.explode(places).alias("place")).select(*more, (F.col("word") * WORD + F.col("place") + 1).alias("number"))


def starts_of(level: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(start, package)`` and any further columns of a level: the starts whose bits are fresh at its packages."""
    rows = bits_of(level)
    return rows.join(numbers, "number").select("start", *[c for c in rows.columns if c != "number"])


def meetings(adj: DataFrame, pairs: DataFrame, max_degree: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """Distances of ``pairs(a, b, number)``, ``a`` and ``b`` apart, over ``adj`` with every edge in both directions: at each
    degree from 1 on the words ``(word, met)`` of the pairs that far apart, written.

    Both ends walk, a step at a time in turn, and a pair is settled where its two fronts meet: each end goes half the way, so a
    pair costs the neighbourhoods of half its distance. Settled pairs walk no further. Ends with the last open pair, with
    ``max_degree``, or when no front is left."""
    ends = [[cut_lineage(first_level(pairs.select(F.col(c).alias("start"), "number")))] for c in ("a", "b")]
    left = written(ends[0][0].groupBy("word").agg(F.bit_or("fresh").alias("open")))
    degree = 0
    while (max_degree is None or degree < max_degree) and not left.isEmpty():
        mine, theirs = ends[degree % 2], ends[1 - degree % 2]
        degree += 1
        front = mine[-1].join(left, "word").select("package", "word", F.col("fresh").bitwiseAND(F.col("open")).alias("fresh")).where("fresh <> 0")
        level = cut_lineage(next_level(front, adj, mine[-2:]))
        mine.append(level)
        if level.isEmpty():
            return
        there = theirs[-1].select("package", "word", F.col("fresh").alias("theirs"))
        met = level.join(there, ["package", "word"]).groupBy("word").agg(F.bit_or(F.col("fresh").bitwiseAND(F.col("theirs"))).alias("met"))
        met = met.join(left, "word").select("word", F.col("met").bitwiseAND(F.col("open")).alias("met")).where("met <> 0")
        met = written(met)
        yield degree, met
        left = left.join(met, "word", "left").select(
            "word", F.col("open").bitwiseAND(F.bitwise_not(F.coalesce("met", F.lit(0).cast("bigint")))).alias("open")).where("open <> 0")
        left = written(left)
