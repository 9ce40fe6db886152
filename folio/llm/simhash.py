"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit fingerprint. To find all pairs within ``max_bits``
bits, the fingerprint is cut into blocks so that some block of a linked pair
differs in at most one bit. The anchors of a block are the words of a covering
code of radius 1: a perfect Hamming code on 2^r - 1 bits, times all values of
the bits left over. A fingerprint is at home at its nearest anchor (distance at
most 1) and a guest at every anchor within 1 + 1 bits: if x and y differ in at
most one bit of the block, y is a guest where x is at home. Homes and guests
meet by an equi-join on the anchor and are compared on the whole fingerprint.

Skew. Equal fingerprints are one row from the start. Families of many near
copies would make pairs by the square, so links that a sort finds cheaply are
contracted first (neighbours in the order of each rotation of the bits),
anchors whose fingerprints all lie in one family are left out, and the
join only returns links between different families. It is a sort-merge join, so
Spark splits the partitions of crowded anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import col, has_map, row_hash
from folio.operators.components import components
from folio.session import cut_lineage

SEED = 42
CHUNK = 1 << 16


def fingerprint_text(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + k - 1:hi + k - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_text(t, shingle) for t in texts], dtype="int64")

    return of(text)


def blocks_for(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block: so many that one of them differs in at most one bit."""
    m = (max_bits + 2) // 2
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def anchors(fps: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor, is its home) for one block of unsigned fingerprints."""
    mask = np.uint64((1 << bits) - 1)
    x = (fps >> np.uint64(first)) & mask
    r = bits.bit_length() if (1 << bits.bit_length()) - 1 <= bits else bits.bit_length() - 1
    n = (1 << r) - 1  # bits of the Hamming code; position p (from 0) has the label p + 1
    syndrome = np.zeros(len(x), np.int64)
    for p in range(n):
        syndrome ^= np.where((x >> np.uint64(p)) & np.uint64(1), p + 1, 0)
    one = np.uint64(1)
    flip = lambda label: np.where(label > 0, one << (np.maximum(label, 1) - 1).astype(np.uint64), np.uint64(0))
    rows = np.arange(len(x))
    home = x ^ flip(syndrome)
    out = [(rows, home, np.ones(len(x), bool))]
    for p in range(n, bits):  # one of the left-over bits differs
        out.append((rows, home ^ (one << np.uint64(p)), np.zeros(len(x), bool)))
    for label in range(1, n + 1):  # two positions of the code whose labels add up to the syndrome
        other = syndrome ^ label
        ok = (other > label) & (syndrome > 0)
        out.append((rows[ok], x[ok] ^ flip(np.full(ok.sum(), label)) ^ flip(other[ok]), np.zeros(ok.sum(), bool)))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def replicas(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, family)`` -> ``(block, anchor, fp, family, home)``: at most 34 rows for 3 bits."""
    blocks = blocks_for(max_bits)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fp = pdf["fp"].to_numpy(np.int64)
            for b, (first, bits) in enumerate(blocks):
                row, anchor, home = anchors(fp.view(np.uint64), first, bits)
                yield pd.DataFrame({"block": np.full(len(row), b, np.int32), "anchor": anchor.view(np.int64),
                                    "fp": fp[row], "family": pdf["family"].to_numpy()[row], "home": home})

    return fps.mapInPandas(spread, "block int, anchor bigint, fp bigint, family bigint, home boolean")


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def neighbour_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links between neighbours in the order of the bits rotated by 0, 16, 32 and 48.

    Range partitions are sorted on their own; a pair cut by a partition border
    is only left for the anchors to find.
    """
    turned = [F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)) if r else F.col("fp")
              for r in (0, 16, 32, 48)]
    rows = fps.select("fp", F.posexplode(F.array(*turned)).alias("turn", "turned"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "turn", "turned").sortWithinPartitions("turn", "turned")

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = np.zeros(0, np.int64)
        for pdf in frames:
            fp = np.concatenate([last, pdf["fp"].to_numpy(np.int64)])
            near = np.bitwise_count((fp[1:] ^ fp[:-1]).view(np.uint64)) <= max_bits
            yield pd.DataFrame({"u": fp[1:][near], "v": fp[:-1][near]})
            last = fp[-1:]

    return rows.select("fp").mapInPandas(links, "u bigint, v bigint")


def families(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Distinct ``fp`` -> ``(fp, family)``: family is the least fingerprint (as a signed number)
    that a chain of links of at most ``max_bits`` bits reaches."""
    near = components(neighbour_links(fps, max_bits))
    first = fps.join(near, fps.fp == near.node, "left").select("fp", F.coalesce("component", "fp").alias("family"))
    first = cut_lineage(first)
    spread = replicas(first, max_bits)
    mixed = spread.groupBy("block", "anchor").agg(
        F.min("family").alias("lo"), F.max("family").alias("hi"), F.max("home").alias("any_home")) \
        .where("lo <> hi and any_home").select("block", "anchor")
    kept = spread.join(mixed, ["block", "anchor"], "left_semi")
    homes = kept.where("home").select("block", "anchor", F.col("fp").alias("a"), F.col("family").alias("u"))
    guests = kept.select("block", "anchor", F.col("fp").alias("b"), F.col("family").alias("v"))
    met = homes.hint("merge").join(guests, ["block", "anchor"]).where(F.col("u") != F.col("v")) \
        .where(_near("a", "b", max_bits))
    links = met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    merged = components(links)
    return first.join(merged, first.family == merged.node, "left") \
        .select("fp", F.coalesce("component", "family").alias("family"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id among the rows whose fingerprints are
    linked, through chains of at most ``max_bits`` differing bits.

    Nulls: a null text counts as empty (fingerprint 0, linked like any other);
    a row with a null id takes part, but is never the smallest id, and a
    component with no other rows has a null ``component_id``. Repeated rows and
    ids each give a row. An empty table gives no rows. Further columns of
    ``docs`` are not read.
    """
    rows = cut_lineage(docs.select(col(docs, id_col).alias("doc_id"), fingerprint(col(docs, text_col), shingle).alias("fp")))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    fam = cut_lineage(families(fps.select("fp"), max_bits))
    labelled = fam.join(fps, "fp")
    least = labelled.groupBy("family").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(least, "family").select("fp", "component_id", "family")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id", "family")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each group the row with the smallest id stays.

    A null id is larger than any other. Among rows with the same id the one
    with the least hash of its columns stays, and of fully equal rows one. All
    columns are kept as they are, whatever their names.
    """
    marks = _marks(docs, id_col)
    rows = cut_lineage(docs.select(fingerprint(col(docs, text_col), shingle).alias("fp"), F.struct(*marks).alias("key")))
    fps = rows.groupBy("fp").agg(F.min("key").alias("first"))
    fam = cut_lineage(families(fps.select("fp"), max_bits))
    best = fam.join(fps, "fp").groupBy("family").agg(F.min("first").alias("key")).select("key")
    best = cut_lineage(best.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("key.*", "n"))
    return _only(docs, best.where("n = 1"), marks).unionByName(
        _only(docs, best.where("n > 1"), marks).dropDuplicates(_plain(docs)))


def _marks(docs: DataFrame, id_col: str) -> list[Column]:
    """What orders rows of a group: rows without an id last, then the id, then a hash of the row."""
    key = col(docs, id_col)
    return [key.isNull().alias("r"), key.alias("i"), row_hash(docs).alias("t")]


def _only(docs: DataFrame, keys: DataFrame, marks: list[Column]) -> DataFrame:
    same = [m.eqNullSafe(keys[k]) for m, k in zip(marks, "rit", strict=True)]
    return docs.join(keys, same[0] & same[1] & same[2], "left_semi")


def _plain(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema.fields if not has_map(f.dataType)]
