"""Nearest neighbours through an inverted file of product codes (V6).

Cells are k-means centres of a bounded sample; every row belongs to its nearest cell and is
stored as a code of its residual: one byte a pair of dimensions, the nearest of up to
256 sub-vectors. A query scans the codes of the cells nearest to it, a table look-up a byte,
keeps the best ``rerank`` rows and ranks these exactly by cosine in double precision.

How many cells are probed is not guessed: the neighbours that an exact search finds for a
bounded set of sample rows tell in which of a query's cells they lie, and the least
number of cells that holds ``target`` of them is taken.

On Spark: the model (centres and sub-vectors, bounded by the sample) goes to tasks with the
function; rows are encoded in one pass and packed into blocks of a cell, so a query block
meets a code block as one row of a join on the cell, and never one row a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.vectors import _top, dot, knn_exact, norm
from folio.session import bounded_broadcast, cut_lineage

#: Rows that the cells and sub-vectors are fitted on, at most; every row is indexed.
SAMPLE = 20_000
#: Sample rows that the number of probes is measured with.
MEASURED = 64
#: Codes in a block and queries in a block: a scored pair of blocks is at most 16 MB.
CODES, QUERIES = 4096, 512


@dataclass
class Ivf:
    """``blocks``: ``(cell, ids, codes)``, written; ``centres`` (cells x d), ``parts`` (d / 2 x 256 x 2), ``probes`` cells a query."""

    blocks: DataFrame
    centres: np.ndarray
    parts: np.ndarray
    probes: int


def unit(vectors) -> np.ndarray:
    m = np.asarray(list(vectors), dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def kmeans(rows: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """``k`` centres of ``rows`` (fewer, if there are fewer rows); an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(turns):
        near = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        for c in np.flatnonzero(counts == 0):
            centres[c] = rows[np.argmax(((rows - centres[near]) ** 2).sum(1))]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([np.argmax(rows[i:i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)])


def _fit(sample: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    centres = kmeans(sample, cells, seed)
    rest = sample - centres[_nearest(sample, centres)]
    if rest.shape[1] % 2:
        rest = np.pad(rest, ((0, 0), (0, 1)))
    pairs = rest.reshape(len(rest), -1, 2)
    parts = np.zeros((pairs.shape[1], 256, 2))
    for j in range(pairs.shape[1]):
        found = kmeans(pairs[:, j], 256, seed + j)
        parts[j] = found[np.arange(256) % len(found)]
    return centres, parts


def _encode(vectors: np.ndarray, centres: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = _nearest(vectors, centres)
    rest = vectors - centres[cell]
    rest = np.pad(rest, ((0, 0), (0, 2 * len(parts) - rest.shape[1])))
    codes = np.stack([_nearest(rest[:, 2 * j:2 * j + 2], parts[j]) for j in range(len(parts))], axis=1)
    return cell, codes.astype(np.uint8)


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))


def build(corpus: DataFrame, k: int = 10, target: float = 0.97, cells: int | None = None, seed: int = 7) -> Ivf:
    """The index of ``corpus(id, embedding)``; rows without an id or a vector are left out.

    ``cells``: by default the square root of the sample's rows. At most ``SAMPLE`` rows, the least by a hash of the id, are collected to fit the model."""
    rows = _rows(corpus, "id", "embedding")
    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).toPandas()  # bounded by SAMPLE
    if not len(chosen):
        empty = corpus.sparkSession.createDataFrame([], "cell int, ids binary, codes binary")
        return Ivf(empty, np.zeros((0, 0)), np.zeros((0, 256, 2)), 0)
    sample = unit(chosen["v"])
    centres, parts = _fit(sample, cells or max(1, int(len(sample) ** 0.5)), seed)

    def encode(frames):
        for pdf in frames:
            if len(pdf):
                cell, codes = _encode(unit(pdf["v"]), centres, parts)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": pdf["id"].to_numpy(np.int64), "code": [c.tobytes() for c in codes]})

    def pack(frames):
        for pdf in frames:  # sorted by cell
            for cell, part in pdf.groupby("cell", sort=False):
                for i in range(0, len(part), CODES):
                    p = part.iloc[i:i + CODES]
                    yield pd.DataFrame({"cell": [np.int32(cell)], "ids": [p["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(p["code"])]})

    coded = rows.mapInPandas(encode, "cell int, id bigint, code binary")
    # By range of (cell, id): a cell with a large share of all rows is dealt to many tasks.
    blocks = cut_lineage(cut_lineage(coded).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
                         .mapInPandas(pack, "cell int, ids binary, codes binary"))
    return Ivf(blocks, centres, parts, _probes(corpus, chosen.iloc[:MEASURED], centres, k, target))


def _probes(corpus: DataFrame, asked: pd.DataFrame, centres: np.ndarray, k: int, target: float) -> int:
    """The least number of cells that holds ``target`` of the ``k`` nearest rows of the sample's queries."""
    queries = corpus.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(asked["id"], asked["v"], strict=True)],
                                                  "query_id bigint, query array<double>")
    near = knn_exact(queries, corpus, k).select("query_id", "id").join(_rows(corpus, "id", "embedding"), "id").toPandas()  # MEASURED x k rows
    order = {int(i): np.argsort(-q @ centres.T, kind="stable") for i, q in zip(asked["id"], unit(asked["v"]), strict=True)}
    cells = _nearest(unit(near["v"]), centres)
    ranks = np.sort([int(np.flatnonzero(order[q] == c)[0]) for q, c in zip(near["query_id"].tolist(), cells, strict=True)])
    return int(ranks[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1


def search(index: Ivf, queries: DataFrame, corpus: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
    """``(query_id, id, similarity, rk, candidates, scanned)`` for ``queries(query_id, query)``: the columns of ``knn_exact``,
    the rows ranked exactly and the rows whose codes were looked up. ``rerank`` is twice ``k`` by default; a
    probe has all rows of its cells, so only a query whose cells hold fewer than ``k`` rows gets fewer."""
    centres, parts, probes, rerank = index.centres, index.parts, index.probes, rerank or 2 * k

    def ask(frames):
        for pdf in frames:
            if not len(pdf) or not probes:
                continue
            q, ids = unit(pdf["v"]), pdf["id"].to_numpy(np.int64)
            cells = np.argsort(-q @ centres.T, axis=1, kind="stable")[:, :probes]
            for c in np.unique(cells):
                at = np.flatnonzero((cells == c).any(axis=1))
                for i in range(0, len(at), QUERIES):
                    yield pd.DataFrame({"cell": [np.int32(c)], "q_ids": [ids[at[i:i + QUERIES]].tobytes()], "q": [q[at[i:i + QUERIES]].tobytes()]})

    def scan(frames):
        for pdf in frames:
            for cell, ids, codes, q_ids, q in pdf[["cell", "ids", "codes", "q_ids", "q"]].itertuples(index=False, name=None):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                codes, q = np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(q).reshape(len(q_ids), -1)
                base = q @ centres[cell]
                pairs = np.pad(q, ((0, 0), (0, 2 * len(parts) - q.shape[1]))).reshape(len(q), -1, 2)
                tables = np.einsum("qjd,jcd->jqc", pairs, parts)
                sims = np.repeat(base[:, None], len(ids), axis=1)
                for j in range(len(parts)):
                    sims += tables[j][:, codes[:, j]]
                best = np.argsort(-sims, axis=1, kind="stable")[:, :rerank]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, best.shape[1]), "id": ids[best].ravel(),
                                    "near": np.take_along_axis(sims, best, 1).ravel(),
                                    "seen": np.where(np.arange(best.size) % best.shape[1] == 0, len(ids), 0)})

    asked = _rows(queries, "query_id", "query")
    met = index.blocks.join(asked.mapInPandas(ask, "cell int, q_ids binary, q binary"), "cell")
    found = met.mapInPandas(scan, "query_id bigint, id bigint, near double, seen bigint")
    by = Window.partitionBy("query_id")
    found = found.withColumn("scanned", F.sum("seen").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("near"), "id")))
    found = cut_lineage(found.where(F.col("place") <= rerank).select("query_id", "id", "scanned"))
    vectors = _rows(corpus, "id", "embedding").join(bounded_broadcast(found.select("id").distinct()), "id", "left_semi")
    ranked = found.join(vectors, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("query")), "query_id")
    near = F.coalesce(dot(F.col("v"), F.col("query")) / F.nullif(norm(F.col("v")) * norm(F.col("query")), F.lit(0.0)), F.lit(0.0))
    ranked = ranked.select("query_id", "id", "scanned", near.alias("similarity"), F.count(F.lit(1)).over(by).alias("candidates"))
    return _top(ranked, k).select("query_id", "id", "similarity", "rk", "candidates", "scanned")
