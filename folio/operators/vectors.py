"""Document vectors.

Exact nearest neighbours score blocks of the corpus against blocks of the
queries, one matrix product a pair, and keep a top-k of each task. Cosine is computed
in double precision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.session import cut_lineage


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def attach(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """V2: documents with their vector (null when none has been computed)."""
    return docs.join(vectors.select("id", "embedding"), "id", "left")


def backlog(docs_with_vectors: DataFrame, packages: DataFrame, min_downloads: float,
            always: list[str], batch: int = 100) -> DataFrame:
    """The next ``batch`` documents (by id) that still need a vector: no
    vector yet, body not ``'##'``, package above ``min_downloads`` or listed."""
    p = packages.where((F.col("recent_downloads") > min_downloads) | F.col("name").isin(always)) \
        .select(F.col("name").alias("package"))
    todo = (docs_with_vectors.where(F.col("embedding").isNull() & (F.col("doc") != "##"))
            .join(p, "package", "left_semi").select("id", "doc"))
    return todo.orderBy("id").limit(batch)


def embedding_count(docs_with_vectors: DataFrame) -> DataFrame:
    """V3/K2: number of documents with a vector."""
    return docs_with_vectors.agg(F.count("embedding").alias("n_embeddings"))


def embedding_scan(docs_with_vectors: DataFrame) -> DataFrame:
    """V4: ids and vectors where present."""
    return docs_with_vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per ``key`` (query vectors derived from the data)."""
    ex = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    per_dim = ex.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (per_dim.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
            .select(F.col(key).alias("query_id"), F.transform("s", lambda s: s["x"]).alias("query")))


#: Rows in a block of the corpus and of the queries, and queries scored at once: 8 MB, and as much again for each array that sorts them.
CORPUS_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 4096, 2048, 256
#: Query blocks that are broadcast at once, about: some 50 MB for vectors of 64 numbers.
BLOCKS_AT_ONCE = 32


def _blocks(df: DataFrame, id_col: str, vec_col: str, size: int, prefix: str, keys=None) -> DataFrame:
    """Rows packed to blocks of at most ``size``: ``(<prefix>_ids, <prefix>_unit)``, ids and unit vectors as
    one binary each (zero vectors stay zero); with ``keys``, of a matrix of vectors, ``<prefix>_keys`` too."""
    import numpy as np
    import pandas as pd

    def pack(frames):
        for pdf in frames:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i:i + size]
                m = np.asarray(part["v"].tolist(), dtype=np.float64).reshape(len(part), -1)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                more = {f"{prefix}_keys": [keys(m).tobytes()]} if keys else {}
                yield pd.DataFrame({f"{prefix}_ids": [part["id"].to_numpy(np.int64).tobytes()],
                                    f"{prefix}_unit": [(m / np.where(n == 0, 1, n)).tobytes()]} | more)

    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInPandas(pack, f"{prefix}_ids binary, {prefix}_unit binary" + (f", {prefix}_keys binary" if keys else ""))


#: Stands for a similarity that is no number: after all others.
NO_NUMBER = -2.0


class Best:
    """The ``k`` best of each of ``n`` queries among the rows a task has seen so far: by similarity, ties by id."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.similarity, self.ids, self.seen = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def add(self, first: int, asked, rows, ids, met=None) -> None:
        """Rows with their ``ids`` against ``asked``, the queries from ``first`` on; with ``met``, the pairs that count."""
        import numpy as np

        k = self.ids.shape[1]
        some = slice(first, first + len(asked))
        sims = asked @ rows.T
        if not np.isfinite(sims.sum()):
            sims[np.isnan(sims)] = NO_NUMBER
        if met is not None:
            sims[~met] = -np.inf
            self.seen[some] += met.sum(1)
        low = self.similarity[some, -1]
        if len(ids) > k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(sims, -k, axis=1)[:, -k])
        # A product of matrices may round equal vectors apart, so what comes near the last place is computed alone.
        q, r = np.nonzero((sims >= low[:, None] - 1e-9) & (sims > -np.inf))
        exact = np.einsum("ij,ij->i", asked[q], rows[r])
        exact[np.isnan(exact)] = NO_NUMBER
        held_q, held_at = np.nonzero(self.similarity[some] > -np.inf)
        q = np.concatenate([q, held_q])
        found = np.concatenate([ids[r], self.ids[some][held_q, held_at]])
        exact = np.concatenate([exact, self.similarity[some][held_q, held_at]])
        order = np.lexsort((found, -exact, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        self.similarity[first + q[kept], place[kept]] = exact[order][kept]
        self.ids[first + q[kept], place[kept]] = found[order][kept]

    def rows(self, query_ids):
        import numpy as np
        import pandas as pd

        q, at = np.nonzero(self.similarity > -np.inf)
        s = self.similarity[q, at]
        return pd.DataFrame({"query_id": query_ids[q], "id": self.ids[q, at], "similarity": np.where(s == NO_NUMBER, np.nan, s)})


def _pairs_of_blocks(rows: DataFrame, asked: DataFrame, score, schema: str) -> list[DataFrame]:
    """``score`` over every block of ``rows`` with every block of ``asked``, whose blocks are broadcast in parts of a counted size."""
    asked = cut_lineage(asked).withColumn("q_no", F.monotonically_increasing_id())
    parts = -(-asked.count() // BLOCKS_AT_ONCE)
    if parts > 1:
        rows = cut_lineage(rows)
    found = []
    for p in range(max(1, parts)):
        part = asked.where(F.pmod(F.xxhash64("q_ids"), F.lit(parts)) == p) if parts > 1 else asked
        # Blocks of the query set, counted above, against blocks of rows.
        found.append(rows.crossJoin(F.broadcast(part)).mapInPandas(score, schema))
    return found


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k) \
        .withColumn("rk", F.col("rk").cast("bigint"))


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """V5: ``(query_id, id, similarity, rk)`` for the ``k`` most cosine-similar rows of
    ``corpus(id, embedding)`` to each ``queries(query_id, query)``; similarity =
    1 - cosine distance, nearest first, ties by id. Rows without a vector are left out.

    Corpus and queries are packed to blocks, the query blocks are broadcast in parts of a counted size, and every pair of blocks is one
    matrix product, a few queries at a time. A task holds one pair at a time and the best ``k`` of each query so far, which it sorts
    nothing but their betters into; any number of queries will do, and the window at the end sees tasks x queries x k rows, never all
    pairs. Neither side is collected.
    """
    import numpy as np

    def score(frames):
        best = {}
        for pdf in frames:
            for c_ids, c, no, q_ids, q in zip(pdf["c_ids"], pdf["c_unit"], pdf["q_no"], pdf["q_ids"], pdf["q_unit"], strict=True):
                ids, qids = np.frombuffer(c_ids, np.int64), np.frombuffer(q_ids, np.int64)
                rows, asked = np.frombuffer(c).reshape(len(ids), -1), np.frombuffer(q).reshape(len(qids), -1)
                mine = best.setdefault(no, (qids.copy(), Best(len(qids), k)))[1]
                for i in range(0, len(qids), QUERIES_AT_ONCE):
                    mine.add(i, asked[i:i + QUERIES_AT_ONCE], rows, ids)
        for qids, mine in best.values():
            yield mine.rows(qids)

    found = _pairs_of_blocks(_blocks(corpus, "id", "embedding", CORPUS_BLOCK, "c"), _blocks(queries, "query_id", "query", QUERY_BLOCK, "q"),
                             score, "query_id bigint, id bigint, similarity double")
    return reduce(DataFrame.unionAll, [_top(part, k) for part in found])


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int = 10, bands: int = 24, bits: int = 8,
            seed: int = 7) -> DataFrame:
    """V6: approximate variant by signs of random projections.

    Each vector gets ``bands`` keys of ``bits`` signs; rows that share a key with a query are
    its candidates and are ranked exactly. A query with fewer than ``k`` candidates
    is answered by ``knn_exact``, so every query has its ``k`` rows. Returns the columns
    of ``knn_exact`` and ``candidates``, the number of rows ranked for the query.

    A fixed share of all rows shares a key with a query, so the candidates are never rows of a table: blocks of the corpus meet blocks of
    the queries as in ``knn_exact``, a table a band gives the queries of each key as bits, and only what meets is ranked. Where
    ids repeat, candidates are told by id, as rows (``_lsh_by_id``); keys of over 16 bits too.
    """
    import numpy as np
    import pandas as pd

    def keys(m):
        """The keys of a matrix of vectors, a row a band."""
        planes = np.random.default_rng(seed).normal(size=(m.shape[1], bands * bits))
        return np.ascontiguousarray(((m @ planes > 0).reshape(len(m), bands, bits) @ (1 << np.arange(bits))).T.astype(np.uint16))

    c = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    q = queries.where(F.col("query").isNotNull()).select("query_id", "query")
    unclear = lambda df, name: not df.groupBy(name).count().where(f"count > 1 or {name} is null").isEmpty()
    if bits > 16 or unclear(q, "query_id") or unclear(c, "id"):
        return _lsh_by_id(q, c, corpus, k, bands, bits, seed)

    def score(frames):
        best, one = {}, np.uint64(1)
        for pdf in frames:
            for c_ids, v, c_keys, no, q_ids, w, q_keys in zip(*(pdf[x] for x in ("c_ids", "c_unit", "c_keys", "q_no", "q_ids", "q_unit", "q_keys")), strict=True):
                ids, qids = np.frombuffer(c_ids, np.int64), np.frombuffer(q_ids, np.int64)
                rows, asked = np.frombuffer(v).reshape(len(ids), -1), np.frombuffer(w).reshape(len(qids), -1)
                of_row, of_query = np.frombuffer(c_keys, np.uint16).reshape(bands, -1), np.frombuffer(q_keys, np.uint16).reshape(bands, -1)
                mine = best.setdefault(no, (qids.copy(), Best(len(qids), k)))[1]
                for i in range(0, len(qids), QUERIES_AT_ONCE):
                    n = len(asked[i:i + QUERIES_AT_ONCE])
                    word, bit = np.arange(n) // 64, one << (np.arange(n) % 64).astype(np.uint64)
                    met = np.zeros((len(ids), -(-n // 64)), np.uint64)
                    for band in range(bands):
                        table = np.zeros((1 << bits, met.shape[1]), np.uint64)
                        np.bitwise_or.at(table, (of_query[band, i:i + n], word), bit)
                        met |= table[of_row[band]]
                    pairs = np.unpackbits(met.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n].view(bool)
                    mine.add(i, asked[i:i + n], rows, ids, np.ascontiguousarray(pairs.T))
        for qids, mine in best.values():
            yield mine.rows(qids).assign(seen=0)
            yield pd.DataFrame({"query_id": qids, "id": 0, "similarity": 0.0, "seen": mine.seen})

    parts = _pairs_of_blocks(_blocks(c, "id", "embedding", CORPUS_BLOCK, "c", keys), _blocks(q, "query_id", "query", QUERY_BLOCK, "q", keys),
                             score, "query_id bigint, id bigint, similarity double, seen bigint")
    each = Window.partitionBy("query_id")
    found = [part.withColumn("candidates", F.sum("seen").over(each))
             .withColumn("rk", F.row_number().over(each.orderBy(F.col("seen") > 0, F.desc("similarity"), "id")).cast("bigint"))
             .where((F.col("seen") == 0) & (F.col("rk") <= k) & (F.col("candidates") >= k)) for part in parts]
    # Rows of counts come after a query's own; one without a candidate in a task has none there.
    top = cut_lineage(reduce(DataFrame.unionAll, found).select("query_id", "id", "similarity", "rk", "candidates"))
    return top.unionByName(_rest(q, top, c, corpus, k))


def _rest(q: DataFrame, top: DataFrame, c: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The exact answer of the queries that ``top`` lacks."""
    few = q.join(top.select("query_id"), "query_id", "left_anti")
    return knn_exact(few, corpus, k).join(c.agg(F.count(F.lit(1)).alias("candidates")))


def _lsh_by_id(q: DataFrame, c: DataFrame, corpus: DataFrame, k: int, bands: int, bits: int, seed: int) -> DataFrame:
    """``knn_lsh`` with a row a candidate."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<bigint>", F.PandasUDFType.SCALAR)
    def keys(vectors):
        m = np.asarray(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
        planes = np.random.default_rng(seed).normal(size=(m.shape[1], bands * bits))
        signs = (m @ planes > 0).reshape(len(m), bands, bits)
        key = signs @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
        return pd.Series(list(key))

    met = (c.select("id", F.explode(keys("embedding")).alias("key"))
           .join(q.select("query_id", F.explode(keys("query")).alias("key")), "key").select("query_id", "id").distinct())
    near = dot(F.col("embedding"), F.col("query")) / (norm(F.col("embedding")) * norm(F.col("query")))
    ranked = met.join(c, "id").join(q, "query_id").select("query_id", "id", near.alias("similarity"))
    counts = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    enough = counts.where(F.col("candidates") >= k)
    top = _top(ranked, k).join(enough, "query_id")
    return top.unionByName(_rest(q, enough, c, corpus, k))


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours the approximate search found, per query."""
    hit = exact.join(approx.select("query_id", "id"), ["query_id", "id"], "left_semi") \
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    tot = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return tot.join(hit, "query_id", "left").select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"))
