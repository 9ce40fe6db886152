"""Reversible line dedup: sharded cuckoo filters over an exact table of references.

A line's key is the line without white space at its ends and in lower case. The
index holds, for every key, which documents hold it:

* ``refs``: the exact reference counts, rows ``(hi, lo, doc_id, n)`` of a 128-bit
  key digest, appended by each insertion (``n`` lines) and deletion (``-n``).
* ``filters``: for each shard of the digests, cuckoo filters with as many copies
  of a key as it has documents, two at most.

``insert`` and ``delete`` change both; a version counts once its commit row is
written, so a broken job leaves the former version. ``dedup`` asks the filters
which keys of a batch may be in two documents, resolves those, and only those,
in the exact table, and drops their lines except in the smallest document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import ascii_lower, col, fresh, shared_folder
from folio.llm.cuckoo import Chain
from folio.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _digest(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(1), key).alias("lo")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineIndex:
    """A line index in a shared folder; every method returns or leaves committed versions only."""

    def __init__(self, spark: SparkSession, folder: str, shards: int, versions: tuple[int, ...] = (),
                 min_chars: int = MIN_CHARS):
        self.spark, self.folder, self.shards, self.versions, self.min_chars = spark, folder, shards, versions, min_chars

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None, shards: int | None = None,
               min_chars: int = MIN_CHARS) -> LineIndex:
        """An empty index. ``shards``: so many that one shard's distinct keys fit a task (default:
        the number of shuffle partitions)."""
        shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark, folder or shared_folder(spark, "lines"), shards, (), min_chars)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        rows = spark.read.parquet(f"{folder}/commits").collect()
        return cls(spark, folder, rows[0].shards, tuple(sorted(r.version for r in rows)), rows[0].min_chars)

    # -- the exact table

    def _keys(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(hi, lo, doc_id, n) of the lines that are long enough."""
        lines = docs.select(col(docs, id_col).alias("doc_id"), F.explode(_lines(col(docs, text_col))).alias("line"))
        keyed = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.length("key") >= self.min_chars)
        return keyed.select("doc_id", *_digest(F.col("key"))).groupBy("hi", "lo", "doc_id").agg(
            F.count(F.lit(1)).alias("n"))

    def refs(self) -> DataFrame:
        """The references that hold now: (hi, lo, doc_id, n)."""
        if not self.versions:
            return self.spark.createDataFrame([], "hi bigint, lo bigint, doc_id bigint, n bigint")
        parts = self.spark.read.parquet(*[f"{self.folder}/refs/{v}" for v in self.versions])
        if len(self.versions) == 1:
            return parts
        return parts.groupBy("hi", "lo", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")

    def _shard(self) -> Column:
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")

    def _filters(self) -> DataFrame:
        if not self.versions:
            return self.spark.createDataFrame([], "shard int, link int, slots binary")
        return self.spark.read.parquet(f"{self.folder}/filters/{self.versions[-1]}")

    # -- changes

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents. Rows that share an id are one document; a null id is one more document."""
        return self._commit(self._keys(docs, id_col, text_col))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take the documents with these ids out again, as if they had never been put in."""
        gone = ids.select(col(ids, id_col).alias("gone")).distinct()
        refs = self.refs()
        refs = refs.join(gone, refs.doc_id.eqNullSafe(gone.gone), "left_semi")
        return self._commit(refs.select("hi", "lo", "doc_id", (-F.col("n")).alias("n")))

    def _commit(self, change: DataFrame) -> LineIndex:
        v = (self.versions[-1] if self.versions else 0) + 1
        before = self.refs()
        change.write.mode("overwrite").parquet(f"{self.folder}/refs/{v}")
        after = LineIndex(self.spark, self.folder, self.shards, (*self.versions, v), self.min_chars)
        touched = self.spark.read.parquet(f"{self.folder}/refs/{v}")
        touched = touched if not self.versions else touched.select("hi", "lo").distinct()
        held = lambda refs: refs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"))
        if self.versions:
            old = held(before.join(touched, ["hi", "lo"], "left_semi")).withColumnRenamed("docs", "was")
            new = held(after.refs().join(touched, ["hi", "lo"], "left_semi"))
            delta = touched.join(old, ["hi", "lo"], "left").join(new, ["hi", "lo"], "left")
        else:
            delta = held(touched).withColumn("was", F.lit(0))
        step = F.least(F.coalesce("docs", F.lit(0)), F.lit(2)) - F.least(F.coalesce("was", F.lit(0)), F.lit(2))
        delta = delta.select(self._shard(), "hi", "lo", step.cast("int").alias("step"))
        delta.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInPandas(
            _update, "shard int, link int, slots binary").write.mode("overwrite").parquet(f"{self.folder}/filters/{v}")
        self.spark.createDataFrame([(v, self.shards, self.min_chars)], "version int, shards int, min_chars int") \
            .coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return after

    # -- decisions

    def repeated(self, keys: DataFrame) -> DataFrame:
        """Of ``(hi, lo)`` keys those in at least two documents, with their smallest document:
        the filters screen, the exact table decides."""
        asked = keys.select(self._shard(), "hi", "lo").distinct()
        maybe = asked.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInPandas(
            _screen, "hi bigint, lo bigint")
        held = self.refs().join(maybe, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(
            F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("owner"))
        return held.where("docs >= 2").select("hi", "lo", "owner")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              counts: tuple[str, str] | None = None, indexed: bool = False) -> DataFrame:
        """``docs`` without the lines that a smaller document of the index holds too.

        All columns stay; ``text_col`` holds the lines left, joined by a newline
        (a text that loses nothing is as before, null included). ``counts``:
        names of two more columns, the number of lines before and of those dropped
        (a null or empty text is one empty line). Rows that share an id are one
        document. A null id is larger than any other. ``indexed``: all rows of ``docs``
        are documents of the index with just these texts; their keys are then read
        from it and not cut from the texts again.
        """
        if indexed:
            ids = docs.select(col(docs, id_col).alias("asked")).distinct()
            refs = self.refs()
            keys = refs.join(ids, refs.doc_id.eqNullSafe(ids.asked), "left_semi")
        else:
            keys = cut_lineage(self._keys(docs, id_col, text_col))  # both the filters and the join below read it
        owned = self.repeated(keys)
        lost = keys.join(owned, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("owner"))) \
            .groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))
        gone_id, gone, kept, keyed, digest = fresh(docs, "gone_id", "gone", "kept", "keyed", "digest")
        lost = lost.select(F.col("doc_id").alias(gone_id), F.col("lost").alias(gone))
        both = docs.join(lost, col(docs, id_col).eqNullSafe(lost[gone_id]), "left")
        text = col(both, text_col)
        lines = _lines(text)
        # Columns of their own, as an array function is evaluated anew for every use.
        both = both.withColumn(keyed, F.when(col(both, gone).isNotNull(), F.transform(lines, line_key)))
        both = both.withColumn(digest, F.transform(col(both, keyed), lambda x: F.struct(
            *_digest(x), (F.length(x) >= self.min_chars).alias("long_enough"))))
        key = col(both, digest)
        left = both.withColumn(kept, _without(F.when(col(both, gone).isNotNull(), lines), key["hi"], key["lo"],
                                              key["long_enough"], col(both, gone)["hi"], col(both, gone)["lo"]))
        n = F.size(_lines(col(left, text_col))).cast("bigint")
        n_lost = F.coalesce(n - F.size(col(left, kept)), F.lit(0)).cast("bigint")
        out = [F.when(n_lost == 0, col(left, c)).otherwise(F.array_join(col(left, kept), "\n")).alias(c)
               if c == text_col else col(left, c) for c in docs.columns]
        if counts:
            out += [n.alias(counts[0]), n_lost.alias(counts[1])]
        return left.select(*out)


def _chain(filters: pd.DataFrame) -> Chain:
    return Chain(filters.sort_values("link")["slots"].tolist() if len(filters) else [])


def _update(key: tuple, delta: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    chain = _chain(filters)
    hi, lo = delta["hi"].to_numpy(np.int64), delta["lo"].to_numpy(np.int64)
    step = delta["step"].to_numpy(np.int64)
    for times in (1, 2):
        gone = step <= -times
        chain.take(hi[gone], lo[gone])
    for times in (1, 2):
        more = step >= times
        chain.put(hi[more], lo[more])
    blobs = chain.blobs()
    return pd.DataFrame({"shard": np.full(len(blobs), key[0], np.int32),
                         "link": np.arange(len(blobs), dtype=np.int32), "slots": blobs})


def _screen(key: tuple, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hi, lo = asked["hi"].to_numpy(np.int64), asked["lo"].to_numpy(np.int64)
    return asked.loc[_chain(filters).copies(hi, lo) >= 2, ["hi", "lo"]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _without(lines: pd.Series, hi: pd.Series, lo: pd.Series, long_enough: pd.Series,
             gone_hi: pd.Series, gone_lo: pd.Series) -> pd.Series:
    out = []
    for text, a, b, ok, x, y in zip(lines, hi, lo, long_enough, gone_hi, gone_lo, strict=True):
        if text is None:
            out.append(None)
            continue
        gone = set(zip(x.tolist(), y.tolist(), strict=True))
        out.append([t for t, p, q, k in zip(text, a.tolist(), b.tolist(), ok, strict=True) if not (k and (p, q) in gone)])
    return pd.Series(out, dtype=object)
