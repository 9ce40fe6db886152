"""Interpolated modified Kneser-Ney language model (word bigrams), counted in Spark.

Training makes two passes over the corpus. Workers count the words of a
partition, then its word pairs, and Spark shuffles the counts to shards as sorted,
packed arrays; a shard's task merges them and writes the model's files to
the shared folder:

* ``word.S``: sorted 64-bit hashes of the words of shard S (shards are ranges of the
  hash, so a word's id is its place in all of them), ``count.S`` their counts;
* ``pair.S``: sorted keys (id of the first word << 32 | id of the second) whose own hash
  falls in shard S - a frequent word is spread over all shards - and ``times.S`` their counts;
* ``left.S``, ``right.S``: for a range of ids, what the word has as a context (tokens after it, kinds of
  pairs seen once, twice, more often) and how many kinds of words it follows.

Workers map the files into memory and look words and pairs up by binary search.
A task that is run again writes the same bytes under the same names.

    P(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + lambda(u) P(w),
    P(w) = max(k(w) - D'(k(w)), 0) / K + lambda' / (V + 1),

with k(w) the number of words that w follows, K their sum, and three discounts each from
the counts of counts. An unknown word has the last term alone, an unknown context leaves P(w).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import col, mounted, shared_folder, write_file

#: The end of a text: a token that no word is equal to, as words hold no newline.
END = b"\n"
#: Words a worker remembers, and counts that it gathers before it hands them on.
CACHE_WORDS = 500_000
HOLD = 4_000_000
TOKENS_AT_ONCE = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words (A-Z in lower case, parted by ASCII white space), then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _range(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit hash: ``shards`` equal ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _spread(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair key: by a hash of both words."""
    x = (keys ^ (keys >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return _range(x ^ (x >> np.uint64(32)), shards)


def _planes(a: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane: the shuffle's compression then drops the empty ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
    """Sorted keys with counts -> a row for each shard: deltas of the keys, and the counts."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cut = np.flatnonzero(np.diff(shard)) + 1
    parts = [(int(s[0]), _planes(np.diff(k, prepend=np.uint64(0))), _planes(n.astype(np.uint64)))
             for k, n, s in zip(np.split(keys, cut), np.split(counts, cut), np.split(shard, cut), strict=True) if len(s)]
    return pd.DataFrame(parts, columns=["shard", "keys", "counts"])


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(_unplanes(k, "u8"), dtype=np.uint64) for k in rows["keys"]])
    return _added(keys, np.concatenate([_unplanes(n, "u8") for n in rows["counts"]]))


class _Counter:
    """Counts keys, and hands packed rows on whenever it holds many."""

    def __init__(self, shard_of, shards: int):
        self.shard_of, self.shards, self.parts, self.held = shard_of, shards, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > HOLD:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            keys, counts = _added(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))
            self.parts, self.held = [], 0
            yield _packed(keys, counts, self.shard_of(keys, self.shards))


def _parts(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    """The tokens of each text, for about TOKENS_AT_ONCE tokens at a time."""
    held, n = [], 0
    for t in texts:
        held.append(tokens(t))
        n += len(held[-1])
        if n >= TOKENS_AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[list[list[bytes]]]:
    for frame in frames:
        yield from _parts(frame["text"])


@dataclass
class Model:
    """Where a trained model lies and its few totals; small, and shipped to workers as it is."""

    folder: str
    shards: int
    offsets: list[int] = field(default_factory=list)  # id of the first word of each shard, then their number
    tokens: int = 0
    width: int = 1  # ids in a range of left and right
    pairs: int = 0
    discounts: list[float] = field(default_factory=list)  # of pairs, for counts of 1, 2, more
    base_discounts: list[float] = field(default_factory=list)
    base_rest: float = 1.0  # lambda'

    @property
    def words(self) -> int:
        return self.offsets[-1]


class _Files:
    """Arrays of a model, mapped when first used."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def array(self, name: str, shard: int, kind: str, columns: int = 1) -> np.ndarray:
        if (name, shard) not in self.open:
            path = f"{self.model.folder}/{name}.{shard}"
            there = os.path.exists(path) and os.path.getsize(path)
            a = np.memmap(path, kind, "r") if there else np.zeros(0, kind)
            self.open[name, shard] = a.reshape(-1, columns) if columns > 1 else a
        return self.open[name, shard]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield int(shard[part[0]]), part


class Lookup:
    """Ids, counts and probabilities of a model, for arrays of many tokens."""

    def __init__(self, model: Model):
        self.model, self.files, self.known = model, _Files(model), {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, -1 if the model does not know it."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set(words) - self.known.keys())
        if new:
            keys = np.fromiter(map(_hash, new), np.uint64, len(new))
            out = np.full(len(new), -1, np.int64)
            for s, part in _by_shard(_range(keys, self.model.shards)):
                table = self.files.array("word", s, "u8")
                if len(table):
                    at = np.minimum(np.searchsorted(table, keys[part]), len(table) - 1)
                    there = table[at] == keys[part]
                    out[part[there]] = self.model.offsets[s] + at[there]
            self.known.update(zip(new, out.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """How often each word was seen; 0 for the id -1."""
        out, offsets = np.zeros(len(ids), np.int64), np.array(self.model.offsets)
        shard = np.searchsorted(offsets, ids, side="right") - 1
        for s, part in _by_shard(np.where(ids < 0, -1, shard)):
            if s >= 0:
                out[part] = self.files.array("count", s, "u8")[ids[part] - offsets[s]]
        return out

    def times(self, keys: np.ndarray) -> np.ndarray:
        """How often each pair was seen. The keys must be sorted and distinct."""
        out = np.zeros(len(keys), np.int64)
        for s, part in _by_shard(_spread(keys, self.model.shards)):
            table = self.files.array("pair", s, "u8")
            if len(table):
                at = np.minimum(np.searchsorted(table, keys[part]), len(table) - 1)
                there = table[at] == keys[part]
                out[part[there]] = self.files.array("times", s, "u8")[at[there]]
        return out

    def _dense(self, name: str, ids: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((len(ids), columns), np.float64)
        for s, part in _by_shard(np.where(ids < 0, -1, ids // self.model.width)):
            table = self.files.array(name, s, "u8", columns).reshape(-1, columns) if s >= 0 else ()
            if len(table):  # a range of which nothing was counted has no file
                out[part] = table[ids[part] - s * self.model.width]
        return out

    def base(self, ids: np.ndarray) -> np.ndarray:
        """P(w) of each word; the id -1 is unknown."""
        m = self.model
        k = self._dense("right", ids, 1)[:, 0]
        return np.maximum(k - _discount(k, m.base_discounts), 0) / max(m.pairs, 1) + m.base_rest / (m.words + 1)

    def probability(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """P(w | u) for arrays of ids; the start of a text is the id ``model.words``."""
        m = self.model
        p = self.base(ids)
        ctx = self._dense("left", before, 4)
        seen = ctx[:, 0] > 0
        rest = ctx[:, 1:] @ np.array(m.discounts)
        both = (before >= 0) & (ids >= 0)
        keys, at = np.unique(before[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64), return_inverse=True)
        c = np.zeros(len(ids))
        c[both] = self.times(keys)[at]
        total = np.maximum(ctx[:, 0], 1)
        return np.where(seen, np.maximum(c - _discount(c, m.discounts), 0) / total + rest / total * p, p)


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of things seen 1, 2, 3 and 4 times; where a corpus is too
    small to tell, half of 1, 2 and 3."""
    plain = [0.5, 1.0, 1.5]
    if not all(n[:4]):
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return d if all(0 <= x <= k + 1 for k, x in enumerate(d)) else plain


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None, shards: int | None = None) -> Model:
    """Train on all rows of ``docs`` (a null text is empty) and write the model to ``folder``.

    The folder (default: a new one in the shared folder) must be mounted by all
    workers. ``shards``: so many that one shard's arrays fit a task (default: the
    number of shuffle partitions). Without rows the model knows nothing and
    gives every token the same probability. Fewer than 2^32 distinct words.
    """
    spark = docs.sparkSession
    folder = mounted(folder or shared_folder(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(folder, shards)
    texts = docs.select(col(docs, text_col).alias("text"))
    packed = "shard int, keys binary, counts binary"

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = _Counter(_range, shards), {}
        for docs_ in _texts(frames):
            words = [w for d in docs_ for w in d]
            if len(known) > CACHE_WORDS:
                known.clear()
            known.update((w, _hash(w)) for w in set(words) - known.keys())
            yield from held.add(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        yield from held.flush()

    def write_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        write_file(f"{folder}/word.{key[0]}", keys.tobytes())
        write_file(f"{folder}/count.{key[0]}", counts.tobytes())
        return pd.DataFrame({"shard": [key[0]], "words": [len(keys)], "tokens": [int(counts.sum())]})

    sizes = {r["shard"]: r for r in texts.mapInPandas(count_words, packed).groupBy("shard").applyInPandas(
        write_words, "shard int, words bigint, tokens bigint").collect()}  # a row a shard
    model.offsets = [0, *np.cumsum([sizes[s]["words"] if s in sizes else 0 for s in range(shards)]).tolist()]
    model.tokens = sum(r["tokens"] for r in sizes.values())
    model.width = max(1, -(-(model.words + 1) // shards))
    if model.words >= (1 << 32) - 1:
        raise ValueError("more than 2^32 distinct words")

    def count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, look = _Counter(_spread, shards), Lookup(model)
        for docs_ in _texts(frames):
            ids, before = _sequence(look, docs_)
            yield from held.add(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
        yield from held.flush()

    def write_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, times = _merged(rows)
        write_file(f"{folder}/pair.{key[0]}", keys.tobytes())
        write_file(f"{folder}/times.{key[0]}", times.tobytes())
        u, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lefts, at = np.unique(u, return_inverse=True)
        left = np.stack([np.bincount(at, x, len(lefts)) for x in (times, times == 1, times == 2, times >= 3)], 1)
        rights, k = np.unique(w, return_counts=True)
        out = [*_ranges(0, lefts, left), *_ranges(1, rights, k[:, None])]
        exact = [int((times == n).sum()) for n in (1, 2, 3, 4)]
        out.append((2, -1, np.zeros(0, "u8").tobytes(), np.array(exact, "u8").tobytes()))
        return pd.DataFrame(out, columns=["kind", "part", "ids", "vals"])

    def _ranges(kind: int, ids: np.ndarray, vals: np.ndarray) -> Iterator[tuple]:
        for s, part in _by_shard(ids // model.width):
            yield kind, s, _planes(np.diff(ids[part], prepend=0).astype("u8")), _planes(
                np.ascontiguousarray(vals[part]).astype("u8").reshape(-1))

    def write_ranges(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The dense arrays of a range of ids; the counts of counts of what it holds (kind 1) or was handed (2)."""
        kind, part = key
        if kind == 2:
            exact = sum(np.frombuffer(v, "u8") for v in rows["vals"])
        else:
            columns = 4 if kind == 0 else 1
            dense = np.zeros((model.width, columns), "u8")
            for b, v in zip(rows["ids"], rows["vals"], strict=True):
                ids = np.cumsum(_unplanes(b, "u8"), dtype=np.uint64).astype(np.int64) - part * model.width
                dense[ids] += _unplanes(v, "u8").reshape(-1, columns)
            write_file(f"{folder}/{'left' if kind == 0 else 'right'}.{part}", dense.tobytes())
            exact = [int((dense == n).sum()) if kind == 1 else 0 for n in (1, 2, 3, 4)]
        more, total = (int((dense >= 3).sum()), int(dense.sum())) if kind == 1 else (0, 0)
        return pd.DataFrame([(kind, *map(int, exact), more, total)], columns=["kind", "n1", "n2", "n3", "n4", "more", "total"])

    found = texts.mapInPandas(count_pairs, packed).groupBy("shard").applyInPandas(
        write_pairs, "kind int, part int, ids binary, vals binary").groupBy("kind", "part").applyInPandas(
        write_ranges, "kind int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint, total bigint")
    sums = {r["kind"]: r for r in found.groupBy("kind").agg(
        *[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")]).collect()}
    counts = lambda k: [sums[k][f"n{n}"] if k in sums else 0 for n in (1, 2, 3, 4)]
    model.discounts, model.base_discounts = discounts(counts(2)), discounts(counts(1))
    if 1 in sums:
        r, d = sums[1], model.base_discounts
        model.pairs = r["total"]
        model.base_rest = (d[0] * r["n1"] + d[1] * r["n2"] + d[2] * r["more"]) / r["total"]
    return model


def _sequence(look: Lookup, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the tokens of some texts, and of what stands before each."""
    ids = look.ids([w for d in docs for w in d])
    before = np.roll(ids, 1)
    before[np.cumsum([0, *map(len, docs[:-1])])] = look.model.words
    return ids, before


def score_column(text: Column, model: Model) -> Column:
    """Struct ``(n_tokens, n_known, base_score, score)`` of a text."""
    @F.pandas_udf("n_tokens bigint, n_known bigint, base_score double, score double")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        look = Lookup(model)
        floor = np.log10(model.tokens + 0.5 * (model.words + 1))
        for texts in series:
            parts = []
            for docs in _parts(texts):
                ids, before = _sequence(look, docs)
                seen, p = look.counts(ids), look.probability(before, ids)
                sizes = np.fromiter(map(len, docs), np.int64, len(docs))
                first = np.cumsum(sizes) - sizes
                parts.append((sizes, np.add.reduceat((seen > 0).astype(np.int64), first),
                              np.add.reduceat(np.log10(seen + 0.5) - floor, first), np.add.reduceat(np.log10(p), first)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 4
            yield pd.DataFrame(dict(zip(("n_tokens", "n_known", "base_score", "score"), columns, strict=True)))

    return of(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``(doc_id, n_tokens, n_known, base_score, score, perplexity)``.

    ``score``: log10 probability of the text, its end included; ``base_score``: that of a
    unigram model with 0.5 added to each count. A null text is empty (one token, the
    end); repeated rows and null ids each give a row. Further columns are not read.
    """
    rows = docs.select(col(docs, id_col).alias("doc_id"), score_column(col(docs, text_col), model).alias("s"))
    return rows.select("doc_id", "s.*", F.pow(F.lit(10.0), -F.col("s.score") / F.col("s.n_tokens")).alias("perplexity"))
