"""Substring dedup over sliding sentence spans.

A text is cut into sentences: after a stop at the end of a word, at each newline,
and, so that text with few stops has sentences too, after the word of the highest
hash among any ``WINDOW`` consecutive words - a cut that depends on the words around
it alone, and so falls alike in every copy of a passage. No sentence has more than
``WINDOW`` words. In scripts written without blanks each character is a word.

With ``lengthen``, a run starts at every sentence and takes as many as make ``run``
sentences and ``min_words`` words, so short lines and sentences are in runs as well.
In 50 shared words the cuts at most 7 words from either end may differ; of the 36
between, at most 8 come before the first cut, and a run takes at most 24, or 7 more than ``min_words``:
up to ``min_words`` of 21 one run is sure to be whole. Without, runs of exactly ``run`` sentences with fewer words are
left out. Every run is hashed (96 bits). Runs are joined globally; of the places of a repeated run the first (by
document id, then place) stays, and sentences covered by any other are removed.

Texts are cut once. A worker hashes a few megabytes of text together; of the places of a run in them all but the
first are known to go, so a run that a third of all documents hold sends a row a few megabytes, not a row a document,
to the shuffle by hash. There places are ranked within their run, a document's removed sentences are gathered, and
meet its text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import col, fresh, text_digest

RUN = 3
MIN_WORDS = 12
WINDOW = 8
#: Words remembered by a worker at most; then it starts anew.
CACHE_WORDS = 500_000
#: Texts are hashed together up to about this many characters; a longer one alone.
CHUNK_CHARS = 1 << 22
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ODD = 0x1E3779B97F4A7C15
_TRAIL = ".,;:!?)\"'"
_STOPS = ".!?\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u061f\u06d4"
# Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese and full-width forms.
_WIDE = ("\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3001-\u312f\u31a0-\u31bf\u31f0-\u4dbf\u4e00-\u9fff"
         "\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff")
_HAS_WIDE = re.compile(f"[{_WIDE}]")
_WORD = re.compile(rf"[{_WIDE}]|[^\s{_WIDE}]+")


def _end(word: str) -> float:
    """1 if a sentence ends after the word, else its rank (below 1) among its neighbours."""
    if word[-1] in _STOPS:
        return 1.0
    bare = word.lower().rstrip(_TRAIL)
    return (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 11) / (1 << 53)


class _Words(dict):
    """word -> its number; by number, what ``_end`` gives and two hashes of the word in lower case."""

    def __init__(self) -> None:
        self.end, self.one, self.two = np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            met = [words[i] for i in unknown.tolist()]
            self._add(list(set(met)))
            ids[unknown] = [self[w] for w in met]
        return ids

    def _add(self, new: list[str]) -> None:
        low = "\n".join(new).lower().split("\n")
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, _bytes(low))), ">u8").reshape(-1, 2).astype(np.uint64)
        bare = [w.rstrip(_TRAIL) for w in low]
        rank = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, _bytes(bare))), ">u8").astype(np.uint64)
        end = (rank >> np.uint64(11)) / (1 << 53)
        end[[w[-1] in _STOPS for w in new]] = 1
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.end, self.one, self.two = (np.concatenate(x) for x in (
            (self.end, end), (self.one, digests[:, 1]), (self.two, digests[:, 0])))


def _bytes(words: list[str]) -> list[bytes]:
    return "\n".join(words).encode("utf-8", "surrogatepass").split(b"\n")


class _Ends(dict):
    """word -> what ``_end`` gives."""

    def __init__(self) -> None:
        self.words = _Words()

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = end = _end(word)
        return end


def _split(text: str) -> list[list[str]]:
    """The words of each line."""
    if not text.isascii() and _HAS_WIDE.search(text):
        return [_WORD.findall(x) for x in text.split("\n")]
    return [x.split() for x in text.split("\n")]


def _stops(rank: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The number of words to the end of each sentence, of words of these ranks with line ends after ``upto``. Windows
    over a line end find an end that is there already, so texts may follow each other."""
    rank[upto[upto > 0] - 1] = 1
    end = rank >= 1
    if len(rank) >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(rank, WINDOW)
        end[np.arange(len(windows)) + windows.argmax(axis=1)] = True
    return np.flatnonzero(end) + 1


def _cut(text: str, ends: dict[str, float]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of the text, the number of words to the end of each sentence, and to the end of each line."""
    lines = _split(text)
    words = list(chain.from_iterable(lines))
    upto = np.cumsum([len(x) for x in lines])
    return words, _stops(np.fromiter(map(ends.__getitem__, words), np.float64, len(words)), upto), upto


def sentences(text: str, ends: dict[str, float]) -> list[list[list[str]]]:
    """For each line of the text, its sentences as lists of words."""
    words, stops, upto = _cut(text, ends)
    flat = [words[a:b] for a, b in pairwise([0, *stops.tolist()])]
    return [flat[a:b] for a, b in pairwise([0, *np.searchsorted(stops, upto, "right").tolist()])]


def run_hashes(text: str, ends: _Ends, run: int, min_words: int,
               lengthen: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, second hash) of every run; sentences are numbered through, and a place is the number of the
    first, times 65,536, and how many the run has."""
    return next(_hash_texts([text], ends.words, run, min_words, lengthen))


def _hash_texts(texts: list[str], numbers: _Words, run: int, min_words: int,
                lengthen: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``run_hashes`` of each of the texts, all cut and hashed as one sequence of words."""
    lines = [_split(t) for t in texts]
    words = list(chain.from_iterable(chain.from_iterable(lines)))
    upto = np.cumsum([len(x) for t in lines for x in t])
    last = upto[np.cumsum([len(t) for t in lines]) - 1]
    del lines
    ids = numbers.numbers(words)
    del words
    stops = _stops(numbers.end[ids], upto)
    sizes = np.concatenate([[0], stops])
    # A sentence is hashed as a polynomial of its words; a run mixes its sentences in order.
    within = np.arange(len(ids)) - np.repeat(sizes[:-1], np.diff(sizes))
    one, two = (_sums(table[ids], base, within, sizes[:-1]) for table, base in ((numbers.one, _A), (numbers.two, _B)))
    until = np.searchsorted(stops, last, "right")
    at = np.arange(len(stops))
    limit = np.repeat(until, np.diff(until, prepend=0))
    to = at + run
    if lengthen:
        to = np.maximum(to, np.searchsorted(sizes, sizes[at] + min_words))
        whole = to <= limit
    else:
        whole = to <= limit
        whole[whole] = sizes[to[whole]] - sizes[at[whole]] >= min_words
    at, to = at[whole], to[whole]
    h, g = one[at], two[at]
    for k in range(1, (to - at).max(initial=1)):
        more = slice(None) if k < run else np.flatnonzero(at + k < to)
        x, y, nxt = h[more], g[more], at[more] + k
        h[more] = (x ^ (x >> np.uint64(29))) * np.uint64(_A) + one[nxt]
        g[more] = (y ^ (y >> np.uint64(31))) * np.uint64(_B) + two[nxt]
    first = np.concatenate([[0], until[:-1]])
    for a, b, start in zip(np.searchsorted(at, first).tolist(), np.searchsorted(at, until).tolist(), first.tolist(), strict=True):
        yield (at[a:b] - start << 16) + (to[a:b] - at[a:b]), h[a:b].view(np.int64), g[a:b].view(np.int64)


def _sums(values: np.ndarray, base: int, within: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each sentence, the sum of its words' values times powers of ``base`` by their places within it."""
    if not len(starts):
        return values
    powers = np.cumprod(np.full(int(within.max()) + 1, base, np.uint64))
    return np.add.reduceat(values * powers[within], starts)


def _places(docs: DataFrame, run: int, min_words: int, lengthen: bool) -> DataFrame:
    """``(id, k1, at, h, g, gone)``: the places of all runs of documents ``(id, k1, text)``. One is ``gone`` if the texts
    cut with it hold a smaller place of its run; its hash is then that of the place, so that such rows spread."""
    rest = T.StructType.fromDDL("k1 bigint, at bigint, h bigint, g int, gone boolean")
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *rest])

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Words()
        for part in parts:
            texts = [t or "" for t in part.column("text").to_pylist()]
            sizes = np.cumsum([len(t) for t in texts]) // CHUNK_CHARS
            edges = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1)).tolist()
            for a, b in pairwise(edges):
                yield _chunk(part.slice(a, b - a), list(_hash_texts(texts[a:b], numbers, run, min_words, lengthen)))
                if len(numbers) > CACHE_WORDS:
                    numbers = _Words()

    return docs.mapInArrow(of, schema)


def _chunk(part: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    doc = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    at, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
    g = g.astype(np.int32)
    ids, k1 = part.column("id"), part.column("k1").to_numpy()
    gone = _later(h, g, _ranks(ids, k1)[doc], at)
    of_doc = k1[doc]
    h = np.where(gone, (of_doc ^ (at * np.int64(_ODD))) * np.int64(_ODD), h)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *map(pa.array, (of_doc, at, h, g, gone))],
                                      names=["id", "k1", "at", "h", "g", "gone"])


def _ranks(ids: pa.Array, k1: np.ndarray) -> np.ndarray:
    """The rank of each document by id (null last), then text hash; equal ones share theirs."""
    order = pc.sort_indices(pa.table({"id": ids, "k1": k1}), sort_keys=[("id", "ascending"), ("k1", "ascending")]).to_numpy()
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[order]
    step = (np.diff(code, prepend=code[:1]) != 0) | (np.diff(k1[order], prepend=k1[order][:1]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _later(h: np.ndarray, g: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place is greater than another of the same run here."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h)
    same = np.diff(h[order]) == 0
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(h) else order
    if len(some):
        some = some[np.lexsort((at[some], rank[some], g[some], h[some]))]
        new = np.concatenate([[True], (np.diff(h[some]) != 0) | (np.diff(g[some]) != 0)])
        first = some[np.flatnonzero(new)][np.cumsum(new) - 1]
        out[some] = (rank[some] != rank[first]) | (at[some] != at[first])
    return out


def _cut_column(text: Column, gone: Column) -> Column:
    """Struct ``(text, chars)``: the text without the sentences numbered in ``gone``; null where that is null."""
    @F.pandas_udf("text string, sentences bigint")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ends = _Ends()
        for texts, lists in parts:
            yield pd.DataFrame([(None, 0) if x is None else remove(t, set(x.tolist()), ends)
                                for t, x in zip(texts, lists, strict=True)], columns=["text", "sentences"])

    return of(text, gone)


def remove(text: str, gone: set[int], ends: dict[str, float]) -> tuple[str, int]:
    """The text without some sentences, and how many it had. A line that loses nothing stays as it is; one
    that loses something is its other sentences, a space between them (or, in scripts without blanks, what was
    between them); one that loses all goes."""
    kept, n = [], 0
    for line, parts in zip(text.split("\n"), sentences(text, ends), strict=True):
        left = [s for i, s in enumerate(parts, n) if i not in gone]
        n += len(parts)
        if len(left) == len(parts):
            kept.append(line)
        elif left and _HAS_WIDE.search(line):
            starts = [m.start() for m in _WORD.finditer(line)]
            first = np.cumsum([0, *map(len, parts)]).tolist()
            pieces = [line[starts[a]:starts[b] if b < len(starts) else None]
                      for i, (a, b) in enumerate(pairwise(first), n - len(parts)) if i not in gone]
            kept.append("".join(pieces).rstrip())
        elif left:
            kept.append(" ".join(" ".join(s) for s in left))
    return "\n".join(kept), n


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
          min_words: int = MIN_WORDS, removed: str = "removed_sentences", lengthen: bool = False) -> DataFrame:
    """``docs`` with the repeated sentences cut out of ``text_col``, and a column ``removed``: the numbers
    of the sentences that went (null: none). With ``lengthen`` runs of few words are lengthened, else left out.

    Places are ordered by id (null last), then a hash of the text, then the
    sentence. Rows with the same id and text are one document and get the same
    result. A null or empty text has no sentences and stays. A text whose runs
    are all repeated may become empty. All other columns are kept as they are.
    """
    if max(run, min_words) >= 1 << 16:
        raise ValueError("a run has fewer than 65,536 sentences")
    a, _ = text_digest(col(docs, text_col))
    places = _places(docs.select(col(docs, id_col).alias("id"), a.alias("k1"), col(docs, text_col).alias("text")),
                     run, min_words, lengthen)
    order = Window.partitionBy("h", "g").orderBy(F.col("id").asc_nulls_last(), "k1", "at")
    lost = places.withColumn("rank", F.rank().over(order)).where(F.col("gone") | (F.col("rank") > 1))
    lost = lost.groupBy("id", "k1").agg(F.collect_set("at").alias("at"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(
        F.shiftright(x, 16), F.shiftright(x, 16) + x % (1 << 16) - 1)))))
    gid, gkey, gone, cut = fresh(docs, "gone_id", "gone_key", "gone", "cut")
    lost = lost.select(F.col("id").alias(gid), F.col("k1").alias(gkey), covered.alias(gone))
    both = docs.join(lost, col(docs, id_col).eqNullSafe(lost[gid]) & (a == lost[gkey]), "left")
    both = both.withColumn(cut, _cut_column(col(both, text_col), col(both, gone)))
    keep = [F.coalesce(col(both, cut)["text"], col(both, c)).alias(c) if c == text_col else col(both, c) for c in docs.columns]
    return both.select(*keep, col(both, gone).alias(removed))
