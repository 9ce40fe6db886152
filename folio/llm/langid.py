"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to
three letters; a run of other characters counts as one blank). A document's own
most frequent n-grams are compared to each profile by the out-of-place
distance: the sum of the differences in rank, and the length of the profile for an
n-gram that the profile does not have. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import col

#: N-grams in a profile, of a language and of a document.
PROFILE = 300
UNKNOWN = "und"
#: N-grams a worker counts before it merges them with what it has.
MERGE_AT = 4_000_000


class Letters:
    """Which code points are letters, looked up once each."""

    def __init__(self):
        self.is_letter = np.zeros(0x110000, np.int8)  # 0 not asked yet, 1 letter, -1 other

    def codes(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text, each run of other characters being one 0; 0 at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = self.is_letter[points]
        if not known.all():
            for c in np.unique(points[known == 0]).tolist():
                self.is_letter[c] = 1 if chr(c).isalpha() else -1
            known = self.is_letter[points]
        padded = np.zeros(len(points) + 2, np.int64)
        padded[1:-1] = np.where(known > 0, points, 0)
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
        return padded[keep]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three codes (21 bits a code; a single blank is left out) and their counts."""
    single = codes[codes > 0]
    if not len(single):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A pair or triple may start with a blank: 1 << 62 and 1 << 61 keep the lengths apart.
    pairs = (codes[:-1] << 21 | codes[1:]) + (np.int64(1) << 61)
    triples = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
    triples = triples ^ (np.int64(1) << 62)
    return np.unique(np.concatenate([single, pairs, triples]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their codes."""
    if len(keys) > 4 * most:  # those below the count at the cut cannot be among them
        cut = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= cut], counts[counts >= cut]
    return keys[np.lexsort((keys, -counts))[:most]]


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = PROFILE) -> dict[str, list[int]]:
    """Profile of each language: n-grams counted over all rows with a language and a text.

    Workers count whole partitions, Spark adds the counts up by (language,
    n-gram); only the ``most`` first of each language come to the driver.
    """
    rows = docs.select(col(docs, lang_col).cast("string").alias("lang"), col(docs, text_col).alias("text")) \
        .where("lang is not null and text is not null")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, held, waiting = Letters(), {}, 0

        def merged(parts: list) -> list:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return [(keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                keys, n = grams(letters.codes(text))
                held.setdefault(lang, []).append((keys, n))
                waiting += len(keys)
                if waiting > MERGE_AT:
                    held = {k: merged(v) for k, v in held.items()}
                    waiting = 0
        for lang, parts in held.items():
            (keys, n), = merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    total = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Classifier:
    def __init__(self, known: dict[str, list[int]], most: int = PROFILE):
        self.most, self.langs, self.letters = most, sorted(known), Letters()
        self.tables = []
        for lang in self.langs:
            keys = np.array(known[lang], np.int64)
            order = np.argsort(keys)
            self.tables.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(self.letters.codes(text or ""))
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(keys, counts, self.most)
        rank = np.arange(len(own))
        far = []
        for table, place in self.tables:
            at = np.minimum(np.searchsorted(table, own), len(table) - 1)
            there = table[at] == own
            far.append(np.where(there, np.abs(place[at] - rank), self.most).sum())
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.most * len(own)))


def predict(text: Column, known: dict[str, list[int]], most: int = PROFILE) -> Column:
    """Struct ``(lang, score)``: the nearest language and 1 less its distance as a share of the largest possible.

    ``und`` and 0 for a null text, a text without letters, and when no profile is known.
    """
    @F.pandas_udf("lang string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(known, most)
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return of(text)
