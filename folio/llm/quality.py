"""Quality classifier: gradient-boosted trees over statistics of a document's text.

The statistics are computed on the executors from whole texts. Trees are fitted
on a bounded sample of labelled documents (``MAX_ROWS``, those with the least
hash of their id); the flattened trees are a few kilobytes, shipped with the
scoring function. Only the text is an input of a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.boosting import Trees, fit
from folio.llm.common import col

#: Labelled documents a model is fitted on, at most.
MAX_ROWS = 20_000
CUT = 0.7

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
            "space": b" \t", "newline": b"\n", "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|",
            "symbol": b"#*$%&<>@^~_=+\\/{}[]", "quote": b"'\"`()-"}
_TABLE = np.full(256, len(_CLASSES) + 1, np.int64)  # control bytes and the rest of ASCII
_TABLE[128:] = len(_CLASSES)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members)] = _i
STATISTICS = (*_CLASSES, "non_ascii", "other", "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "distinct_words",
              "top_word", "distinct_pairs", "distinct_triples", "log_lines", "distinct_lines", "line_words",
              "capital_words", "short_words", "stops_a_word", "entropy")


def statistics(text: str | None) -> list[float]:
    """The numbers in ``STATISTICS`` for a text; a null or empty text has all zeros."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_TABLE, counts, len(_CLASSES) + 2) / len(raw)
    p = counts[counts > 0] / len(raw)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    ratio = lambda part, whole: part / whole if whole else 0.0
    tally = Counter(words)
    return [*share.tolist(), np.log1p(len(raw)), np.log1p(n), sizes.mean(), sizes.std(), ratio(len(tally), n),
            ratio(max(tally.values(), default=0), n), ratio(len(set(zip(words, words[1:], strict=False))), n - 1),
            ratio(len(set(zip(words, words[1:], words[2:], strict=False))), n - 2), np.log1p(len(lines)),
            ratio(len(set(lines)), len(lines)), ratio(n, len(lines)),
            ratio(sum(c for w, c in tally.items() if w[:1].isupper()), n), float((sizes <= 3).mean()),
            ratio(share[list(_CLASSES).index("stop")] * len(raw), n), float(-(p * np.log2(p)).sum())]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return of(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Fit on the labelled documents, ``max_rows`` at most (the least hashes of the id).

    Labels other than 0 and 1 and null ids are left out; an id with both labels
    counts as 0. Without labels of both kinds the model is a constant.
    """
    known = labels.select(col(labels, label_id_col).alias("label_id"), col(labels, label_col).cast("int").alias("label")) \
        .where("label in (0, 1) and label_id is not null").groupBy("label_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = docs.select(col(docs, id_col).alias("label_id"), col(docs, text_col).alias("text")) \
        .join(F.broadcast(chosen), "label_id")  # max_rows rows of two numbers
    # Repeated rows of an id may make more: the sample keeps to its bound.
    got = rows.select("label_id", "label", statistics_column(F.col("text")).alias("x")).orderBy(
        F.xxhash64("label_id"), "label_id", "x").limit(max_rows).collect()
    x = np.array([r.x for r in got], np.float64).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r.label for r in got], np.float64))


def score(text: Column, model: Trees) -> Column:
    """Probability that the text is of good quality (empty and null texts have one too)."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))
        return pd.Series(model.score(x), dtype="float64")

    return of(text)


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``cut``. A model without trees (it saw
    no labels of both kinds) can tell nothing apart and keeps every row."""
    return docs.where(score(col(docs, text_col), model) >= cut) if len(model.leaf) else docs
