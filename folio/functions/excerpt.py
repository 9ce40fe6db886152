"""Column expressions of excerpts (B6): where the tokens of a body stand, and the text of a chosen window.

A body's layout is three arrays of numbers: the characters of each token, the
characters between tokens (one more: head and tail), and the tokens that start
a sentence. It is part of the index, so that no body is cut into tokens again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import MARKS, TOKEN_PATTERN

#: A token as it stands in the text: marks that ``fold`` drops may follow its first letter.
RAW_TOKEN = TOKEN_PATTERN[:-1] + "[" + TOKEN_PATTERN[1:-2] + MARKS + "]*"
OPEN, CLOSE, CUT = "<em>", "</em>", "..."
LAYOUT = ["lens", "gaps", "sentences"]


def with_layout(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """``docs`` with ``lens``, ``gaps`` and ``sentences`` of the body, unless it has them; null for a null body.

    A sentence starts at the first token and at every token after ``.`` or ``:`` and white space."""
    if set(LAYOUT) <= set(docs.columns):
        return docs
    length = lambda x: F.char_length(x)
    between = F.split(F.col(doc_col), RAW_TOKEN, -1)
    starts = F.transform(between, lambda g, i: F.when((i == 0) | g.rlike(r"[.:][ \t\n\r]+$"), i))
    return docs.withColumns({"lens": F.transform(F.regexp_extract_all(doc_col, F.lit(RAW_TOKEN), F.lit(0)), length),
                             "gaps": F.transform(between, length), "sentences": F.array_compact(starts)})


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def render(doc: str, start: Column, marked: Column, n: int) -> Column:
    """The text of the ``n`` tokens from ``start`` on of a body with its layout; ``marked``: array of
    ``(s, e)``, the first and last tokens of what is highlighted, beginning inside the window."""
    text, lens, gaps = F.col(doc), F.col("lens"), F.col("gaps")
    last = F.size("lens") - 1
    stop = start + n - 1
    shown = F.least(stop, last)
    begin = _total(F.slice(gaps, F.lit(1), start + 1)) + _total(F.slice(lens, F.lit(1), start))
    size = _total(F.slice(gaps, start + 2, shown - start)) + _total(F.slice(lens, start + 1, shown - start + 1))

    def window(span: Column) -> Column:
        def more(done: Column, i: Column) -> Column:
            gap = F.when(i > start, F.get(gaps, i)).otherwise(0)
            opens = F.exists(marked, lambda r: r["s"] == i)
            closes = F.exists(marked, lambda r: (r["e"] == i) | ((i == stop) & (r["s"] <= i) & (r["e"] > i)))
            piece = F.concat(done["out"], F.substring(span, done["at"] + 1, gap), F.when(opens, OPEN).otherwise(""),
                             F.substring(span, done["at"] + gap + 1, F.get(lens, i)), F.when(closes, CLOSE).otherwise(""))
            return F.struct(piece.alias("out"), (done["at"] + gap + F.get(lens, i)).alias("at"))

        return F.aggregate(F.sequence(start, shown), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), more, lambda s: s["out"])

    # In an array, so that the span is cut out of the body once.
    body = F.get(F.transform(F.array(F.substring(text, begin + 1, size)), window), F.lit(0))
    head = F.when(start > 0, F.lit(CUT)).otherwise(F.substring(text, F.lit(1), F.get(gaps, F.lit(0))))
    tail = F.when(stop < last, F.lit(CUT)).otherwise(F.substring(text, begin + size + 1, F.get(gaps, last + 1)))
    return F.when(text.isNull() | (last < 0), text).otherwise(F.concat(head, body, tail))
