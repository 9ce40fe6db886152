"""Text analysis as Column expressions (C1, C4 helpers).

Word tokens are runs of letters, digits and private-use characters, lower-cased
with Latin diacritics removed. Everything stays a built-in expression
(``lower``, ``translate``, ``regexp_extract_all``) so it runs inside codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token character classes (letters, numbers, private use).
TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}]+"
# The word pattern the test-data adaptor uses for synthetic titles.
WORD_PATTERN = r"[\p{L}\p{N}]+"


def _fold_table() -> tuple[str, str]:
    """Latin letters that are an ASCII letter with one mark -> that letter; then the marks themselves,
    which have no counterpart and so are dropped where they stand alone after a letter.

    Built from a rule (NFD) over Latin-1 Supplement, Latin Extended-A/B and
    Latin Extended Additional. Letters with two marks and letters without a
    decomposition (ß, æ, ø, ł) stay as they are; a long s is an s.
    """
    src, dst, marks = [], [], set()
    ranges = [(0x00C0, 0x024F), (0x1E00, 0x1EFF)]
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            nfd = unicodedata.normalize("NFD", chr(cp)).replace("\u017f", "s")
            if len(nfd) == 2 and nfd[0].isascii() and nfd[0].isalpha() and unicodedata.combining(nfd[1]):
                src.append(chr(cp))
                dst.append(nfd[0])
                marks.add(nfd[1])
    return "".join(src) + "\u017f" + "".join(sorted(marks)), "".join(dst) + "s"


FOLD_FROM, FOLD_TO = _fold_table()
MARKS = FOLD_FROM[len(FOLD_TO):]


def fold(col: Column) -> Column:
    """Lower-case and strip single Latin diacritics (``Café`` -> ``cafe``)."""
    return F.translate(F.lower(col), FOLD_FROM, FOLD_TO)


def word_tokens(col: Column) -> Column:
    """array<string> of folded word tokens, in text order."""
    return F.regexp_extract_all(fold(col), F.lit(TOKEN_PATTERN), 0)


def words(col: Column) -> Column:
    """Raw (unfolded) words, as used by the test-data title adaptor."""
    return F.regexp_extract_all(col, F.lit(WORD_PATTERN), 0)


def occurrences(text: Column, needle: Column) -> Column:
    """Number of (possibly overlapping) occurrences of ``needle`` in ``text``."""
    n = F.char_length(needle)
    last = F.char_length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.substring(text, i, n) == needle))
