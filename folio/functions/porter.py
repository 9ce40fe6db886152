"""Porter (1980) suffix stripping as Column expressions.

The algorithm follows M. F. Porter, "An algorithm for suffix stripping",
Program 14(3), 1980, with the two well-known revisions of the author's own
distribution (``bli -> ble``, ``logi -> log`` in step 2). Tokens whose UTF-8
form is shorter than 3 or longer than 64 bytes are left alone; letters outside
ASCII count as consonants.

Each step is one ``transform`` over an array of tokens, so a step's result is
computed once however often its rules look at it. A corpus is never stemmed by
occurrence: ``stems`` maps its distinct terms, and they are joined back; an index
build, which has a batch's distinct terms at hand, stems them where it cuts them (``Stemmer``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BYTES, MAX_BYTES = 3, 64

# Suffix rules of steps 2, 3 and 4 (suffix, replacement).
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]

# A y is a vowel after a consonant: a run of consonants may start with one, a run of vowels too.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_OVER_0 = f"^({_C})?{_V}{_C}"
M_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
M_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][\\x00-\\x7f&&[^aeiouwxy]]$"  # consonant, vowel, consonant, where m is 1
DOUBLE = r"([\x00-\x7f&&[^aeiouylsz]])\1$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _first(w: Column, rules: list[tuple[str, Callable[[Column], Column]]]) -> Column:
    """The rule of the longest suffix that ``w`` has decides, whether or not it changes ``w``."""
    out = w
    for suffix, rule in sorted(rules, key=lambda r: len(r[0])):
        out = F.when(w.endswith(suffix), rule(_cut(w, len(suffix)))).otherwise(out)
    return out


def _swap(w: Column, test: str, rep: str) -> Callable[[Column], Column]:
    return lambda stem: F.when(stem.rlike(test), F.concat(stem, F.lit(rep))).otherwise(w)


def _plural(w: Column) -> Column:
    return _first(w, [("sses", lambda s: F.concat(s, F.lit("ss"))), ("ies", lambda s: F.concat(s, F.lit("i"))),
                      ("ss", lambda s: w), ("s", lambda s: s)])


def _past(w: Column) -> Column:
    """Step 1b; a stem that lost ``ed`` or ``ing`` is marked by a leading ``#`` for the next step."""
    mark = lambda s: F.when(s.rlike(HAS_VOWEL), F.concat(F.lit("#"), s)).otherwise(w)
    return _first(w, [("eed", _swap(w, M_OVER_0, "ee")), ("ed", mark), ("ing", mark)])


def _mend(w: Column) -> Column:
    s = F.substring(w, F.lit(2), F.length(w))
    fixed = (F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e")))
             .when(s.rlike(DOUBLE), _cut(s, 1))
             .when(s.rlike(SHORT), F.concat(s, F.lit("e"))).otherwise(s))
    return F.when(w.startswith("#"), fixed).otherwise(w)


def _final_y(w: Column) -> Column:
    return _first(w, [("y", _swap(w, HAS_VOWEL, "i"))])


def _step2(w: Column) -> Column:
    return _first(w, [(s, _swap(w, M_OVER_0, r)) for s, r in STEP2])


def _step3(w: Column) -> Column:
    return _first(w, [(s, _swap(w, M_OVER_0, r)) for s, r in STEP3])


def _step4(w: Column) -> Column:
    ion = lambda s: F.when(s.rlike("[st]$") & s.rlike(M_OVER_1), s).otherwise(w)
    return _first(w, [(s, ion if s == "ion" else _swap(w, M_OVER_1, "")) for s in STEP4])


def _final_e(w: Column) -> Column:
    return _first(w, [("e", lambda s: F.when(s.rlike(M_OVER_1) | (s.rlike(M_IS_1) & ~s.rlike(SHORT)), s).otherwise(w))])


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(M_OVER_1), _cut(w, 1)).otherwise(w)


def stem_tokens(tokens: Column) -> Column:
    """Stem every token of an ``array<string>`` column (lower-case tokens without a ``#``): for
    request-sized and result-sized columns; a corpus goes through ``stems``."""
    out = tokens
    for step in (_plural, _past, _mend, _final_y, _step2, _step3, _step4, _final_e, _final_l):
        out = F.transform(out, step)
    fits = lambda w: F.octet_length(w).between(MIN_BYTES, MAX_BYTES)
    return F.zip_with(tokens, out, lambda w, s: F.when(fits(w), s).otherwise(w))


def stem_column(token: Column) -> Column:
    return F.get(stem_tokens(F.array(token)), 0)


def stems(terms: DataFrame) -> DataFrame:
    """``(term, stem)`` for the distinct values of ``terms(term)``."""
    return terms.select("term").distinct().withColumn("stem", stem_column(F.col("term")))


def stemmed(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``term``, stemmed: each distinct term once, joined back (a join whose hot terms
    Spark splits)."""
    s = stems(rows).withColumnRenamed("term", "_term")
    return rows.join(s, rows["term"] == s["_term"]).select(
        *[F.col("stem").alias("term") if c == "term" else rows[c] for c in rows.columns])


class Stemmer:
    """``stem_column`` for words in a task. Up to ``known`` words are remembered."""

    def __init__(self, known: int = 200_000):
        self.limit, self.known = known, {}
        # Java's intersections of classes, told apart before the character is taken.
        tests = (M_OVER_0, M_IS_1, M_OVER_1, HAS_VOWEL, SHORT, DOUBLE, "(at|bl|iz)$", "[st]$")
        plain = [re.sub(r"\[\\x00-\\x7f&&(\[\^\w+\])\]", r"(?:(?=[\\x00-\\x7f])\1)", t) for t in tests]
        self.m0, self.m_is_1, self.m1, self.vowel, self.short, self.double, self.take_e, self.s_or_t = (re.compile(t).search for t in plain)
        swap = lambda rules, test: [{x: (r, test) for x, r in rules if len(x) == n} for n in sorted({len(x) for x, _ in rules}, reverse=True)]
        self.steps = [swap(STEP2, self.m0), swap(STEP3, self.m0), swap([(x, "") for x in STEP4], self.m1)]

    def __call__(self, words: list[str]) -> list[str]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self._stem(w) if MIN_BYTES <= len(w.encode("utf-8", "replace")) <= MAX_BYTES else w
        return [known[w] for w in words]

    def _stem(self, w: str) -> str:
        if w.endswith("s"):
            w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.m0(w[:-3]) else w
        else:
            cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
            if cut and self.vowel(cut):
                w = cut + "e" if self.take_e(cut) else cut[:-1] if self.double(cut) else cut + "e" if self.short(cut) else cut
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        for step in self.steps:
            for rules in step:
                n = len(next(iter(rules)))
                if (rule := rules.get(w[-n:])) is not None:
                    stem, (rep, test) = w[:-n], rule
                    if test(stem) and (n != 3 or w[-3:] != "ion" or self.s_or_t(stem)):
                        w = stem + rep
                    break
        if w.endswith("e"):
            cut = w[:-1]
            if self.m1(cut) or self.m_is_1(cut) and not self.short(cut):
                w = cut
        return w[:-1] if w.endswith("ll") and self.m1(w) else w
