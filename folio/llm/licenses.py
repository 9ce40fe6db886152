"""License scan by MinHash bands and exact containment, in DataFrame functions only.

A text is words (lower case); shingles are ``SHINGLE`` consecutive words. Windows of
``WINDOW`` shingles start every ``STRIDE`` shingles of a document and at every
shingle of a license notice. ``BANDS`` bands of one MinHash each: two windows with
a Jaccard similarity of s meet in a band with the probability 1 - (1 - s)^BANDS,
and surely if they are equal. A notice of 3 to 5 shingles is whole, or but for one,
in some document window (s >= 1/2: 0.99998 with 16 bands); a notice of 9 and more
that a document has unchanged equals one of the notice's windows there.

Windows that meet have the shingle of that MinHash in common, so only windows of a document
round a shingle that is a MinHash of a notice are hashed; the others cannot meet any.

Every notice met is then checked: it is found if at least ``MIN_SHARE`` of its
distinct shingles are among the document's around that window. With ``apart``, so
must be all shingles that tell it from a notice of another license which would pass
for it (version 2 from version 3). The notices' MinHashes (shingle and band) are broadcast,
in blocks of a counted size.
The documents are neither shuffled nor grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import col, text_digest
from folio.llm.decontam import words_of

SHINGLE = 3
WINDOW = 6
STRIDE = 4
BANDS = 16
MIN_SHARE = 0.8
#: Rows of the notices' table of MinHashes that are broadcast at once; a longer list is scanned in blocks.
MAX_BAND_ROWS = 1_000_000

# Notices as their licenses word them.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                   "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Further short forms.
SHORT_FORMS = [("CC-BY-4.0", "Licensed under CC BY 4.0.")]
# Bodies of short licenses, without their copyright lines.
BODIES = [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
            "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
            "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
            "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
            "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
            "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
            "OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
             "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
             "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
             "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
             "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
             "3. This notice may not be removed or altered from any source distribution."),
]
#: What the registered query looks for.
TEMPLATES = NOTICES + SHORT_FORMS + BODIES


def _shingles(words: str) -> Column:
    """Hashes of the shingles; a text of fewer words is one shingle (and so found whole only), one without words has none."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.least(F.size(words), F.lit(1)))
    each = F.transform(words, lambda w: F.xxhash64(w))
    # In an array, so that every word is hashed once.
    return F.when(n > 0, F.get(F.transform(F.array(each), lambda h: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))), F.lit(0)))


def _bands(shingles: str, p: Column, b: Column) -> list[Column]:
    """The hashes, in band ``b``, of the shingles of the window from shingle ``p`` on; null behind the last one."""
    return [F.when(F.get(shingles, p + k).isNotNull(), F.xxhash64(F.get(shingles, p + k), b)) for k in range(WINDOW)]


def _chosen(known: DataFrame, bands: int) -> DataFrame:
    """Notices with ``shingles`` -> a row for each window (from any shingle on) and band ``b``: ``shingle`` is the one with the MinHash."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - WINDOW, F.lit(0)))
    rows = known.withColumn("p", F.explode(starts)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    each = [F.when(h.isNotNull(), F.struct(h.alias("h"), F.get("shingles", F.col("p") + k).alias("shingle")))
            for k, h in enumerate(_bands("shingles", F.col("p"), F.col("b")))]
    return rows.withColumn("shingle", F.least(*each)["shingle"]).where("shingle is not null").drop("p")


def _met(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts with ``shingles`` and what is ``chosen`` of notices -> a row for each window of a text (from shingle ``p``)
    that meets a window of a notice in a band.

    Windows with one MinHash have its shingle in common: so texts are searched for the chosen shingles, and only
    windows round these are hashed."""
    # Outer: or the optimizer would look for texts without shingles before, and cut each into words twice.
    at = texts.select("k1", "k2", "shingles", F.posexplode_outer("shingles").alias("i", "shingle"))
    hits = at.join(F.broadcast(chosen), "shingle")  # at most MAX_BAND_ROWS
    last = F.col("i") - F.col("i") % STRIDE
    rows = hits.withColumn("p", F.explode(F.array(*[last - d for d in range(0, WINDOW, STRIDE)])))
    rows = rows.where((F.col("p") >= 0) & (F.col("p") > F.col("i") - WINDOW)
                      & (F.col("p") <= F.greatest(F.size("shingles") - WINDOW + STRIDE - 1, F.lit(0))))
    return rows.where(F.xxhash64("shingle", "b") == F.least(*_bands("shingles", F.col("p"), F.col("b"))))


def _with_marks(known: DataFrame, min_share: float) -> DataFrame:
    """Adds ``marks`` to notices: their shingles that a notice of another license lacks which has the share asked for."""
    each = known.select("license", "own", F.explode("own").alias("shingle")).distinct()
    others = each.select(F.col("license").alias("license2"), F.col("own").alias("own2"), "shingle")
    near = each.join(others, "shingle").where(~F.col("license").eqNullSafe(F.col("license2"))) \
        .groupBy("license", "own", "license2", "own2").agg(F.count(F.lit(1)).alias("same")) \
        .where(F.col("same") >= min_share * F.size("own"))
    marks = near.groupBy(F.col("license").alias("l"), F.col("own").alias("o")).agg(
        F.array_distinct(F.flatten(F.collect_list(F.array_except("own", "own2")))).alias("marks"))
    both = known.join(marks, F.col("license").eqNullSafe(F.col("l")) & (F.col("own") == F.col("o")), "left")
    return both.withColumn("marks", F.coalesce("marks", F.array().cast("array<bigint>"))).drop("l", "o")


def matches(docs: DataFrame, notices: DataFrame, text_col: str = "text", name_col: str = "license",
            notice_col: str = "notice", bands: int = BANDS, min_share: float = MIN_SHARE, apart: bool = False) -> DataFrame:
    """``(k1, k2, license, share)``: licenses found in the text with the digest ``(k1, k2)``, and the largest
    share of a notice's shingles that it has. Null notices are passed over. With ``apart`` a notice is found
    only with the shingles that tell it from near notices of other licenses."""
    k1, k2 = text_digest(col(docs, text_col))
    texts = docs.where(col(docs, text_col).isNotNull()).select(k1.alias("k1"), k2.alias("k2"), words_of(col(docs, text_col)).alias("words"))
    texts = texts.withColumn("shingles", _shingles("words")).drop("words")
    known = notices.select(col(notices, name_col).alias("license"), words_of(col(notices, notice_col)).alias("words"))
    known = known.withColumn("shingles", _shingles("words")).drop("words")
    known = known.withColumn("own", F.array_distinct("shingles"))
    bound = known.agg(F.sum(F.size("shingles"))).first()[0] or 0
    marks = []
    if apart:
        known, marks = _with_marks(known, min_share), ["marks"]
    blocks = max(1, -(-bound * bands // MAX_BAND_ROWS))
    found = []
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("own"), F.lit(blocks)) == b) if blocks > 1 else known
        met = _met(texts, _chosen(part, bands).select("shingle", "b", "license", "own", *marks, F.size("shingles").alias("n")).distinct())
        around = F.slice("shingles", F.greatest(F.col("p") - F.col("n"), F.lit(0)) + 1,
                         F.least(F.col("p"), F.col("n")) + WINDOW + F.col("n"))
        share = F.size(F.array_intersect("own", around)) / F.size("own")
        if apart:
            met = met.where(F.size(F.array_except("marks", around)) == 0)
        found.append(met.select("k1", "k2", "license", share.alias("share")).where(F.col("share") >= min_share))
    return reduce(DataFrame.unionAll, found).groupBy("k1", "k2", "license").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "license",
         notice_col: str = "notice", bands: int = BANDS, min_share: float = MIN_SHARE, apart: bool = False) -> DataFrame:
    """For every row of ``docs``: ``(doc_id, licenses)``, the names of the licenses it has a notice of, sorted.

    A null or empty text has none, and neither has any text if there are no
    notices. With ``apart`` notices of different licenses that share most shingles are told apart. Repeated rows each give a row. Further columns are not read.
    """
    found = matches(docs, notices, text_col, name_col, notice_col, bands, min_share, apart)
    found = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("license")).alias("licenses"))
    k1, k2 = text_digest(col(docs, text_col))
    rows = docs.select(col(docs, id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
