"""Benchmark decontamination by winnowing, in DataFrame functions only.

The words of a text give hashes of every ``gram`` consecutive words; of every
``span - gram + 1`` consecutive hashes the least (leftmost) one is a fingerprint.
Two texts that share ``span`` words share all hashes of that span and so at least
one fingerprint in it. Document fingerprints meet benchmark fingerprints by an
equi-join; each hit is extended word by word, left and right, and counts if the
shared run has at least ``span`` words. Items shorter than ``span`` words are
found whole: all document grams of just their length are joined.

The benchmark side is broadcast, in blocks of at most ``BLOCK_WORDS`` words, so
the documents' fingerprints are not shuffled; hits are, and then the texts that have
one, to extend them: they are found by a broadcast of the digests of hit texts, if these
are counted to be few, else by a join on the digest. Results are keyed by a 128-bit digest of the text: copies of a
text are one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, col, fresh, text_digest
from folio.session import bounded_broadcast, cut_lineage

SPAN = 10
GRAM = 5
#: Benchmark words broadcast at once: about 40 MB with their fingerprints.
BLOCK_WORDS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words: str, n: int, least: int | None = None) -> Column:
    """A hash of the n words from each place on, from the hashes of the words; null for a text of fewer than ``least`` words."""
    places = F.sequence(F.lit(0), F.size(words) - n)
    each = F.transform(words, lambda w: F.xxhash64(w))
    # In an array, so that every word is hashed once.
    return F.when(F.size(words) >= (least or n), F.get(F.transform(F.array(each), lambda h: F.transform(
        places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))), F.lit(0)))


def winnow(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Rows with ``words`` -> one row for each fingerprint: the other columns, ``mark`` (hash) and ``at`` (place)."""
    width = span - gram + 1
    keep = [c for c in rows.columns if c != "words"]
    rows = rows.select(*keep, _grams("words", gram, span).alias("grams"))
    # Outer: or the optimizer would look for short texts before, and cut each into words twice.
    rows = rows.withColumn("p", F.explode_outer(F.sequence(F.lit(0), F.size("grams") - width)))
    at = lambda k: F.get("grams", F.col("p") + k)
    rows = rows.withColumns({"mark": F.least(*[at(k) for k in range(width)]),
                             "before": F.least(*[at(k) for k in range(-1, width - 1)])})
    # A window whose leftmost least hash the window before had too adds nothing.
    rows = rows.where((F.col("p") == 0) | (F.col("mark") != F.col("before")) | (at(-1) == F.col("before")))
    place = F.coalesce(*[F.when(at(k) == F.col("mark"), F.col("p") + k) for k in range(width)])
    return rows.select(*keep, "mark", place.alias("at"))


def _agree(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays of the same size."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _run(span: int) -> tuple[Column, Column]:
    """First word and end of the run that ``words`` from ``at`` on and ``item_words`` from ``item_at`` on, ``n`` words,
    are part of; null ends where these words differ (two hashes were equal by chance)."""
    d, i, p, q, n = (F.col(c) for c in ("words", "item_words", "at", "item_at", "n"))
    right = F.least(F.size(d) - p, F.size(i) - q) - n
    left = F.least(p, q)
    on = _agree(F.slice(d, p + n + 1, right), F.slice(i, q + n + 1, right))
    back = _agree(F.reverse(F.slice(d, p - left + 1, left)), F.reverse(F.slice(i, q - left + 1, left)))
    long_enough = F.least(F.lit(span), F.size(i))
    same = F.slice(d, p + 1, n) == F.slice(i, q + 1, n)
    return (p - back).alias("start"), F.when(same & (back + n + on >= long_enough), p + n + on).alias("stop")


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Shared runs: ``(k1, k2, item, start, stop)``, words ``[start, stop)`` of the text with the digest
    ``(k1, k2)`` being shared with ``item`` (the item id as a string, null ids included)."""
    k1, k2 = text_digest(col(docs, text_col))
    texts = docs.where(col(docs, text_col).isNotNull()).select(k1.alias("k1"), k2.alias("k2"),
                                                              words_of(col(docs, text_col)).alias("words"))
    items = benchmark.select(col(benchmark, item_col).cast("string").alias("item"),
                             words_of(col(benchmark, item_text_col)).alias("item_words"))
    items = items.select("item", "item_words", *[c.alias(n) for c, n in zip(text_digest(F.col("item_words")), ("i1", "i2"), strict=True)])
    total, *short = items.agg(F.sum(F.size("item_words")), *[F.max((F.size("item_words") == n).cast("int"))
                                                             for n in range(1, span)]).first()
    blocks = -(-(total or 0) // block_words)
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.col("i1"), F.lit(blocks)) == b)
        own = part.select("i1", "i2", F.col("item_words").alias("words")).distinct()
        marks = winnow(own, span, gram).withColumnRenamed("at", "item_at")
        met = [winnow(texts, span, gram).join(F.broadcast(marks), "mark").withColumn("n", F.lit(gram))]
        for n in (n for n, some in enumerate(short, 1) if some):
            whole = own.where(F.size("words") == n).select("i1", "i2", F.get(_grams("words", n), F.lit(0)).alias("mark"), F.lit(0).alias("item_at"))
            every = texts.select("k1", "k2", F.posexplode(_grams("words", n)).alias("at", "mark"))
            met.append(every.join(F.broadcast(whole), "mark").withColumn("n", F.lit(n)))
        # Hits are few. Written, they part the join of fingerprints from their extension.
        cols = ["k1", "k2", "i1", "i2", "at", "item_at", "n"]
        spots = cut_lineage(reduce(DataFrame.union, [m.select(*cols) for m in met]).distinct())
        around = texts.join(bounded_broadcast(spots.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        start, stop = _run(span)
        runs = spots.join(around, ["k1", "k2"]).join(F.broadcast(own.withColumnRenamed("words", "item_words")), ["i1", "i2"]) \
            .select("k1", "k2", "i1", "i2", start, stop).where("stop is not null").distinct()
        found.append(runs.join(F.broadcast(part.select("i1", "i2", "item").distinct()), ["i1", "i2"]).select(
            "k1", "k2", "item", "start", "stop"))
    if not found:
        none = texts.where(F.lit(False))
        return none.select("k1", "k2", F.lit("").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    return reduce(DataFrame.union, found)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every row of ``docs``: ``(doc_id, n_words, n_hit, items)``: its words, those inside a shared run,
    and the ids (strings, sorted) of the items that share one.

    A null or empty text has no words and is never hit; a null or empty item
    has no run; an item with a null id hits words, but names no item. Repeated
    rows each give a row, repeated items count once by id. An empty benchmark
    hits nothing. Further columns are not read.
    """
    found = hits(docs, benchmark, text_col, item_col, item_text_col, span, gram, block_words)
    by_text = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("runs"),
                                            F.sort_array(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate(F.sort_array("runs"), zero, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], s["end"]))).alias("n"),
        F.greatest(s["end"], r["stop"]).alias("end")), lambda s: s["n"])
    by_text = by_text.select("k1", "k2", hit.cast("bigint").alias("n_hit"), "items")
    text = col(docs, text_col)
    k1, k2 = text_digest(text)
    rows = docs.select(col(docs, id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce(
        F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    return rows.join(bounded_broadcast(cut_lineage(by_text)), ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, all columns, whose text shares no run with an item."""
    k1, k2 = fresh(docs, "k1", "k2")
    found = hits(docs, benchmark, text_col, item_col, item_text_col, span, gram) \
        .select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    found = bounded_broadcast(cut_lineage(found))
    a, b = text_digest(col(docs, text_col))
    return docs.join(found, (a == found[k1]) & (b == found[k2]), "left_anti")
