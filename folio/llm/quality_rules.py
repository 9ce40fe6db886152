"""Quality rules from the lines that the documents of a host share, in DataFrame functions only.

Lines are normalised and hashed; for each host the distinct texts that hold a line
are counted (copies of a text count once: they are not a host's boilerplate), or,
with ``copies``, the distinct documents: pairs of an id and a text.
A line in more than ``max_docs`` texts of its host, and in more than a share
``max_share`` of them, is removed. A document that keeps less than ``min_left`` of its
words is depleted and rejected.

Everything is keyed by (host, digest of the text), so copies, repeated ids and
null ids need no care, and texts themselves are only read, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, col, text_digest
from folio.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MAX_DOCS = 10
MAX_SHARE = 0.01
MIN_LEFT = 0.5


def normal_line(line: Column) -> Column:
    """Lower case, no white space at the ends, every number the same."""
    return F.regexp_replace(ascii_lower(F.btrim(line, F.lit(SPACE))), "[0-9]+", "0")


def _covered(places: Column, width: int) -> Column:
    """Number of words covered by windows of ``width`` words from sorted distinct places on."""
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def base_statistics(rows: DataFrame) -> DataFrame:
    """Adds to rows with ``text``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint"))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))
    rows = rows.withColumn("windows", F.when(F.size("words") > WINDOW, windows))
    # Windows sorted by hash, each beside the next one: equal neighbours are repeats.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("by_hash", F.when(repeats, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("like_next", F.zip_with("by_hash", F.slice("by_hash", 2, F.size("by_hash")),
                                                   lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    rows = rows.withColumn("marked", F.zip_with(
        "by_hash", F.zip_with("like_next", F.concat(F.array(F.lit(False)), F.col("like_next")),
                              lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda w, m: F.when(m, w["i"])))
    rows = rows.withColumn("places", F.sort_array(F.array_compact("marked")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return rows.withColumn("lines", lines).select(
        *[c for c in rows.columns if c not in ("words", "windows", "by_hash", "like_next", "marked", "places")],
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("places"), WINDOW), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def line_frequency(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
                   max_share: float = MAX_SHARE, id_col: str | None = None) -> DataFrame:
    """``(host, k1, k2, removed, total, lines)`` for the texts that lose lines: words in lines above the limits and
    in all lines, summed over the copies of the text, and the hashes of the lines to remove. A null host is a host.
    With ``id_col`` documents are counted, pairs of an id (null is one) and a text, not texts."""
    k1, k2 = text_digest(col(docs, text_col))
    rows = docs.select(col(docs, host_col).alias("host"), k1.alias("k1"), k2.alias("k2"),  # hashed before it is cut
                       F.split(col(docs, text_col), "\n").alias("all"))
    rows = rows.select("host", "k1", "k2", F.explode("all").alias("line")).where(F.btrim("line", F.lit(SPACE)) != "")
    rows = rows.select("host", "k1", "k2", F.xxhash64(normal_line(F.col("line"))).alias("line"),
                       F.regexp_count("line", F.lit(WORD)).alias("words"))
    # Written once: the counts and the join below read it.
    held = cut_lineage(rows.groupBy("host", "line", "k1", "k2").agg(F.sum("words").alias("words")))
    texts = docs.where(col(docs, text_col).isNotNull()).select(col(docs, host_col).alias("host"), k1.alias("k1"), k2.alias("k2"))
    if id_col is None:
        texts = texts.groupBy("host", "k1", "k2").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("texts"))
        freq = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs)
    else:
        sizes = docs.where(col(docs, text_col).isNotNull()).select(
            col(docs, host_col).alias("h"), k1.alias("g1"), k2.alias("g2"), col(docs, id_col).alias("id"))
        sizes = sizes.groupBy("h", "g1", "g2", "id").agg(F.lit(1).alias("one")).groupBy("h", "g1", "g2").agg(F.count("one").alias("size"))
        texts = sizes.groupBy(F.col("h").alias("host")).agg(F.sum("size").alias("texts"))
        freq = held.join(sizes, F.col("host").eqNullSafe(F.col("h")) & (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))) \
            .groupBy("host", "line").agg(F.sum("size").alias("docs")).where(F.col("docs") > max_docs)
    above = freq.join(texts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))) \
        .where(F.col("docs") > max_share * F.col("texts")).select(F.col("h"), F.col("line").alias("l"))
    gone = held.join(above, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    return gone.groupBy("host", "k1", "k2").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("lines"))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, copies: bool = False) -> DataFrame:
    """For every row of ``docs``: ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_line_words, kept, clean_text)``.

    ``n_line_words``: words in lines above the limits; ``clean_text``: the text
    without these lines (a null text stays null). ``kept`` is false if the base rules fail (fewer than 10
    words, or over a fifth of them in repeated windows of five) or the document is depleted. A null or empty text has no words and
    fails. With ``copies`` a line's documents are counted, not its texts; a ``max_share`` of 0 leaves ``max_docs``
    as the only limit. Rows with the same host and text get the same result, whatever
    their ids. Further columns are not read.
    """
    k1, k2 = text_digest(col(docs, text_col))
    gone = line_frequency(docs, text_col, host_col, max_docs, max_share, id_col if copies else None).select(
        F.col("host").alias("h"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), "removed", "lines")
    rows = base_statistics(docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"),
                                       col(docs, host_col).alias("host"), k1.alias("k1"), k2.alias("k2")))
    # Copies of a text lose the same words each: their sum, over their number, is one copy's.
    alike = docs.where(col(docs, text_col).isNotNull()).select(
        col(docs, host_col).alias("h"), k1.alias("g1"), k2.alias("g2")).groupBy("h", "g1", "g2").agg(F.count(F.lit(1)).alias("copies"))
    gone = gone.alias("a").join(alike.alias("b"), F.expr("a.h <=> b.h and a.g1 = b.g1 and a.g2 = b.g2")).select(
        "a.h", "a.g1", "a.g2", (F.col("removed") / F.col("copies")).cast("bigint").alias("n_line_words"), F.col("lines").alias("gone"))
    both = rows.join(gone, F.col("host").eqNullSafe(F.col("h")) & (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = F.coalesce("n_line_words", F.lit(0).cast("bigint"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normal_line(x)))), "\n")
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), lost.alias("n_line_words"),
                       (~failed & (F.col("n_words") - lost >= min_left * F.col("n_words"))).alias("kept"),
                       F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("clean_text"))
