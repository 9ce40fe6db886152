"""Index tables from documents (C1, C3, C5, C6, C7; A11 building blocks).

``postings`` is the inverted list as a DataFrame: one row per token occurrence
``(package, id, col, pos, term)`` with col 0 = (normalised) title, 1 = body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.porter import stemmed
from folio.functions.text import word_tokens
from folio.functions.titles import DOC_TYPES, index_title

TITLE_COL, DOC_COL = 0, 1


def with_index_title(docs: DataFrame, glue: str = "") -> DataFrame:
    """Add ``ititle`` (B3). Rows of unknown type get a null ``ititle``."""
    return docs.withColumn("ititle", index_title(F.col("type"), F.col("title"), glue))


def indexable(docs: DataFrame, glue: str = "") -> DataFrame:
    """Rows the title rules accept, with ``ititle``; the others are in ``quarantine``."""
    return with_index_title(docs.where(index_fault().isNull()), glue)


def index_fault() -> Column:
    """Why the title rules reject a row (B3): an unknown or missing type or no title; null for a row they take."""
    return (F.when(F.col("type").isNull(), F.lit("null type"))
            .when(~F.col("type").isin(DOC_TYPES), F.lit("unknown type"))
            .when(F.col("title").isNull(), F.lit("null title")))


def quarantine(docs: DataFrame) -> DataFrame:
    """Rows the title rules reject, with the ``reason``; ``indexable`` has the others."""
    return docs.withColumn("reason", index_fault()).where(F.col("reason").isNotNull())


def with_tokens(docs: DataFrame, raw_titles: bool = False) -> DataFrame:
    """The rows the title rules accept (all with raw titles) with ``title_tokens`` and ``doc_tokens``."""
    title = F.col("title") if raw_titles else F.col("ititle")
    src = docs if raw_titles else indexable(docs)
    return src.withColumns({"title_tokens": word_tokens(title), "doc_tokens": word_tokens(F.col("doc"))})


def token_arrays(docs: DataFrame, raw_titles: bool = False) -> DataFrame:
    """``(package, id, title_tokens, doc_tokens)``."""
    return with_tokens(docs, raw_titles).select("package", "id", "title_tokens", "doc_tokens")


def postings(docs: DataFrame, stem: bool = False, raw_titles: bool = False) -> DataFrame:
    """Positional postings for title (col 0) and body (col 1)."""
    rows = postings_of(token_arrays(docs, raw_titles))
    return stemmed(rows) if stem else rows


def postings_of(arrays: DataFrame) -> DataFrame:
    """Postings from ``token_arrays`` output, in one pass: explode (title, body)
    then each token list."""
    per_col = arrays.select("package", "id", F.explode(F.array(
        F.struct(F.lit(TITLE_COL).alias("col"), F.col("title_tokens").alias("toks")),
        F.struct(F.lit(DOC_COL).alias("col"), F.col("doc_tokens").alias("toks")))).alias("c"))
    return per_col.select("package", "id", F.col("c.col").alias("col"),
                          F.posexplode("c.toks").alias("pos", "term"))


def term_docs(docs: DataFrame, stem: bool = False, raw_titles: bool = False) -> DataFrame:
    """Document-level postings ``(package, id, col, term, tf)``: each distinct term of a column once, with its
    number of occurrences."""
    return term_docs_of(postings(docs, stem, raw_titles))


def term_docs_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("package", "id", "col", "term").agg(F.count(F.lit(1)).alias("tf"))


def row_lengths(docs: DataFrame) -> DataFrame:
    """``(package, id, dl)``: tokens of every indexed row, 0 where it has none."""
    return token_arrays(docs).select("package", "id", (
        F.greatest(F.size("title_tokens"), F.lit(0)) + F.greatest(F.size("doc_tokens"), F.lit(0))).cast("bigint").alias("dl"))


def tokens(docs: DataFrame, stem: bool = False) -> DataFrame:
    """Body tokens with their position ``(id, pos, token)``."""
    return postings(docs, stem).where(F.col("col") == DOC_COL).select("id", "pos", F.col("term").alias("token"))


def vocabulary(docs: DataFrame, min_docs: int = 2, stem: bool = False) -> DataFrame:
    """Number of rows containing each term, kept when >= ``min_docs``.

    Terms are de-duplicated per row before the shuffle, so a term present in
    every row costs one row per document, and the map-side partial count
    collapses it further.
    """
    per_row = token_arrays(docs).select("id", F.explode(F.array_distinct(
        F.concat("title_tokens", "doc_tokens"))).alias("term"))
    if stem:
        per_row = stemmed(per_row).distinct()
    return (per_row.groupBy("term").agg(F.count(F.lit(1)).alias("doc"))
            .where(F.col("doc") >= min_docs))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Rows, total tokens (all indexed columns) and mean row length."""
    arrays = token_arrays(docs)
    return arrays.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("title_tokens") + F.size("doc_tokens")).cast("bigint").alias("n_tokens"),
        F.round(F.avg(F.size("title_tokens") + F.size("doc_tokens")), 6).alias("avg_tokens"),
    )


def title_terms(corpus: DataFrame) -> DataFrame:
    """Word tokens of the autocomplete titles ``corpus(id, atitle)``: ``(id, term)``, each once a title."""
    return corpus.select("id", F.explode(F.array_distinct(word_tokens(F.col("atitle")))).alias("term"))


def title_vocabulary(corpus: DataFrame, min_docs: int = 2) -> DataFrame:
    """C5 over the autocomplete titles (B5), as the spelling dictionary needs it."""
    return (title_terms(corpus).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("doc"))
            .where(F.col("doc") >= min_docs))


def deletions(word: Column, k: int) -> Column:
    """All strings that deleting up to ``k`` characters of ``word`` leaves, each once."""
    out = level = F.array(word)
    for _ in range(k):
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(
            F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
        level = F.array_distinct(F.flatten(F.transform(level, lambda w: F.when(F.char_length(w) > 0, cut(w)).otherwise(
            F.array().cast("array<string>")))))
        out = F.array_union(out, level)
    return out


def spell_candidates(words: DataFrame, vocab: DataFrame, max_distance: int = 2,
                     top_k: int = 5) -> DataFrame:
    """Closest vocabulary terms for each word in ``words(word)``.

    Two words within ``k`` edits are equal after at most ``k`` deletions in each,
    so both sides are exploded into their deletions and equi-joined;
    ``levenshtein(a, b, k)`` then decides. No pair is formed but by a shared key.
    """
    from pyspark.sql import Window

    w = words.select("word").distinct().select("word", F.explode(deletions(F.col("word"), max_distance)).alias("key"))
    v = vocab.select("term", "doc", F.explode(deletions(F.col("term"), max_distance)).alias("key"))
    near = F.levenshtein(F.col("word"), F.col("term"), max_distance)
    pairs = v.join(w, "key").where(near >= 0).select("word", "term", "doc", near.cast("bigint").alias("distance")).distinct()
    win = Window.partitionBy("word").orderBy("distance", F.desc("doc"), "term")
    return (pairs.withColumn("rk", F.row_number().over(win)).where(F.col("rk") <= top_k)
            .select("word", "term", "doc", "distance", F.col("rk").cast("bigint").alias("rk")))
