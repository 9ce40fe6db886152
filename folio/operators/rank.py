"""Relevance scores and download/graph blends.

BM25 follows the usual full-text definition (k1 = 1.2, b = 0.75, idf floored
at 1e-6, score negated so that lower is better):

    rank = -sum_phrases idf * f * (k1 + 1) / (f + k1 * (1 - b + b * D / avgD))
    idf  = ln((N - n + 0.5) / (n + 0.5))

``N`` rows, ``n`` rows containing the phrase, ``f`` phrase instances in the
row, ``D`` tokens in the row, ``avgD`` mean tokens per row. Two token models:
word postings (search index) and character trigrams (title autocomplete).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import occurrences
from folio.operators.match import (boolean_filter, clause_tokens, phrase_instances, trigram_candidates,
                                   trigrams)

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6


def _bm25(freq: DataFrame, rows: DataFrame) -> DataFrame:
    """freq(request_id, clause_no, id, f), rows(id, dl) -> (request_id, id, rank).

    ``freq`` holds one row per (request, phrase, row), so ``n`` is a plain
    (partially aggregated) count. The corpus statistics are an aggregate of one row
    inside the plan."""
    n = freq.groupBy("request_id", "clause_no").agg(F.count(F.lit(1)).alias("n"))
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
    s = (freq.join(n, ["request_id", "clause_no"]).join(rows, "id").join(F.broadcast(stats))
         .select("request_id", "id",
                 (idf * F.col("f") * (K1 + 1)
                  / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("term")))
    return s.groupBy("request_id", "id").agg((-F.sum("term")).alias("rank"))


def bm25_words(postings: DataFrame, terms: DataFrame, lengths: DataFrame, clause_df: DataFrame, meta: DataFrame,
               vocab: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """F4 over a word index holding every package: ``(request_id, id, rank)`` for rows satisfying the request.

    Reads the index tables: single words from ``terms(id, col, term, tf)``, phrases from
    ``postings(id, col, pos, term)``, ``lengths(id, dl)`` with every row of the index, and
    prefixes by ``vocab(term)``. Nothing is tokenised here but the requests."""
    whole = lambda df: df.withColumn("package", F.lit("*"))
    rp = meta.select("request_id", F.lit(0).cast("bigint").alias("package_pos"), F.lit("*").alias("package"))
    ct = clause_tokens(clause_df, stem).join(meta.where("valid").select("request_id"), "request_id", "left_semi")
    vocab = whole(vocab.select("term").distinct()) if vocab is not None else None
    inst = phrase_instances(whole(postings), ct.join(rp, "request_id"), whole(terms), vocab=vocab)
    keep = boolean_filter(inst, meta).select("request_id", "id")
    freq = (inst.where(F.col("kind") != "absent")
            .groupBy("request_id", "clause_no", "id").agg(F.sum("f").alias("f")))
    return _bm25(freq, lengths.select("id", "dl")).join(keep, ["request_id", "id"], "left_semi")


def trigram_rows(corpus: DataFrame, title_col: str = "atitle") -> DataFrame:
    """``(id, package, lt, dl)``: lower-cased title and its number of trigrams."""
    return corpus.where(F.col(title_col).isNotNull()).select(
        "id", "package", F.lower(F.col(title_col)).alias("lt"),
        F.greatest(F.char_length(title_col) - 2, F.lit(0)).alias("dl"))


def row_trigrams(rows: DataFrame) -> DataFrame:
    """``(package, id, tri)``: the distinct trigrams of ``trigram_rows``."""
    return rows.select("package", "id", F.explode(trigrams(F.col("lt"))).alias("tri"))


def bm25_trigram(corpus_rows: DataFrame, clause_df: DataFrame, meta: DataFrame,
                 min_chars: int = 3, tri_index: DataFrame | None = None, tri_counts: DataFrame | None = None) -> DataFrame:
    """F4 over the trigram title corpus (``trigram_rows``): ``(request_id, id, rank)``
    for rows satisfying the request (substring semantics of E9).

    Candidates come from the trigram index of the corpus (read, or derived from
    the rows), confirmed with ``contains``; f counts overlapping hits."""
    cp = (clause_df.join(meta.where("valid").select("request_id"), "request_id", "left_semi")
          .where(F.char_length("text") >= min_chars)
          .select("request_id", "clause_no", "kind", F.lower(F.col("text")).alias("needle")))
    tri = (tri_index if tri_index is not None else row_trigrams(corpus_rows)).select(F.lit("*").alias("package"), "id", "tri")
    cand = trigram_candidates(tri, cp.withColumn("c_package", F.lit("*")), ["request_id", "clause_no", "kind"],
                              counts=tri_counts)
    rows = corpus_rows.select(F.col("id").alias("r_id"), "lt", "dl")
    hits = (cand.join(rows, cand["id"] == rows["r_id"]).where(F.col("lt").contains(F.col("needle")))
            .select("request_id", "clause_no", "kind", "id", "dl",
                    occurrences(F.col("lt"), F.col("needle")).alias("f")))
    inst = hits.select("request_id", F.lit(0).cast("bigint").alias("package_pos"), F.lit("*").alias("package"),
                       "clause_no", "kind", "id", F.lit(0).alias("col"))
    keep = boolean_filter(inst, meta).select("request_id", "id")
    freq = hits.where(F.col("kind") != "absent").select("request_id", "clause_no", "id", "f")
    return _bm25(freq, corpus_rows.select("id", "dl")).join(keep, ["request_id", "id"], "left_semi")


def top_k(df: DataFrame, k: int, order: list, by: str = "request_id") -> DataFrame:
    """First ``k`` rows per request in ``order`` (ties fully broken by the caller)."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w).cast("bigint")).where(F.col("pos") <= k)


def blend_rows(ranks: DataFrame, docs: DataFrame, packages: DataFrame, floor: float,
               nearest: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """Rank rows joined with their document, package (downloads > floor)
    and, when given, the nearest graph distance of the package per request. ``within(request_id, package)``
    restricts the requests it names to packages; the others have all."""
    d = docs.select("id", "package", "ref", "title")
    p = packages.where(F.col("recent_downloads") > floor).select(
        F.col("name").alias("package"), "recent_downloads")
    rows = ranks.join(d, "id").join(p, "package")
    if within is not None:
        asked = within.select("request_id", "package").distinct().withColumn("asked", F.lit(True))
        named = asked.select("request_id").distinct().withColumn("named", F.lit(True))
        rows = rows.join(named, "request_id", "left").join(asked, ["request_id", "package"], "left") \
            .where(F.col("named").isNull() | F.col("asked").isNotNull()).drop("named", "asked")
    if nearest is not None:
        rows = rows.join(nearest.select("request_id", "package", "distance"), ["request_id", "package"], "left")
    return rows


def blend_distance(rows: DataFrame, k: int = 10) -> DataFrame:
    """order by round(rank/2), then downloads div coalesce(distance, 5) desc."""
    r = rows.withColumn("score1", F.round(F.col("rank") / 2).cast("bigint")) \
        .withColumn("score2", F.expr("recent_downloads div coalesce(distance, 5)"))
    return top_k(r, k, ["score1", F.desc("score2"), "id"])


def blend_report(rows: DataFrame, k: int = 10) -> DataFrame:
    """report round(rank/2) and downloads div 2,000,000 * coalesce(distance, 1); order by rank."""
    r = rows.withColumn("score1", F.round(F.col("rank") / 2).cast("bigint")) \
        .withColumn("score2", F.expr("(recent_downloads div 2000000) * coalesce(distance, 1)"))
    return top_k(r, k, ["rank", "id"])


def blend_downloads(rows: DataFrame, rank_div: float, downloads_div: int, k: int) -> DataFrame:
    """Order by rank / rank_div - downloads div downloads_div."""
    score = F.col("rank") / rank_div - F.expr(f"recent_downloads div {int(downloads_div)}")
    return top_k(rows.withColumn("score", score), k, ["score", "id"])


def neighbour_first(rows: DataFrame, walked: DataFrame, k: int = 10) -> DataFrame:
    """``(request_id, id, title, rank)``: the best ``k`` among the packages that a walk reaches, united with the best ``k`` of all.
    ``walked(request_id, package, distance)`` may reach a package at several distances: a document of it then fills as many
    of the first ``k`` places, as the limit comes after the join."""
    near = top_k(rows.join(walked.select("request_id", "package", "distance"), ["request_id", "package"]), k, ["rank", "id", "distance"])
    cols = ["request_id", "id", "title", "rank"]
    return near.select(*cols).union(top_k(rows, k, ["rank", "id"]).select(*cols)).distinct()
