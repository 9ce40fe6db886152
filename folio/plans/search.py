"""Batch search and autocomplete (F12, F13 with K9-K11, F1-F3, B7, B8).

Both take a requests table and answer all of it in one Spark job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.titles import type_boost
from folio.operators.analysis import indexable
from folio.operators.excerpt import excerpts
from folio.operators.match import match_documents, substring_matches
from folio.operators.requests import clauses, request_meta, request_packages
from folio.session import BROADCAST_ROW_LIMIT, cut_lineage

SEARCH_HITS_PER_PACKAGE = 25
AUTOCOMPLETE_HITS_PER_PACKAGE = 3


def request_blocks(requests: DataFrame) -> list[DataFrame]:
    """The batch in blocks whose request-derived tables are small enough to broadcast.

    One small job bounds them: a clause token needs at least one character of ``q``, so a
    request makes at most (chars + 1) x (packages + 1) rows. A batch under the limit is one block."""
    dtype = requests.schema["packages"].dataType.typeName()
    packages = F.col("packages") if dtype == "array" else F.split("packages", ",", -1)
    size = (F.char_length(F.coalesce("q", F.lit(""))) + 1) * (F.coalesce(F.size(packages), F.lit(0)) + 1)
    bound = requests.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    n = -(-bound // BROADCAST_ROW_LIMIT)
    return [requests] if n <= 1 else [requests.where(F.pmod(F.xxhash64("request_id"), F.lit(n)) == i) for i in range(n)]


def restrict_packages(packages: DataFrame, *tables: DataFrame | None) -> list[DataFrame | None]:
    """The tables' rows of the packages asked for. On ``package``-partitioned tables this broadcast semi-join
    is a dynamic partition filter: only those folders are read."""
    asked = F.broadcast(packages.select("package").where("package <> ''").distinct())  # request-sized, see request_blocks
    return [None if t is None else t.join(asked, "package", "left_semi") for t in tables]


def base_rank(matches: DataFrame) -> DataFrame:
    """F1: 2.0 when any matched phrase instance is in the title, else 1.0."""
    return matches.withColumn("base_rank", F.when(F.col("title_hit"), 2.0).otherwise(1.0))


def top_per_package(ranked: DataFrame, k: int, order: list) -> DataFrame:
    """First ``k`` per (request, package position); becomes a WindowGroupLimit
    with a partial limit before the shuffle."""
    w = Window.partitionBy("request_id", "package_pos").orderBy(*order)
    return ranked.withColumn("pkg_rank", F.row_number().over(w)).where(F.col("pkg_rank") <= k) \
        .withColumn("pkg_rank", F.col("pkg_rank").cast("bigint"))


def search(requests: DataFrame, docs: DataFrame, postings: DataFrame, stem: bool = False,
           k: int = SEARCH_HITS_PER_PACKAGE, terms: DataFrame | None = None,
           vocab: DataFrame | None = None) -> DataFrame:
    """``(request_id, result_pos, package_pos, package, id, ref, type, title,
    base_rank, boost, rank)`` ordered per request by final rank (stable over
    package order and per-package rank)."""
    return reduce(DataFrame.unionByName, [
        _search_block(block, docs, postings, stem, k, terms, vocab) for block in request_blocks(requests)])


def _search_block(requests, docs, postings, stem, k, terms, vocab) -> DataFrame:
    c = clauses(requests)
    meta = request_meta(requests, c)
    rp = request_packages(requests)
    postings, terms, docs, vocab = restrict_packages(rp, postings, terms, docs, vocab)
    matches = base_rank(match_documents(postings, c, rp, meta, stem, terms, True, vocab))
    top = top_per_package(matches, k, [F.desc("base_rank"), "id"])
    d = docs.select(F.col("package").alias("d_package"), F.col("id").alias("d_id"), "ref", "type", "title")
    joined = top.join(d, (top["package"] == d["d_package"]) & (top["id"] == d["d_id"]))
    boosted = joined.withColumn("boost", type_boost(F.col("type"), F.col("title"))) \
        .withColumn("rank", F.col("base_rank") + F.col("boost"))
    w = Window.partitionBy("request_id").orderBy(F.desc("rank"), "package_pos", "pkg_rank")
    return boosted.select(
        "request_id", F.row_number().over(w).cast("bigint").alias("result_pos"), "package_pos",
        "package", "id", "ref", "type", "title", "base_rank", "boost", "rank", "pkg_rank")


def autocomplete(requests: DataFrame, docs: DataFrame, k: int = AUTOCOMPLETE_HITS_PER_PACKAGE,
                 glue: str = "", titles: DataFrame | None = None, tri_index: DataFrame | None = None,
                 tri_counts: DataFrame | None = None) -> DataFrame:
    """first ``k`` title matches per package in id order, packages in request
    order: ``(request_id, result_pos, package_pos, package, id, title, ref, type)``."""
    titles = titles if titles is not None else indexable(docs, glue)
    return reduce(DataFrame.unionByName, [
        _autocomplete_block(block, docs, k, titles, tri_index, tri_counts) for block in request_blocks(requests)])


def _autocomplete_block(requests, docs, k, titles, tri_index, tri_counts) -> DataFrame:
    c = clauses(requests)
    meta = request_meta(requests, c, allowed_fields=("title",))
    rp = request_packages(requests)
    titles, tri_index, docs, tri_counts = restrict_packages(rp, titles, tri_index, docs, tri_counts)
    matches = substring_matches(titles, c, rp, meta, tri_index=tri_index, small=True, tri_counts=tri_counts)
    top = top_per_package(matches, k, ["id"])
    d = docs.select(F.col("package").alias("d_package"), F.col("id").alias("d_id"), "title", "ref", "type")
    joined = top.join(d, (top["package"] == d["d_package"]) & (top["id"] == d["d_id"]))
    w = Window.partitionBy("request_id").orderBy("package_pos", "pkg_rank")
    return joined.select("request_id", F.row_number().over(w).cast("bigint").alias("result_pos"),
                         "package_pos", "package", "id", "title", "ref", "type")


def to_json_response(results: DataFrame, fields: list[str]) -> DataFrame:
    """``(request_id, body)`` with body = ``{"results":[...]}`` in result order."""
    items = F.array_sort(F.collect_list(F.struct("result_pos", *fields)))
    return results.groupBy("request_id").agg(
        F.to_json(F.struct(F.transform(items, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
                           .alias("results"))).alias("body"))


def request_phrases(requests: DataFrame, stem: bool = False) -> DataFrame:
    """``(request_id, phrases)``: tokenised non-absent clauses that can hit the body, for the excerpt. Their order
    changes no excerpt, so they are sorted: requests of the same words share their excerpts."""
    from folio.functions.text import word_tokens

    c = clauses(requests)
    toks = word_tokens(F.col("text"))
    if stem:
        from folio.functions.porter import stem_tokens
        toks = stem_tokens(toks)
    ph = c.where((F.col("kind") != "absent") & (F.col("field").isNull() | (F.col("field") == "doc")))
    ph = ph.select("request_id", F.struct(toks.alias("tokens"), "is_prefix").alias("p"))
    return ph.groupBy("request_id").agg(F.array_sort(F.collect_list("p")).alias("phrases"))


def with_excerpts(results: DataFrame, requests: DataFrame, docs: DataFrame, postings: DataFrame, stem: bool = False,
                  n: int = 20, vocab: DataFrame | None = None) -> DataFrame:
    """Add ``excerpts`` (one highlighted excerpt, as in the reference's
    result map) to search results; computed only for the rows returned, from ``postings`` with the same words.

    An excerpt depends only on the body and the phrases, so it is computed
    once per distinct (document, phrases) of the batch and joined back. The
    results are written once, as both sides of that join read them.
    """
    r = cut_lineage(results.join(request_phrases(requests, stem), "request_id", "left"))
    keys = r.select("package", "id", "phrases").distinct()
    ex = excerpts(keys, *restrict_packages(r.select("package"), postings, docs, vocab), n)
    ex = ex.select(F.col("package").alias("k_package"), F.col("id").alias("k_id"), F.col("phrases").alias("k_phrases"),
                   F.array("excerpt").alias("excerpts"))
    cond = ((F.col("package") == F.col("k_package")) & (F.col("id") == F.col("k_id"))
            & F.col("phrases").eqNullSafe(F.col("k_phrases")))
    return r.join(ex, cond).drop("k_package", "k_id", "k_phrases", "phrases")
