"""Boolean text matching of request clauses against postings.

Plan shape (per batch of requests):

    clause tokens x request packages   (request-sized -> size-checked broadcast)
      join postings on (package, term)  (exact tokens; postings stream, no shuffle on term)
      join postings on package + startswith(term, token)  (prefix tokens)
    -> phrase instances: single-token clauses directly; multi-token clauses
       grouped by (request, clause, id, col, pos - token_index)
    -> one aggregate per (request, package_pos, id): required clauses hit,
       any optional hit, any absent hit, any title hit
    -> keep rows satisfying required AND (some optional) AND NOT absent.

Hot terms never shuffle on ``term``: the clause side is broadcast and the
aggregates are keyed by document id, with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import word_tokens
from folio.operators.analysis import DOC_COL, TITLE_COL
from folio.session import small_side


def clause_tokens(clause_df: DataFrame, stem: bool = False) -> DataFrame:
    """Tokens of every clause: ``(request_id, clause_no, kind, field_col, n_tokens,
    tok_idx, token, is_prefix_tok)``. Zero-token clauses keep one row with a null
    token so they still count (E10)."""
    toks = word_tokens(F.col("text"))
    if stem:
        from folio.functions.porter import stem_tokens
        toks = stem_tokens(toks)
    field_col = (F.when(F.col("field") == "title", F.lit(TITLE_COL))
                 .when(F.col("field") == "doc", F.lit(DOC_COL)))
    c = clause_df.select("request_id", "clause_no", "kind", field_col.alias("field_col"),
                         "is_prefix", toks.alias("tokens"))
    c = c.withColumn("n_tokens", F.size("tokens").cast("bigint"))
    return c.select("request_id", "clause_no", "kind", "field_col", "n_tokens",
                    F.posexplode_outer("tokens").alias("tok_idx", "token"), "is_prefix") \
        .select("request_id", "clause_no", "kind", "field_col", "n_tokens",
                F.col("tok_idx").cast("bigint").alias("tok_idx"), "token",
                (F.col("is_prefix") & (F.col("tok_idx") == F.col("n_tokens") - 1)).alias("is_prefix_tok"))


def phrase_instances(postings: DataFrame, ctp: DataFrame, terms: DataFrame | None = None,
                     small: bool | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """Phrase instances ``(request_id, package_pos, package, clause_no, kind, id, col, f)``, ``f`` of them a row.

    ``ctp`` = clause tokens joined with request packages (has ``package_pos``,
    ``package``); it is broadcast when its size is proven small. Single-word
    clauses are matched against the document-level table ``terms`` when given
    (one row per distinct term of a column instead of one per occurrence);
    phrases need the positional ``postings``. With a per-package vocabulary
    ``vocab(package, term)``, prefix tokens are first expanded against it (a
    table far smaller than the postings) and then equi-joined like exact ones.
    """
    side = ctp.where(F.col("token").isNotNull()).select(
        "request_id", "package_pos", F.col("package").alias("c_package"), "clause_no", "kind",
        "field_col", "n_tokens", "tok_idx", "token", "is_prefix_tok")
    keys = ["request_id", "package_pos", "package", "clause_no", "kind", "id", "col"]
    col_ok = F.col("field_col").isNull() | (F.col("col") == F.col("field_col"))

    if vocab is not None:
        v = vocab.select(F.col("package").alias("v_package"), F.col("term").alias("v_term"))
        pre = small_side(side.where(F.col("is_prefix_tok")), small)
        expanded = (v.join(pre, (F.col("v_package") == F.col("c_package"))
                           & F.startswith(F.col("v_term"), F.col("token")))
                    .drop("v_package", "token").withColumnRenamed("v_term", "token")
                    .withColumn("is_prefix_tok", F.lit(False)))
        side = side.where(~F.col("is_prefix_tok")).unionByName(expanded.select(*side.columns))
        # The expansion grows with the vocabulary, not only with the requests:
        # its size is counted before it is broadcast.
        side = small_side(side, None)
    else:
        side = small_side(side, small)

    def joined(table: DataFrame, clauses: DataFrame) -> DataFrame:
        exact = table.join(clauses.where(~F.col("is_prefix_tok")),
                           (table["package"] == F.col("c_package")) & (table["term"] == F.col("token")))
        if vocab is not None:
            return exact.where(col_ok)
        prefix = table.join(clauses.where(F.col("is_prefix_tok")),
                            (table["package"] == F.col("c_package")) & F.startswith(table["term"], F.col("token")))
        return exact.unionByName(prefix).where(col_ok)

    if terms is not None:
        single_src = terms.select("package", "id", "col", "term", F.col("tf").alias("f"))
    else:
        single_src = postings.select("package", "id", "col", "term", F.lit(1).cast("bigint").alias("f"))
    single = joined(single_src, side.where(F.col("n_tokens") == 1)).select(*keys, "f")
    p = postings.select("package", "id", "col", "pos", "term")
    hits = joined(p, side.where(F.col("n_tokens") > 1)) \
        .select(*keys, "n_tokens", (F.col("pos") - F.col("tok_idx")).alias("start"))
    multi = (hits.groupBy(*keys, "n_tokens", "start").agg(F.count(F.lit(1)).alias("k"))
             .where(F.col("k") == F.col("n_tokens")).select(*keys, F.lit(1).cast("bigint").alias("f")))
    return single.unionByName(multi)


def boolean_filter(instances: DataFrame, meta: DataFrame, small: bool | None = None) -> DataFrame:
    """Documents satisfying each request's boolean expression, with ``title_hit``."""
    agg = instances.groupBy("request_id", "package_pos", "package", "id").agg(
        F.size(F.collect_set(F.when(F.col("kind") == "required", F.col("clause_no")))).alias("req_hits"),
        F.max(F.col("kind") == "optional").alias("opt_hit"),
        F.max(F.col("kind") == "absent").alias("abs_hit"),
        F.max((F.col("col") == TITLE_COL) & (F.col("kind") != "absent")).alias("title_hit"),
    )
    m = small_side(meta.where("valid").select("request_id", "n_required", "n_optional"), small)
    return (agg.join(m, "request_id")
            .where((F.col("req_hits") == F.col("n_required"))
                   & ((F.col("n_optional") == 0) | F.col("opt_hit"))
                   & ~F.col("abs_hit"))
            .select("request_id", "package_pos", "package", "id", "title_hit"))


def match_documents(postings: DataFrame, clause_df: DataFrame, req_pk: DataFrame,
                    meta: DataFrame, stem: bool = False, terms: DataFrame | None = None,
                    small: bool | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """E1-E11 end to end: matching ``(request_id, package_pos, package, id, title_hit)``.

    ``small`` says whether the request-derived tables are proven small enough
    to broadcast (``None``: count them here)."""
    ct = clause_tokens(clause_df, stem)
    valid = meta.where("valid").select("request_id")
    ctp = ct.join(valid, "request_id", "left_semi").join(req_pk, "request_id")
    return boolean_filter(phrase_instances(postings, ctp, terms, small, vocab), meta, small)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of ``text`` (empty below 3 characters)."""
    n = F.char_length(text)
    tris = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, 3))
    return F.when(n >= 3, F.array_distinct(tris)).otherwise(F.array().cast("array<string>"))


def title_trigrams(titles: DataFrame, title_col: str = "ititle") -> DataFrame:
    """``(package, id, tri)``: the trigram index of lower-cased titles (one row per
    distinct trigram of a title; built without a shuffle)."""
    lt = titles.select("package", "id", F.lower(F.col(title_col)).alias("lt"))
    return lt.select("package", "id", F.explode(trigrams(F.col("lt"))).alias("tri"))


#: Trigrams of a needle that its candidates are looked up by, where the trigrams are counted.
RAREST = 2


def trigram_counts(tri_index: DataFrame) -> DataFrame:
    """``(package, tri, docs)``: rows that hold each trigram."""
    return tri_index.groupBy("package", "tri").agg(F.count(F.lit(1)).alias("docs"))


def trigram_candidates(tri_index: DataFrame, needles: DataFrame, keys: list[str],
                       small: bool | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Rows of ``tri_index(package, id, tri)`` holding every trigram of a needle - or, with ``counts`` (see
    ``trigram_counts``; a count may be too high, not missing), its ``RAREST`` rarest ones, which is all a
    later check with ``contains`` needs: a needle with a trigram that no row has is dropped at once, and hot
    trigrams are not joined.

    ``needles`` has ``keys`` + ``c_package`` + ``needle``; it is request-sized and
    broadcast when its size is proven small, so hot trigrams never shuffle. The
    aggregate is keyed by document id. Returns ``keys`` + ``package, id, needle``.
    """
    nt = needles.select(*keys, "c_package", "needle", F.explode(trigrams(F.col("needle"))).alias("n_tri"),
                        F.size(trigrams(F.col("needle"))).alias("n_tris"))
    if counts is not None:
        rows = counts.select(F.col("package").alias("c_package"), F.col("tri").alias("n_tri"), "docs")
        known = rows.join(small_side(nt, small), ["c_package", "n_tri"])
        w = Window.partitionBy(*keys, "c_package", "needle")
        known = known.withColumn("known", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy("docs", "n_tri")))
        nt = known.where((F.col("known") == F.col("n_tris")) & (F.col("place") <= RAREST)).select(
            *keys, "c_package", "needle", "n_tri", F.least("n_tris", F.lit(RAREST)).alias("n_tris"))
    nt = small_side(nt, small)
    j = tri_index.join(nt, (tri_index["package"] == F.col("c_package")) & (tri_index["tri"] == F.col("n_tri")))
    return (j.groupBy(*keys, "package", "id", "needle", "n_tris").agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") == F.col("n_tris")).select(*keys, "package", "id", "needle"))


def substring_matches(titles: DataFrame, clause_df: DataFrame, req_pk: DataFrame,
                      meta: DataFrame, min_chars: int = 3, tri_index: DataFrame | None = None,
                      small: bool | None = None, tri_counts: DataFrame | None = None) -> DataFrame:
    """Case-insensitive substring match of each clause on ``ititle``.

    Clauses shorter than ``min_chars`` characters never match (they contribute
    nothing when optional, block the request when required). Candidates come
    from the title trigram index (given, or derived from ``titles``) and are
    confirmed with ``contains`` on the title.
    """
    valid = meta.where("valid").select("request_id")
    cp = (clause_df.join(valid, "request_id", "left_semi").join(req_pk, "request_id")
          .where(F.char_length("text") >= min_chars)
          .select("request_id", "package_pos", F.col("package").alias("c_package"), "clause_no",
                  "kind", F.lower(F.col("text")).alias("needle")))
    tri = tri_index if tri_index is not None else title_trigrams(titles)
    keys = ["request_id", "package_pos", "clause_no", "kind"]
    cand = trigram_candidates(tri, cp, keys, small, tri_counts)
    t = titles.select(F.col("package").alias("t_package"), F.col("id").alias("t_id"),
                      F.lower(F.col("ititle")).alias("lt"))
    inst = (cand.join(t, (cand["package"] == t["t_package"]) & (cand["id"] == t["t_id"]))
            .where(F.col("lt").contains(F.col("needle")))
            .select("request_id", "package_pos", "package", "clause_no", "kind", "id",
                    F.lit(TITLE_COL).alias("col")))
    return boolean_filter(inst, meta, small)
