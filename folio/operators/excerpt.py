"""Highlighted excerpts from the index (B6): hits from positional postings, windows as RANGE frames.

Rules (windows of ``n`` tokens):

1. A *hit* is an instance of a query phrase in the body (a prefix phrase
   matches its last token as a prefix).
2. A window scores 1000 for each distinct phrase with a hit starting inside it
   and 1 for every further hit.
3. For every hit at token ``o`` two candidates are scored: the window starting
   at ``o`` (then re-centred on its hits: ``first - (n - (last - first)) / 2``,
   truncated, clamped to the body), and, when the body is longer than ``n``
   tokens, the window at the latest sentence start before ``o`` with a bonus of 120 at
   the body start and 100 elsewhere. The best score wins; the first one wins ties.
4. Without hits the window starts at token 0.
5. The original text between tokens is kept; overlapping hits share one
   ``<em>``; ``...`` marks a cut head or tail.

Plan: the postings of the bodies asked for meet the (request-sized) tokens of all phrases
once, whatever the number of requests; a window over each body finds the sentence of every
hit; each (phrase list, body) then has its events - hits and sentence starts - in token
order, and a frame of ``n`` tokens from each event gives the score. A body's
text and layout are read once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.excerpt import render, with_layout
from folio.operators.analysis import DOC_COL
from folio.session import bounded_broadcast, cut_lineage

BODY = ["package", "id"]
KEY = ["list", *BODY]
#: Phrases of a list that fit the bits of a number.
BITS = 63


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Distinct rows (request-sized), numbered. Written first, so that the numbers stay."""
    return cut_lineage(rows.distinct()).withColumn(name, F.monotonically_increasing_id())


def phrase_hits(phrases: DataFrame, bodies: DataFrame, postings: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``(package, id, phrase, o, k)``: every place ``o`` where a phrase of ``k`` tokens stands in one of ``bodies``.

    ``phrases``: ``(phrase, tokens, is_prefix)``, request-sized. Prefix tokens are first expanded against ``vocab(package, term)``."""
    rows = postings.where(F.col("col") == DOC_COL).select(*BODY, F.col("pos").cast("bigint").alias("pos"), "term")
    rows = rows.join(bounded_broadcast(bodies), BODY, "left_semi")
    tokens = phrases.select("phrase", "is_prefix", F.size("tokens").alias("k"), F.posexplode("tokens").alias("at", "term"))
    open_end = F.col("is_prefix") & (F.col("at") == F.col("k") - 1)
    exact, prefix = tokens.where(~open_end).drop("is_prefix"), tokens.where(open_end).drop("is_prefix")
    known = (rows if vocab is None else vocab.join(F.broadcast(bodies.select("package").distinct()), "package", "left_semi"))
    known = known.select(F.col("term").alias("full")).distinct()
    prefix = known.join(F.broadcast(prefix), F.startswith("full", F.col("term"))).drop("term").withColumnRenamed("full", "term")
    met = rows.join(bounded_broadcast(exact.unionByName(prefix)), "term").withColumn("o", F.col("pos") - F.col("at"))
    one = met.where("k = 1").select(*BODY, "phrase", "o", "k")
    more = met.where("k > 1").groupBy(*BODY, "phrase", "o", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k")
    return one.unionByName(more.select(*BODY, "phrase", "o", "k"))


def _with_sentences(hits: DataFrame, layout: DataFrame) -> DataFrame:
    """``hits`` with the latest sentence start at or before each (``f``) and the tokens of the body (``size``)."""
    starts = layout.select(*BODY, F.size("lens").alias("size"), F.explode("sentences").alias("f"))
    both = hits.select(*BODY, "o", "phrase", "k", F.lit(None).cast("struct<f:bigint,size:int>").alias("s")).unionByName(
        starts.select(*BODY, F.col("f").cast("bigint").alias("o"), F.lit(None).cast("bigint").alias("phrase"),
                      F.lit(None).cast("int").alias("k"), F.struct(F.col("f").cast("bigint").alias("f"), "size").alias("s")))
    # A sentence start comes before the hits at its token.
    before = Window.partitionBy(*BODY).orderBy("o", F.col("phrase").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("s", F.last("s", ignorenulls=True).over(before)).where("phrase is not null")
    return both.select(*BODY, "o", "phrase", "k", "s.f", "s.size")


def best_windows(events: DataFrame, n: int, wide: bool) -> DataFrame:
    """``(list, package, id, start, marked)`` from hits ``(list, package, id, p, o, k, f, size)``, ``p`` the number of the phrase in the list."""
    order = lambda c: F.struct("o", "p", "k", F.lit(c).alias("c"))
    hits = events.select(*KEY, F.col("o").alias("at"), "p", "k", "size", order(0).alias("order"))
    sentences = events.where((F.col("f") < F.col("o")) & (F.col("size") > n)).groupBy(*KEY, "f").agg(
        F.first("size").alias("size"), F.min(order(1)).alias("order"))
    sentences = sentences.select(*KEY, F.col("f").alias("at"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("k"), "size", "order")
    frame = Window.partitionBy(*KEY).orderBy("at").rangeBetween(0, n - 1)
    if wide:
        kinds = F.size(F.collect_set("p").over(frame))
    else:
        kinds = F.bit_count(F.bit_or(F.when(F.col("p").isNotNull(), F.expr("shiftleft(1L, p)"))).over(frame))
    rows = hits.unionByName(sentences).withColumns({
        "kinds": kinds, "found": F.count("p").over(frame),
        "last": F.max(F.when(F.col("p").isNotNull(), F.struct("at", "p", "k"))).over(frame)})
    score = 1000 * F.col("kinds") + F.col("found") - F.col("kinds")
    around = ((F.lit(n) - (F.col("last.at") + F.col("last.k") - F.col("at"))) / 2).cast("int")
    centred = F.greatest(F.least(F.col("at") - around, F.col("size") - n), F.lit(0))
    of_hit = F.col("p").isNotNull()
    bonus = F.when(of_hit, 0).when(F.col("at") == 0, 120).otherwise(100)
    minus = [(-F.col(f"order.{c}")).alias(c) for c in ("o", "p", "k", "c")]
    rows = rows.withColumn("choice", F.struct((score + bonus).alias("score"), *minus, F.when(of_hit, centred).otherwise(F.col("at")).alias("start")))
    # Overlapping hits are one highlight; of the sentence rows only the choice is needed.
    whole, along = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("at", "p", "k")
    rows = rows.withColumn("start", F.max("choice").over(whole)["start"]).where(of_hit).withColumn("e", F.col("at") + F.col("k") - 1)
    rows = rows.withColumn("reach", F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("reach").isNull() | (F.col("at") > F.col("reach")), 1).otherwise(0)
    rows = rows.withColumn("part", F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*KEY, "start", "part").agg(F.min("at").alias("s"), F.max("e").alias("e"))
    inside = (F.col("s") >= F.col("start")) & (F.col("s") < F.col("start") + n)
    return parts.groupBy(*KEY, "start").agg(F.collect_list(F.when(inside, F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("marked"))


def excerpts(asked: DataFrame, postings: DataFrame, docs: DataFrame, vocab: DataFrame | None = None, n: int = 20) -> DataFrame:
    """``asked`` - distinct rows ``(package, id, phrases)``, ``phrases`` an array<struct<tokens, is_prefix>> in the words of
    ``postings`` - with the ``excerpt`` of each body of ``docs (package, id, doc)``.

    A null body gives null; null phrases, no hits; a body that is not in ``docs``, no row. ``docs`` with a
    layout (see ``with_layout``), as the index has it, is not cut into tokens again.
    """
    none = F.array().cast("array<struct<tokens:array<string>,is_prefix:boolean>>")
    asked = asked.select(*BODY, "phrases", F.coalesce("phrases", none).alias("wanted"))
    lists = _numbered(asked.select("wanted"), "list")
    asked = cut_lineage(asked.join(bounded_broadcast(lists), "wanted").drop("wanted"))
    phrase = lists.select("list", F.posexplode("wanted").alias("p", "phrase")).select("list", "p", "phrase.tokens", "phrase.is_prefix")
    phrases = _numbered(phrase.where(F.size("tokens") > 0).select("tokens", "is_prefix"), "phrase")
    phrase = phrase.join(bounded_broadcast(phrases), ["tokens", "is_prefix"]).select("list", "p", "phrase")
    wide = (phrase.agg(F.max("p")).first()[0] or 0) >= BITS
    bodies = asked.select(*BODY).distinct()
    docs = with_layout(docs.join(bounded_broadcast(bodies), BODY, "left_semi"))
    hits = _with_sentences(phrase_hits(phrases, bodies, postings, vocab), docs)
    events = asked.select(*KEY).join(bounded_broadcast(phrase), "list").join(hits, [*BODY, "phrase"]).drop("phrase")
    found = best_windows(events, n, wide)
    found = asked.join(found, KEY, "left").select(
        *BODY, "phrases", F.coalesce("start", F.lit(0)).cast("int").alias("start"),
        F.coalesce("marked", F.array().cast("array<struct<s:int,e:int>>")).alias("marked"))
    out = found.join(docs.select(*BODY, "doc", "lens", "gaps"), BODY)
    return out.select(*BODY, "phrases", render("doc", F.col("start"), F.col("marked"), n).alias("excerpt"))
