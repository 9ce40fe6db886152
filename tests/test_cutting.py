import random

from pyspark.sql import functions as F

from folio.functions.excerpt import with_layout
from folio.functions.text import word_tokens
from folio.operators import cutting
from folio.operators.analysis import postings_of

ALPHABET = list("aZȩßİIΣσς .:\n\r\t x1漢😀𝒜-ſ,\0") + ["́", "̧", "̇", "٣", "\u0085", " ", " ", "", ". ", ": "]


def _docs(spark):
    draw = random.Random(5)
    text = lambda sizes: "".join(draw.choice(ALPHABET) for _ in range(draw.choice(sizes)))
    rows = [(f"p{i % 3}", i, None if i % 40 == 3 else text([0, 1, 2, 5, 30]), None if i % 50 == 7 else text([0, 1, 2, 3, 5, 9, 40, 200])) for i in range(600)]
    rows += [(None, 700, "a a", "b"), ("p", None, "c", "c\0c"), ("p1", 3, "again", "an id twice")]
    return spark.createDataFrame(rows, "package string, id bigint, title string, doc string").repartition(3)


def test_cuts_are_those_of_the_column_expressions(spark, monkeypatch):
    d = _docs(spark)
    size = lambda c: F.coalesce(F.size(word_tokens(F.col(c))), F.lit(0))
    want = with_layout(d).withColumn("dl", F.greatest(size("title"), F.lit(0)) + F.greatest(size("doc"), F.lit(0)))
    assert sorted(map(str, cutting.with_cuts(d, "title").collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(cutting, "CHARS", 50)  # many parts a batch
    assert [(p.start, p.stop) for p in cutting._parts(["a" * 30, None, "b" * 30, "c" * 99, ""])] == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_places_are_the_postings(spark):
    d = _docs(spark)
    want = postings_of(d.select("package", "id", word_tokens(F.col("title")).alias("title_tokens"), word_tokens(F.col("doc")).alias("doc_tokens")))
    for by_package in (True, False):
        found = cutting.term_places(d, "title", by_package=by_package)
        rows = found.select("package", "id", "col", F.explode("places").alias("pos"), "term")
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
        assert found.where(F.col("tf") != F.size("places")).isEmpty()


def test_title_queries_build_no_word_index(spark, monkeypatch):
    from folio.plans import catalog, index as IX

    def cut(*_args, **_options):
        raise AssertionError("bodies were cut into words")

    monkeypatch.setattr(IX, "build_search_index", cut)
    monkeypatch.setattr(catalog, "_INDEXES", {})
    for name in ("bm25_titles", "autocomplete"):
        assert not catalog.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()


def test_titles_of_late_words(spark, tmp_path):
    """Words that the head of a text does not have, or not with their ends, are found in the whole text."""
    from folio.sources import testdata as D

    blank, long = " " * 400, "a" * 400
    texts = [None, "", "..", "One two", "One two ", f"{blank}One.two", f"One{blank}two", f"{long} two", f"One {long}b!", f"{'x' * 296} ab", f"{'x' * 296} abcd"]
    want = [("x", "x")] * 3 + [("One", "two")] * 4 + [(long, "two"), ("One", f"{long}b"), ("x" * 296, "ab"), ("x" * 296, "abcd")]
    rows = [(12 * (12 * i + 5) + 1, t, "en", "src1", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.type, r.title) for r in D.docs(spark, str(tmp_path)).collect()}
    types = {got[i][0] for i, *_ in rows}
    assert len(types) == 1
    for (i, *_), (a, b) in zip(rows, want):
        assert a in got[i][1] and b in got[i][1]
        assert got[i][1] in (f"{a} {b} - src1", f"{a}.{b}", f"{a} - {b} - src1", f"{a}.{b}/{i % 4}"), got[i][1][:80]
