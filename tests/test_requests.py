from folio.operators import requests as R

CANONICAL = [
    ("a b", '"b" OR "a"'), ("+a +b", '"b" AND "a"'), ("a b +c", '("b" OR "a") AND "c"'),
    ("a -b -c", '("a")  NOT "c" NOT "b"'), ("a +b -c", '("a") AND "b" NOT "c"'), ("+a -b", '"a" NOT "b"'),
    ("-a", ""), ("", ""), ("+", ""), ("tra*", '"tra"*'), ("t*a", '"ta"'), ("title:tra*", 'title:"tra"*'),
    ("x:y", '"x:y"'), ('say"hi', '"say""hi"'), ("  a   b ", '"b" OR "a"'),
]


def test_canonical_expressions(spark):
    reqs = R.requests_frame(spark, [(i, q, "p") for i, (q, _) in enumerate(CANONICAL)])
    got = {r.request_id: r.expression for r in R.canonical_query(reqs).collect()}
    for i, (q, want) in enumerate(CANONICAL):
        assert got[i] == want, (q, got[i])


def test_validity(spark):
    rows = [(1, "a", "p"), (2, "-a", "p"), (3, "+", "p"), (4, "*", "p"), (5, "title:", "p"),
            (6, "a -", "p"), (7, "title:doc:a", "p"), (8, "doc:a", "p"), (9, None, "p"), (10, "+ a", "p")]
    reqs = R.requests_frame(spark, rows)
    search_ok = {r.request_id: r.valid for r in R.request_meta(reqs).collect()}
    assert [search_ok[i] for i in range(1, 11)] == [True, False, False, False, False, False, False, True,
                                                    False, False]
    auto_ok = {r.request_id: r.valid for r in R.request_meta(reqs, allowed_fields=("title",)).collect()}
    assert auto_ok[8] is False and auto_ok[1] is True


def test_request_packages_keep_order_and_duplicates(spark):
    reqs = R.requests_frame(spark, [(1, "a", "x,y,x"), (2, "a", None)])
    got = sorted((r.request_id, r.package_pos, r.package) for r in R.request_packages(reqs).collect())
    assert got == [(1, 0, "x"), (1, 1, "y"), (1, 2, "x")]


def test_newline_in_a_segment(spark):
    reqs = R.requests_frame(spark, [(1, "alpha\nbeta", "p"), (2, "title:a\nb +c", "p")])
    got = {r.request_id: r.expression for r in R.canonical_query(reqs).collect()}
    assert got == {1: '"alpha\nbeta"', 2: '(title:"a\nb") AND "c"'}
    assert all(r.valid for r in R.request_meta(reqs).collect())


def test_workload_draws_distinct_entries(spark):
    words = spark.createDataFrame([(w,) for w in "abcdefg"], "term string")
    names = spark.createDataFrame([(w,) for w in "wxyz"], "package string")
    rows = R.random_workload(words, names, 300).collect()
    assert len(rows) == 300
    sizes = set()
    for r in rows:
        q, p = r.q.split(" "), r.packages.split(",")
        assert len(set(q)) == len(q) <= 3 and len(set(p)) == len(p) <= 4
        sizes.add((len(q), len(p)))
    assert len(sizes) == 12


def test_fold_matches_fts5(spark):
    import sqlite3

    from pyspark.sql import functions as F

    from folio.functions.text import MARKS, word_tokens
    texts = ["Café tiếng việt ǖ Ünï", "cafe" + MARKS[0] + "s", "naïve ſtraße æøł", "x" + "y".join(MARKS) + "z"]
    texts += ["a" + chr(c) + "b" for lo, hi in ((0xC0, 0x24F), (0x1E00, 0x1EFF)) for c in range(lo, hi + 1)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(x, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab('f', 'instance')")
    con.executemany("insert into f(rowid, x) values (?, ?)", list(enumerate(texts)))
    want = {}
    for term, doc in con.execute("select term, doc from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, x string").select("id", word_tokens(F.col("x")).alias("t"))
    assert {r.id: r.t for r in df.collect()} == want
