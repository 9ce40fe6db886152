import tempfile

import pytest
from pyspark.sql import functions as F

from docs_helper import docs_frame
from folio.operators import analysis as A
from folio.operators import requests as R
from folio.plans import index as IX
from folio.plans.search import autocomplete, search


def _rows():
    return [(i, f"p{i % 3}", "function", f"Mod.fun_{i}/1", f"alpha beta {i} gamma. delta alpha") for i in range(1, 40)]


def test_build_is_idempotent_and_matches_on_the_fly(spark):
    d = docs_frame(spark, _rows())
    path = tempfile.mkdtemp(prefix="folio-ix-test-")
    IX.build_search_index(d, path)
    first = IX.read_index(spark, path).groupBy("package").count().collect()
    IX.build_search_index(d, path)
    assert sorted(first) == sorted(IX.read_index(spark, path).groupBy("package").count().collect())
    reqs = R.requests_frame(spark, [(1, "alpha", "p1,p2"), (2, "fun*", "p0"), (3, "beta_1", "p1"),
                                    (4, "gam* -del*", "p0,p2"), (5, "alpha_be*", "p1"), (6, "title:fu*", "p2")])
    on_the_fly = search(reqs, d, A.postings(d), terms=A.term_docs(d))
    indexed = search(reqs, IX.read_index(spark, path, "docs"), IX.read_index(spark, path),
                     terms=IX.read_index(spark, path, "terms"))
    cols = ["request_id", "result_pos", "id", "rank"]
    assert sorted(on_the_fly.select(*cols).collect()) == sorted(indexed.select(*cols).collect())
    with_vocab = search(reqs, IX.read_index(spark, path, "docs"), IX.read_index(spark, path),
                        terms=IX.read_index(spark, path, "terms"), vocab=IX.read_index(spark, path, "vocab"))
    assert sorted(on_the_fly.select(*cols).collect()) == sorted(with_vocab.select(*cols).collect())
    IX.build_title_index(d, path)
    ac1 = autocomplete(reqs, d).select("request_id", "result_pos", "id").collect()
    ac2 = autocomplete(reqs, IX.read_index(spark, path, "docs"), titles=IX.read_index(spark, path, "titles"),
                       tri_index=IX.read_index(spark, path, "trigrams")).select("request_id", "result_pos", "id").collect()
    assert sorted(ac1) == sorted(ac2)
    assert IX.read_index(spark, path, packages=["p1"]).select("package").distinct().collect()[0][0] == "p1"


def test_batch_split_invariance(spark):
    d = docs_frame(spark, _rows())
    rows = [(1, "alpha", "p1,p2"), (2, "gamma -beta", "p0"), (3, "+delta fun*", "p0,p1")]
    p, t = A.postings(d), A.term_docs(d)
    whole = search(R.requests_frame(spark, rows), d, p, terms=t).select("request_id", "result_pos", "id")
    parts = [search(R.requests_frame(spark, [r]), d, p, terms=t).select("request_id", "result_pos", "id")
             for r in rows]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    assert sorted(whole.collect()) == sorted(union.collect())


def test_rebuild_with_fewer_packages_and_quarantine(spark):
    rows = _rows() + [(100, "p9", "widget", "X", "alpha"), (101, "p9", None, "X", "alpha"), (102, "p9", "module", None, "alpha")]
    d = docs_frame(spark, rows)
    path = tempfile.mkdtemp(prefix="folio-ix-test-")
    IX.build_search_index(d, path)
    assert sorted((r.id, r.reason) for r in IX.read_index(spark, path, "quarantine").collect()) == [
        (100, "unknown type"), (101, "null type"), (102, "null title")]
    assert IX.read_index(spark, path, "docs").count() == len(_rows())
    IX.build_search_index(d, path, packages=spark.createDataFrame([("p1",)], "name string"))
    for table in ("postings", "terms", "vocab", "lengths", "docs"):
        assert {r.package for r in IX.read_index(spark, path, table).select("package").distinct().collect()} == {"p1"}


def test_derived_tables(spark):
    d = docs_frame(spark, [(1, "p", "module", "Alpha", "beta beta alpha"), (2, "p", "module", "X", ""), (3, "p", "module", "!", "!")])
    path = tempfile.mkdtemp(prefix="folio-ix-test-")
    IX.build_search_index(d, path)
    read = lambda t, *c: sorted(tuple(r) for r in IX.read_index(spark, path, t).select(*c).collect())
    assert read("terms", "id", "col", "term", "tf") == [(1, 0, "alpha", 1), (1, 1, "alpha", 1), (1, 1, "beta", 2), (2, 0, "x", 1)]
    assert read("lengths", "id", "dl") == [(1, 4), (2, 1), (3, 0)]
    assert read("vocab", "term", "docs") == [("alpha", 2), ("beta", 1), ("x", 1)]


def test_update_is_a_rebuild_and_cuts_only_what_changed(spark):
    rows = [(i, f"p{i % 3}", "function", f"Mod.fun_{i}/1", f"alpha beta {i} gamma. delta alpha") for i in range(1, 201)]
    path, again = (tempfile.mkdtemp(prefix="folio-ix-test-") for _ in range(2))
    IX.build_search_index(docs_frame(spark, rows), path)
    IX.build_title_index(docs_frame(spark, rows), path)
    now = [(1, "p1", "function", "Mod.other/2", "changed body alpha"), *rows[1:199], (300, "p4", "module", "New", "new alpha"),
           (301, "p4", "widget", "Bad", "x")]
    d = docs_frame(spark, now)
    assert IX.update_index(d, path) == {"new": 2, "changed": 1, "gone": 1}
    assert IX.update_index(d, path) == {"new": 0, "changed": 0, "gone": 0}
    IX.build_search_index(d, again)
    IX.build_title_index(d, again)
    tables = ["postings", "terms", "vocab", "lengths", "docs", "quarantine", "digests", "titles", "trigrams"]

    def state(where):
        return {t: sorted(map(str, IX.read_index(spark, where, t).select(*sorted(IX.read_index(spark, where, t).columns)).collect())) for t in tables}

    want = state(again)
    assert state(path) == want
    versions = [c["version"] for c in IX._commits(spark, path) if c["table"] == "postings"]
    assert len(versions) == 2
    delta = spark.read.parquet(f"{path}/postings/{versions[1]}")
    assert {r.id for r in delta.select("id").distinct().collect()} == {1, 300}
    gone = IX.compact_index(spark, path)
    assert any(versions[0] in g for g in gone) and state(path) == want
    # An upsert takes nothing away, and brings back what a tombstone named.
    assert IX.update_index(docs_frame(spark, [rows[199], rows[0]]), path, whole=False) == {"new": 1, "changed": 1, "gone": 0}
    back = docs_frame(spark, [rows[0], *now[1:], rows[199]])
    IX.build_search_index(back, again)
    IX.build_title_index(back, again)
    assert state(path) == state(again)


def test_two_builds_of_one_turn(spark):
    path = tempfile.mkdtemp(prefix="folio-ix-test-")
    IX.build_search_index(docs_frame(spark, _rows()), path)
    open(f"{path}/turns/2", "w").close()
    with pytest.raises(RuntimeError, match="turn 2"):
        IX.build_title_index(docs_frame(spark, _rows()), path)


def test_terms_are_counted_from_postings_dealt_by_range(spark, tmp_path):
    from folio.plans import index as IX

    rows = [("p", 1, "r", "function", "a b a", "x y x"), ("p", 1, "r", "function", "a", "x"), ("q", None, "r", "function", "a", None)]
    docs = spark.createDataFrame(rows, "package string, id bigint, ref string, type string, title string, doc string")
    IX.build_search_index(docs, str(tmp_path / "index"))
    terms = IX.read_index(spark, str(tmp_path / "index"), "terms")
    found = IX.read_index(spark, str(tmp_path / "index")).groupBy("package", "id", "col", "term").count()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, terms.select("package", "id", "col", "term", "tf").collect())) == sorted(map(key, found.collect()))
    build = IX._Build(spark, str(tmp_path / "one"))
    build.write("terms", found.repartitionByRange("package", "term", "id"), ["package", "term", "id"], dealt=True)
    assert spark.read.parquet(f"{tmp_path}/one/terms").count() == terms.count()


def test_a_build_lets_go_of_its_shuffle_files(spark, tmp_path):
    import time

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f and f.endswith(".data")}

    before, build = shuffled(), IX._Build(spark, str(tmp_path))
    rows = spark.range(5000).selectExpr("'p' AS package", "id")
    build.write("digests", rows, ["package", "id"], None)
    first = shuffled() - before
    build.write("lengths", rows, ["package", "id"], None)
    until = time.time() + 20
    while first & shuffled() and time.time() < until:
        time.sleep(0.2)
    assert not first & shuffled()
