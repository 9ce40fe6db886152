import corpus_pipeline as C
from llm_helpers import frame, prose
from test_decontam import brute as brute_hits
from test_line_dedup import brute as brute_lines
from test_packing import check
from test_simhash import brute_components

from folio.llm import quality

SF = "/root/testdata/sf0.001"


def step(spark, docs, name, tmp_path):
    out = dict(C.STAGES)[name](spark, docs, SF)
    out.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    one = step(spark, docs, "quality_filter", tmp_path)
    rows = docs.collect()
    keep = {r.doc_id for r in rows if model.score(__import__("numpy").array([quality.statistics(r.text)]))[0] >= .7}
    assert sorted(one.collect()) == sorted(r for r in rows if r.doc_id in keep) and 0 < len(keep) < len(rows)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & keep) > .97 * len(good) and len(bad & keep) < .3 * len(bad)

    two = step(spark, one, "line_dedup", tmp_path)
    assert two.columns == docs.columns
    want = {r[0]: r for r in brute_lines([(r.doc_id, r.text) for r in one.collect()])}
    before = {r.doc_id: r for r in one.collect()}
    for r in two.collect():
        assert r.text == want[r.doc_id][1] and (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        assert r.n_chars == (len(r.text) if want[r.doc_id][3] else before[r.doc_id].n_chars)
    assert two.count() == one.count()

    three = step(spark, two, "near_dedup", tmp_path)
    rows = two.collect()
    least = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in rows])}
    assert sorted(three.collect()) == sorted(r for r in rows if r.doc_id in least)

    four = step(spark, three, "decontaminate", tmp_path)
    rows = three.collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in brute_hits([(r.doc_id, r.text) for r in rows], items) if n}
    assert sorted(four.collect()) == sorted(r for r in rows if r.doc_id not in hit) and four.columns == docs.columns

    five = step(spark, four, "pack", tmp_path).collect()
    rows = [(r.doc_id, r.text) for r in four.collect()]
    sequences = check(rows, five, 1024)
    assert sequences <= 1.03 * sum(r.length for r in five) / 1024 + 2
    ran = C.run(spark, SF).collect()
    shape = lambda got: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got)
    assert shape(ran) == shape(five)


def test_odd_rows_pass_every_stage(spark, odd, empty, tmp_path):
    df, rows = odd
    for docs, folder in ((df, "odd"), (empty, "empty"), (frame(spark, [(None, None)]), "null")):
        (tmp_path / folder).mkdir()
        for k, (name, _) in enumerate(C.STAGES, 1):
            out = step(spark, docs, name, tmp_path / folder)
            if k < len(C.STAGES):
                assert out.columns == docs.columns
                docs = out
        assert folder != "empty" or out.count() == 0


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and {"op2_quality_rules", "op4_licenses", "op9_decontaminate", "op10_line_dedup"} <= set(entry.oracle_sql())


def test_oracles_on_small_tables(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            df = entry.queries()[name](spark, SF)
            got = sorted(map(tuple, df.collect()))
            assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()), name


def test_prose_is_made_alike():
    assert prose(1) == prose(1)
