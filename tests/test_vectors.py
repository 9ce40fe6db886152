import numpy as np
import pandas as pd
from docs_helper import SF_SMALL

from folio.plans.catalog_more import q_knn_exact_rows, q_knn_lsh


def test_searches_ask_with_every_hundredth_row(spark):
    e = pd.read_parquet(f"{SF_SMALL}/embeddings.parquet")
    m = np.stack(e["embedding"].to_numpy()).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = e.index[e["vec_id"] % 100 == 0]
    want = {int(e["vec_id"][i]): np.sort(m @ m[i])[::-1][:10] for i in asked}
    exact = q_knn_exact_rows(spark, SF_SMALL).toPandas()
    lsh = q_knn_lsh(spark, SF_SMALL).toPandas()
    assert len(want) > 1 and set(exact["query_id"]) == set(lsh["query_id"]) == set(want)
    for q, best in want.items():
        rows = exact[exact["query_id"] == q].sort_values("rk")
        assert rows["id"].iloc[0] == q and np.allclose(rows["similarity"], best, atol=1e-6)
        found = lsh[lsh["query_id"] == q]
        assert len(found) == 10 and np.allclose(found["recall"], len(set(found["id"]) & set(rows["id"])) / 10)


def test_inverted_file_finds_the_neighbours(spark):
    from folio.plans.catalog_more import q_knn_ivf

    got = q_knn_ivf(spark, "/root/testdata/sf0.01").toPandas()
    each = got.groupby("query_id").agg({"recall": "first", "candidate_share": "first", "id": "nunique"})
    assert len(each) == 5 and (each["id"] == 10).all()
    assert each["recall"].mean() >= 0.9 and each["candidate_share"].max() < 0.05


def test_inverted_file_odd_rows(spark):
    from folio.operators import ivf
    from folio.operators.vectors import knn_exact

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(200)]
    rows += [(1000, [0.0] * 5), (1001, None), (None, [1.0] * 5)]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in rows[:300:30]] + [(7, None)], "query_id bigint, query array<double>")
    index = ivf.build(corpus, k=5)
    got = ivf.search(index, queries, corpus, k=5).toPandas()
    exact = knn_exact(queries.where("query is not null"), corpus, 5).toPandas()
    met = got.merge(exact, on=["query_id", "id"])
    assert len(got) == 50 and len(met) >= 0.9 * len(exact) and np.allclose(met["similarity_x"], met["similarity_y"])
    assert sum(len(b.ids) // 8 for b in index.blocks.collect()) == 501
    empty = corpus.where("false")
    assert ivf.search(ivf.build(empty), queries, empty).count() == 0


def test_knn_exact_in_slices_of_queries(spark, monkeypatch):
    from folio.operators import vectors as V

    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 3)
    rows = [(i, [float(i % 7), float(i % 5 + 1), float(i)]) for i in range(20)]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = V.knn_exact(corpus.selectExpr("id AS query_id", "embedding AS query"), corpus, 1).collect()
    assert {(r.query_id, r.id) for r in got} == {(i, i) for i in range(20)}


def test_blocks_and_rows_of_candidates_agree(spark, monkeypatch):
    from folio.operators import vectors as V

    rng = np.random.default_rng(5)
    # Equal vectors tie by id, and some queries have few candidates.
    m = np.concatenate([rng.normal(size=(90, 6)), np.repeat(rng.normal(size=(2, 6)), 15, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in enumerate(m)]
    corpus = spark.createDataFrame(rows + [(500, None)], "id bigint, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows[::7], "query_id bigint, query array<double>")
    c, q = corpus.where("embedding is not null"), queries
    flat = lambda df: sorted((r.query_id, r.id, r.rk, r.candidates, round(r.similarity, 9)) for r in df.collect())
    want = flat(V._lsh_by_id(q, c, corpus, 4, 1, 8, 7))
    assert len({x[3] for x in want}) > 2 and any(x[3] == 120 for x in want)
    with monkeypatch.context() as p:  # no row a candidate
        p.setattr(V, "_lsh_by_id", None)
        p.setattr(V, "QUERIES_AT_ONCE", 5)
        p.setattr(V, "CORPUS_BLOCK", 11)
        assert flat(V.knn_lsh(queries, corpus, 4, bands=1, bits=8)) == want
        exact = V.knn_exact(queries, corpus, 4).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in [r[0] for r in rows[::7]]:
        s = np.einsum("ij,ij->i", unit, np.repeat(unit[i:i + 1], len(unit), axis=0))
        assert [r.id for r in sorted(exact, key=lambda r: r.rk) if r.query_id == i] == np.lexsort((np.arange(len(s)), -s))[:4].tolist()
    twice = corpus.unionByName(corpus.where("id = 3"))
    assert flat(V.knn_lsh(queries, twice, 4, bands=1, bits=8)) == flat(V._lsh_by_id(q, twice.where("embedding is not null"), twice, 4, 1, 8, 7))
