import numpy as np

from folio.llm import quality as Q
from folio.llm.boosting import fit
from llm_helpers import frame, prose


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_flat_trees_walk_as_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    x[:, 4] = rng.integers(0, 2, 3000)
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] > 0) | (x[:, 1] > 1.5)).astype(float)
    model = fit(x, y, trees=30, depth=3)
    test = rng.normal(size=(200, 5))
    for row, p in zip(test, model.score(test), strict=True):
        margin = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > t[i] else 1)
            margin += leaf[i - len(f)]
        assert abs(p - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((model.score(x) > .5) == (y == 1)).mean() > .97


def test_constant_where_labels_cannot_tell():
    assert fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [.5, .5]
    assert abs(fit(np.ones((8, 3)), np.ones(8)).score(np.ones((1, 3)))[0] - .9) < 1e-9
    same = fit(np.ones((8, 3)), np.array([0, 1] * 4, float))
    assert abs(same.score(np.ones((1, 3)))[0] - .5) < 1e-9


def test_held_out_quality(spark):
    from folio.llm.queries import op6_quality

    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op6_quality(spark, d).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").toPandas()
    assert len(rows) > 500
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 1), (3, None), (None, 1), (9, 0), (77, 1), (4, 5)],
                                   "doc_id bigint, quality int")
    model = Q.train(df, labels)
    got = df.select("doc_id", Q.score(df.text, model).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    none = Q.train(df, labels.where("false"))
    assert Q.keep_good(df, none).collect() == df.collect()
    assert Q.keep_good(df, none).columns == df.columns
    assert Q.train(empty, labels).score(np.zeros((1, len(Q.STATISTICS))))[0] == .5
    assert Q.keep_good(empty, model).collect() == []
    assert len(Q.statistics("a\x00 b")) == len(Q.STATISTICS) == len(Q.statistics(None))


def test_sample_is_bounded_and_stable(spark):
    docs = frame(spark, [(i, prose(i, 30) if i % 3 else "| x " * 30) for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int")
    one, two = Q.train(docs, labels, max_rows=40), Q.train(docs.repartition(3), labels.repartition(2), max_rows=40)
    assert np.array_equal(one.leaf, two.leaf) and len(one.leaf)
    good = {r.doc_id for r in Q.keep_good(docs, one).collect()}
    assert good == {i for i in range(60) if i % 3}
