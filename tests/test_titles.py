from pyspark.sql import functions as F

from folio.functions import titles as T


def _one(spark, expr, **vals):
    df = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} string" for k in vals))
    return df.select(expr).first()[0]


def test_index_title_rules(spark):
    cases = [
        ("function", "Ecto.Query.put_query_prefix/2", "put_query_prefix/2"),
        ("callback", "Nested transactions - Ecto.Repo.transaction/2", "Nested transactions"),
        ("module", "Ecto.Query", "Ecto.Query"),
        ("module", "Query - Ecto", "Query"),
        ("extras", "A - B - C", "AB"),
        ("task", "mix phx.gen", "mix phx.gen"),
        ("task", "Mix.Tasks.Phx.GenAuth", "Mix.Tasks.Phx.GenAuth"),
        ("nonsense", "x", None),
    ]
    for type_, title, want in cases:
        got = _one(spark, T.index_title(F.col("type"), F.col("title")), type=type_, title=title)
        assert got == want, (type_, title, got)


def test_task_titles(spark):
    cases = [("mix phx.gen", "mix phx gen"), ("Mix.Tasks.Phx.GenAuth", "phx gen_auth"),
             ("Mix.Tasks.Ecto.Gen.Repo", "ecto gen repo"), ("Mix.Tasks.HTTPServer", "http_server"),
             ("Build - Mix.Tasks.Compile", "Build"), ("something else", None)]
    for title, want in cases:
        assert _one(spark, T.task_title(F.col("title")), title=title) == want, title


def test_type_boost(spark):
    cases = [("module", "Ecto.Query", 0.2), ("module", "Query - Ecto", 0.1), ("function", "a/1", 0.3),
             ("callback", "a b", 0.1), ("task", "mix x", 0.1), ("extras", "Guide", 0.0)]
    for type_, title, want in cases:
        got = _one(spark, T.type_boost(F.col("type"), F.col("title")), type=type_, title=title)
        assert abs(got - want) < 1e-12
