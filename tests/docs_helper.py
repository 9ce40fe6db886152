SF_SMALL = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    """rows: (id, package, type, title, doc) -> docs DataFrame with ref."""
    return spark.createDataFrame(
        [(i, p, f"{p}.html#{i}", t, ti, d) for i, p, t, ti, d in rows],
        "id bigint, package string, ref string, type string, title string, doc string")
