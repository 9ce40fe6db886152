import __spark_entry__ as entry


def test_contract(spark):
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60
    df = entry.entry(spark)
    assert df.count() > 0
