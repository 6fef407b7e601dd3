def test_entry_and_registry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.columns == ["flow_id", "route", "section", "ts", "line_id", "line"]
    assert df.count() > 0
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
