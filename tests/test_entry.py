import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 60


def test_a_query_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("pages", "events", "customer", "nation", "region", "documents", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("domain_formats", "p1_catalogue_key", "e3_failure_streaks", "a5_format_breakdown", "x3_page_links"):
        df = entry.queries()[name](spark, sf)
        columns = ", ".join(f'"{x}"' for x in sorted(df.columns))
        want = c.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
        got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
