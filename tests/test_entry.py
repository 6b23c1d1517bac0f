import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "quality_level" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    assert all(isinstance(s, str) and s.strip() for s in o.values())


def test_some_queries_run(spark, sf):
    q = E.queries()
    for name in ["provenance_documents", "quota_check_users", "sql_hash_aggregate_lineitem", "route_questions"]:
        assert q[name](spark, sf).count() > 0


def test_every_oracle_sql_runs_in_duckdb(sf):
    import duckdb

    from silverline.plans.fixtures import BASE_TABLES

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute(f"select * from ({sql}) __q limit 0").fetchall()
