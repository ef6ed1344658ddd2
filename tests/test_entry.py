import __spark_entry__ as entry


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "revisions", "breadth"] and df.count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_equal_their_sql(spark, sf):
    """Every query that has SQL gives the rows of that SQL, over whole tables."""
    import os

    import duckdb
    import numpy as np

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")

    def cell(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, int | float | np.number) else str(v)

    def table(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)

    sql = entry.oracle_sql()
    different = []
    for name, query in entry.queries().items():
        if name in sql:
            df = query(spark, sf)
            answer = con.execute(sql[name])
            columns = [d[0] for d in answer.description]
            if sorted(columns) != sorted(df.columns) or table(df.columns, df.collect()) != table(columns, answer.fetchall()):
                different.append(name)
    assert not different
