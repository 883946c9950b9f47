"""Compare a query's rows with DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(float(v) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in data]
    return sorted((tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in flat), key=repr)


def same(df, sql, con):
    q = con.execute(sql)
    want = rows([x[0] for x in q.description], q.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in q.description)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
