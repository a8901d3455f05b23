"""Compares a query with its SQL as DuckDB runs it."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    if isinstance(x, list):
        return [shown(v) for v in x]
    return round(float(x), 6) if x.__class__.__name__ in ("float", "Decimal") else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([shown(r[i]) for i in order] for r in found), key=str)


def agree(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
