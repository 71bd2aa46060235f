"""Runs a query and its SQL on the same tables and compares all rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())


def same(df, sql, sf_dir):
    names = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert (names, mine) == rows_of(sql, sf_dir)
