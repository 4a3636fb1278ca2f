"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    return repr(float(f"{v:.9g}")) if isinstance(v, float) else repr(v)


def same_rows(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns
    assert ours == theirs
