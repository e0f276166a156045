"""Compare a query's rows with its SQL's on the same files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    key = lambda row: tuple((x is not None, str(type(x)) if isinstance(x, bool) else "", x if x is not None else 0) for x in row)
    return sorted((tuple(tuple(r[k]) if isinstance(r[k], list) else r[k] for k in order) for r in values), key=key)


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    theirs = rows(found.fetchall(), [d[0] for d in found.description])
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    ours = rows([tuple(r) for r in df.collect()], df.columns)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1.0, abs(x)), (a, b)
