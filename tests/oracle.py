"""Compares a query with its SQL, as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(r[i] for i in order) for r in found]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def assert_same(df, db, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    if got[1]:
        assert [type(x) for x in got[1][0]] == [type(x) for x in want[1][0]]
