"""Rows of a DataFrame and of an SQL engine, brought to one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "tolist"):
        x = x.tolist()
    return round(float(x), 6) if isinstance(x, (int, float)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(plain, r))) for r in frame.itertuples(index=False))


def assert_same(ours, theirs):
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
