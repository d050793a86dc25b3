"""Rows of two engines in one form."""

import pandas as pd


def cell(x):
    if x is None:
        return None
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return str([cell(y) for y in x])
    if isinstance(x, (bool, str)):
        return str(x)
    if pd.isna(x):
        return None
    if hasattr(x, "isoformat"):
        t = pd.Timestamp(x)
        return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).isoformat()
    return f"{float(x):.9g}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def same(spark, oracle, query, sql, root):
    df = query(spark, root)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = oracle.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
