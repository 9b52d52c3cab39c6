"""Compare a Spark result with a DuckDB result as unordered rows."""

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{0.0 if v == 0 else v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e8 else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


def diff(df, con, sql):
    """None when equal, else a short description."""
    rel = con.execute(sql)
    dcols = [c[0] for c in rel.description]
    dnames, dk = rows(dcols, rel.fetchall())
    data = [tuple(r) for r in df.collect()]
    snames, sp = rows(df.columns, data)
    if dnames != snames:
        return f"columns {snames} vs {dnames}"
    if dk != sp:
        only_s, only_d = sp - dk, dk - sp
        return f"{snames}: rows {sum(sp.values())} vs {sum(dk.values())}; spark {list(only_s)[:3]} duckdb {list(only_d)[:3]}"
    if not sp:
        return "both empty"
    return None
