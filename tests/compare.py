"""Run a query and its oracle and compare them as multisets of rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    return value


def diff(df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs oracle {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in res.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if want == got:
        return None
    more, less = list((got - want).items())[:2], list((want - got).items())[:2]
    return (f"{sum(got.values())} rows vs {sum(want.values())}; columns {order}\n"
            f"  only here: {more}\n  only oracle: {less}")
