"""Compare queries with their SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (int, float, Decimal)):
        return float(value)
    return str(value)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    order = [c[0] for c in cursor.description]
    if sorted(order) != names:
        return f"columns {names} vs {sorted(order)}"
    at = [order.index(n) for n in names]
    want = Counter(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())
    got = Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())
    if got == want:
        return None
    more, less = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"rows {sum(got.values())} vs {sum(want.values())}; extra {more}; missing {less}"
