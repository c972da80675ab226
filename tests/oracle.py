"""Rows of a query and of its SQL in DuckDB, comparable."""

from __future__ import annotations

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5)
    if isinstance(x, list):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x).tz_localize(None))
    return x


def rows(dicts, columns):
    return sorted(str([plain(d[c]) for c in sorted(columns)]) for d in dicts)


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return found.columns, [dict(zip(found.columns, r)) for r in found.fetchall()]
