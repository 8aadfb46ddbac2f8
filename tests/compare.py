"""Cell-by-cell comparison of a query with its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def difference(df, con, sql: str, tolerance: float = 1e-9) -> str:
    """Empty if the query's rows are those of the SQL."""
    rel = con.sql(sql)
    want_cols, got_cols = rel.columns, df.columns
    if sorted(want_cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} are not {sorted(want_cols)}"
    want, got = rows(want_cols, rel.fetchall()), rows(got_cols, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows, not {len(want)}"
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= tolerance * max(1.0, abs(y))):
                return f"{a} is not {b}"
    return ""
