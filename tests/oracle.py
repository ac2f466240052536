"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


def difference(df, con, sql: str):
    """None when both sides agree, else a short description."""
    names = sorted(df.columns)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    theirs = _sorted([tuple(row[columns.index(n)] for n in names) for row in result.fetchall()])
    ours = _sorted([tuple(row[n] for n in names) for row in df.collect()])
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:2] if len(ours) < 20000 else ""
        return f"{len(ours)} rows against {len(theirs)}; {extra}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a!r} against {b!r}"[:1500]
    return None if ours else "empty on both sides"
