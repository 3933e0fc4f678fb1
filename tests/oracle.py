"""Compare a query's rows with its SQL's on DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    left, right = [r for r in got[1] if r not in want[1]][:3], [r for r in want[1] if r not in got[1]][:3]
    return f"{len(got[1])} and {len(want[1])} rows; {left} and {right}"
