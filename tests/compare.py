"""Comparing a Spark query with its SQL on the test tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def ordered(rows, columns):
    names = sorted(columns)
    places = [list(columns).index(n) for n in names]
    lines = [tuple(plain(row[p]) for p in places) for row in rows]
    return names, sorted(lines, key=lambda line: tuple((v is not None, str(v)) for v in line))


def difference(spark_df, con, sql: str) -> str | None:
    """None where both sides hold the same columns and rows, else what differs first."""
    got_names, got = ordered([tuple(r) for r in spark_df.collect()], spark_df.columns)
    cursor = con.execute(sql)
    want_names, want = ordered(cursor.fetchall(), [d[0] for d in cursor.description])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first extra {[g for g in got if g not in want][:1]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(y) for y in b]:
            return f"row {dict(zip(got_names, a))}\n  expected {dict(zip(got_names, b))}"
    return None
