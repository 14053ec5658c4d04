"""Rows of a query against rows of its SQL."""

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def same(df, c, sql) -> None:
    there = c.execute(sql)
    names = [d[0] for d in there.description]
    assert sorted(df.columns) == sorted(names)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(there.fetchall(), names)
