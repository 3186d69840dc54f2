"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str):
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def difference(df, connection, sql: str) -> str | None:
    """None if rows, columns and kinds of types agree, else what differs."""
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    names = sorted(df.columns)
    if names != sorted(columns):
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(c) for c in names]
    want = sorted((tuple(row[i] for i in order) for row in expected), key=repr)
    got = sorted((tuple(row[c] for c in names) for row in df.collect()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for mine, theirs in zip(got, want):
        if repr(mine) != repr(theirs):
            return f"{mine!r}\nagainst\n{theirs!r}"
    return None
