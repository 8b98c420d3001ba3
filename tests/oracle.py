"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def compare(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    declared = {d[0]: SPARK_TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    off = {c: (t, declared.get(c)) for c, t in df.dtypes if declared.get(c) != t}
    if off:
        return f"types (ours, SQL): {off}"
    expected = _rows(names, result.fetchall())
    if not expected:
        return "the SQL gives no rows"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    types = {type(a).__name__ + "/" + type(b).__name__ for g, e in zip(got, expected) for a, b in zip(g, e) if a is not None and b is not None and type(a) is not type(b)}
    if types:
        return f"types differ: {sorted(types)}"
    for g, e in zip(got, expected):
        if g != e:
            return f"{g} against {e}"
    return None
