"""Run a query and its oracle on one folder and list the differences."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# DuckDB type names that a Spark type may meet
ALIKE = {
    "boolean": {"BOOLEAN"},
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, float) else round(v, 5)) for v in row)


def same(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return a == b


def differences(df, con, sql: str, tolerance: float = 0.0) -> list[str]:
    result = con.sql(sql)
    types = dict(zip(result.columns, [str(t) for t in result.types], strict=True))
    found = []
    names = sorted(df.columns)
    if names != sorted(types):
        return [f"columns {names} against {sorted(types)}"]
    for name, kind in df.dtypes:
        if types[name] not in ALIKE[kind]:
            found.append(f"type of {name}: {kind} against {types[name]}")
    ours = sorted((tuple(row[n] for n in names) for row in df.collect()), key=_key)
    place = {n: i for i, n in enumerate(result.columns)}
    theirs = sorted((tuple(row[place[n]] for n in names) for row in result.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return [*found, f"{len(ours)} rows against {len(theirs)}"]
    for left, right in zip(ours, theirs, strict=True):
        if not all(same(a, b, tolerance) for a, b in zip(left, right, strict=True)):
            found.append(f"{dict(zip(names, left, strict=True))} against {right}")
    return found
