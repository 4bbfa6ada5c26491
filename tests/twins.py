"""Compare a Spark result with its SQL twin in DuckDB: names, types, and rows in any order."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

from echolens.plans.tables import BASE


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def canon(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.10g}")
    return x


def rows_of(table: pa.Table, names: list[str]) -> list[tuple]:
    columns = [[canon(x) for x in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)) if names else []


def arrow_of(df) -> pa.Table:
    return df.toArrow()


def differences(df, con, sql: str) -> list[str]:
    left, right = arrow_of(df), con.execute(sql).to_arrow_table()
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return [f"columns {names} != {sorted(right.column_names)}"]
    out = [
        f"type of {n}: {left.schema.field(n).type} != {right.schema.field(n).type}"
        for n in names if kind(left.schema.field(n).type) != kind(right.schema.field(n).type)
    ]
    a, b = rows_of(left, names), rows_of(right, names)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        for x, y in bad:
            out.append("values " + ", ".join(f"{n}: {str(u)[:120]!r} != {str(v)[:120]!r}" for n, u, v in zip(names, x, y) if u != v))
    return out
