"""Run a catalogue query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(
        (tuple(row[k] for k in order) for row in rows), key=key
    )


def compare(spark_df, con, sql) -> str | None:
    """None if equal, otherwise what differs first."""
    left_cols, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in result.description], result.fetchall())
    types = {d[0]: str(d[1]) for d in result.description}
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    for f in spark_df.schema.fields:
        want = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(
            f.dataType.simpleString()
        )
        if want is None or want != types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if not same(a, b)]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def same(a, b) -> bool:
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
        for x, y in zip(a, b, strict=True)
    )
