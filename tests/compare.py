"""Run a registered query and its checking SQL and compare the rows without regard to order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _key(row):
    return tuple((v is None, str(round(v, 3)) if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


# Spark type name to the DuckDB type the checking SQL must produce.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def difference(df, con, text: str) -> str | None:
    """None when columns, types and values agree, else what differs first."""
    names = sorted(df.columns)
    found = con.execute(text)
    described = {d[0]: str(d[1]) for d in found.description}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}"
    wrong = [
        (n, t, described[n]) for n, t in df.dtypes if TYPES.get(t, t).upper() != described[n].upper()
    ]
    if wrong:
        return f"types {wrong}"
    order = [d[0] for d in found.description]
    expected = [dict(zip(order, row)) for row in found.fetchall()]
    left = sorted([[_plain(r[n]) for n in names] for r in df.collect()], key=_key)
    right = sorted([[_plain(r[n]) for n in names] for r in expected], key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}: {left[:3]} | {right[:3]}"
    for a, b in zip(left, right):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"row {names}: {a} against {b}"
    return None
