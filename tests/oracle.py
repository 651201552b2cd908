"""Compares a query with its SQL on the same files, ignoring row order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "float": "FLOAT", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def differences(df, con, sql: str) -> list[str]:
    """Empty if names, types and rows agree."""
    rel = con.sql(sql)
    theirs_names, theirs_types = list(rel.columns), [str(t) for t in rel.types]
    found = []
    ours_names = df.columns
    if sorted(ours_names) != sorted(theirs_names):
        return [f"columns {ours_names} vs {theirs_names}"]
    kinds = dict(zip(theirs_names, theirs_types))
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} vs {kinds[name]}")
    names = sorted(ours_names)
    at = [theirs_names.index(n) for n in names]
    ours = sorted(tuple(plain(row[n]) for n in names) for row in df.select(*names).collect())
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in rel.fetchall())
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} vs {len(theirs)}")
    elif ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        found.append(f"{len(bad)} of {len(ours)} rows differ, e.g. {names}: {bad[0]}")
    return found
