"""Compare a Spark result with its SQL twin run by DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return format(value, ".12g")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _kind(name: str) -> str:
    name = name.lower()
    if name.startswith(("decimal", "double", "float", "real")):
        return "number"
    if name in ("bigint", "hugeint", "integer", "int", "smallint", "tinyint"):
        return "whole"
    if name.startswith("timestamp"):
        return "time"
    return {"varchar": "text", "string": "text"}.get(name, name)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the two results; nothing when they agree."""
    found: list[str] = []
    names = sorted(df.columns)
    cursor = connection.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if names != sorted(theirs_names):
        return [f"columns {names} against {sorted(theirs_names)}"]
    kinds = {d[0]: _kind(str(d[1])) for d in cursor.description}
    for field in df.schema.fields:
        mine = _kind(field.dataType.simpleString())
        if mine != kinds[field.name]:
            found.append(f"type of {field.name}: {mine} against {kinds[field.name]}")
    order = [theirs_names.index(n) for n in names]
    theirs = sorted(tuple(_plain(row[i]) or "" if row[i] is not None else "\0" for i in order)
                    for row in cursor.fetchall())
    ours = sorted(tuple(_plain(row[n]) if row[n] is not None else "\0" for n in names) for row in df.collect())
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    if ours != theirs:
        ours_set, theirs_set = set(ours), set(theirs)
        extra = sorted(ours_set - theirs_set)[:3]
        lacking = sorted(theirs_set - ours_set)[:3]
        found.append(f"values: only ours {extra}; only theirs {lacking}")
    return found
