"""Compare a query with its SQL twin on the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    return value


def _rows(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda at: names[at])
    return [names[at] for at in order], Counter(tuple(_plain(row[at]) for at in order) for row in rows)


def difference(frame, sql: str, connection) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    names, got = _rows(frame.columns, frame.collect())
    result = connection.execute(sql)
    wanted_names, wanted = _rows([d[0] for d in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if got == wanted:
        return None
    extra, missing = list((got - wanted).items())[:2], list((wanted - got).items())[:2]
    return f"rows {sum(got.values())} != {sum(wanted.values())}; only here {extra}; only there {missing}"
