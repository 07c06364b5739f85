"""Compare a Spark frame with a DuckDB query, ignoring row and column order."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(shaped, key=repr)


def difference(frame, connection, sql):
    """None when equal, else a short description."""
    relation = connection.sql(sql)
    want_names, want = rows_of(list(relation.columns), relation.fetchall())
    have_names, have = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if have_names != want_names:
        return f"columns {have_names} != {want_names}"
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return None if not bad else f"{len(bad)} of {len(have)} rows differ, first: {bad[0]}"
