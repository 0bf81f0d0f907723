"""Compares a query with its SQL in DuckDB, as bags of rows."""

import datetime
import math
from collections import Counter
from pathlib import Path

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def differences(spark, query, sql, folder):
    """What is wrong, in words; empty where names, types and rows agree."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = con.sql(sql), query(spark, folder)
    own, other = dict(got.dtypes), dict(zip(want.columns, map(str, want.types)))
    if {n: TYPES[t] for n, t in own.items()} != other:
        return f"columns {own} and {other}"
    names = sorted(own)
    at = [want.columns.index(n) for n in names]
    a = Counter(tuple(_value(r[n]) for n in names) for r in got.collect())
    b = Counter(tuple(_value(r[i]) for i in at) for r in want.fetchall())
    return "" if a == b else f"only the query has {list((a - b).items())[:3]}, only the SQL {list((b - a).items())[:3]}"
