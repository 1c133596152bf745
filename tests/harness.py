"""Runs a query and its SQL side by side and tells where they differ."""

from __future__ import annotations

import datetime
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, norm(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, norm(v)) for k, v in value.asDict().items())
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(v) for v in r))


TIMES: dict[str, float] = {}

SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
    "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]",
    "array<float>": "DOUBLE[]",
}


def differences(df, con, sql: str) -> list[str]:
    start = time.time()
    cur = con.execute(sql)
    duck_cols = [c[0] for c in cur.description]
    duck_types = {c[0]: str(c[1]) for c in cur.description}
    duck = cur.fetchall()
    TIMES["sql"] = time.time() - start
    spark_types = dict(df.dtypes)
    out = []
    if sorted(df.columns) != sorted(duck_cols):
        return [f"columns {sorted(df.columns)} != {sorted(duck_cols)}"]
    for c in df.columns:
        want = SPARK_TO_DUCK.get(spark_types[c], spark_types[c])
        if want != duck_types[c]:
            out.append(f"type of {c}: spark {spark_types[c]} sql {duck_types[c]}")
    start = time.time()
    found = df.collect()
    TIMES["spark"] = time.time() - start
    a = rows_of(df.columns, [tuple(r) for r in found])
    b = rows_of(duck_cols, duck)
    if len(a) != len(b):
        out.append(f"rows spark {len(a)} sql {len(b)}")
    if a != b:
        from collections import Counter

        ca, cb = Counter(a), Counter(b)
        only_a, only_b = list((ca - cb).elements()), list((cb - ca).elements())
        cols = sorted(df.columns)
        out.append(f"{cols}: only spark {len(only_a)}: {[str(x)[:300] for x in only_a[:3]]}")
        out.append(f"only sql {len(only_b)}: {[str(x)[:300] for x in only_b[:3]]}")
    elif not a:
        out.append("no rows on either side")
    return out
