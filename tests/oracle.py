"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return "nan"
        return str(int(number)) if number.is_integer() else f"{number:.12g}"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_key(r[i]) for i in order) for r in rows)


def sql_result(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return normal(columns, result.fetchall())


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])
