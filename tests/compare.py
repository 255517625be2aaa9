"""Compare a Spark result with a SQL engine's result on the same Parquet tables."""

from __future__ import annotations

import math

import duckdb

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(cell(v)) for v in value) + "]"
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(row[n]) for n in names) for row in df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(row[i]) for i in order) for row in cursor.fetchall())


def differences(df, con, sql, limit=3):
    """Empty when both give the same rows; otherwise a short description."""
    spark_names, left = spark_rows(df)
    sql_names, right = sql_rows(con, sql)
    if spark_names != sql_names:
        return [f"columns {spark_names} != {sql_names}"]
    if left == right:
        return []
    shown = [f"spark {a}\n  sql {b}" for a, b in zip(left, right) if a != b][:limit]
    return [f"rows {len(left)} != {len(right)}" if len(left) != len(right) else f"{len(left)} rows", *shown]
