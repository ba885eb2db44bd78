"""Run a registered query on Spark and its SQL on DuckDB, and compare values."""

from __future__ import annotations

import math
import os

import duckdb

from plumbline.catalogue import ORACLES, QUERIES


def tables(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(root)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in values]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_rows(spark, name, root):
    df = QUERIES[name](spark, root)
    return rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, name):
    rel = con.sql(ORACLES[name])
    return rows(rel.columns, rel.fetchall())


def mismatch(spark, con, name, root):
    got_names, got = spark_rows(spark, name, root)
    want_names, want = sql_rows(con, name)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: {got[:2]} / {want[:2]}"
    for g, w in zip(got, want, strict=True):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{got_names}: {g} != {w}"
    return None
