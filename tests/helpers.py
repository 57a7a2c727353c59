"""Comparison of Spark rows with DuckDB's."""

import glob
import os

import duckdb


def views(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def norm(value):
    return float(f"{value:.12g}") if isinstance(value, float) else value


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def assert_same(df, con, sql: str):
    columns = sorted(df.columns)
    spark_rows = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    duck_rows = [tuple(norm(r[i]) for i in at) for r in found.fetchall()]
    assert sorted_rows(spark_rows) == sorted_rows(duck_rows)
