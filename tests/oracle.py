"""Runs a query and the SQL of the same result, and compares all rows."""

import math
import os

import duckdb


def _text(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_text, value)) + "]"
    return str(value)


def rows_of_sql(sql: str, directory: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in os.listdir(directory):
        path = f"{directory}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    return columns, sorted(tuple(_text(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_text(r[c]) for c in columns) for r in frame.collect())
