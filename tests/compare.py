"""Runs a query and its SQL over the same tables and compares all rows."""

import glob
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect(config={"threads": 2})
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _text(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_text(r[i]) for i in order) for r in rows)


def both(spark, folder, query, sql):
    df = query(spark, folder)
    found = connection(folder).sql(sql)
    return table(df.columns, df.collect()), table(found.columns, found.fetchall())
