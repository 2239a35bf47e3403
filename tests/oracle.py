"""Compares a query with its SQL in DuckDB over the same files."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(spark, run, sf_dir):
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.select(*columns).collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(r[k]) for k in order)) for r in found.fetchall())
