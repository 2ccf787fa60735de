"""Rows of a query against those of its SQL, whatever their order."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def bag(rows, columns):
    order = sorted(columns)
    return Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)


def connect():
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(DATA)):
        path = f"{DATA}/{file}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{file}") else "")
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def differences(spark, query, sql):
    df = query(spark, DATA)
    mine = bag([tuple(r) for r in df.collect()], df.columns)
    relation = connect().sql(sql)
    theirs = bag(relation.fetchall(), list(relation.columns))
    assert sorted(df.columns) == sorted(relation.columns)
    return list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
