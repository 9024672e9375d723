"""Hold a query's rows against those of its SQL in DuckDB: names, count and every value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def duck(sf_dir: str, **extra) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    for name, frame in extra.items():
        con.register(name, frame)
    return con


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())


def rows_of(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in df.collect())


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> Counter:
    names, got = rows_of(df)
    wanted_names, wanted = rows_of_sql(con, sql)
    assert names == wanted_names
    assert got.total() == wanted.total(), f"{got.total()} rows, SQL has {wanted.total()}; only here {list((got - wanted))[:3]}; only there {list((wanted - got))[:3]}"
    assert got == wanted, f"only here {list((got - wanted))[:3]}; only there {list((wanted - got))[:3]}"
    return got
