"""Holds a query against its SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | int):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def in_order(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(frame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    told = con.execute(sql)
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(frame.columns)
    assert in_order(frame.columns, [tuple(r) for r in frame.collect()]) == in_order(columns, told.fetchall())
