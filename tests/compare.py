"""Run a registered query and its SQL and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    data = df.select(*[f"`{n}`" for n in names]).collect()
    return names, Counter(tuple(_plain(v) for v in r) for r in data)


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = result.fetchall()
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in data)


def difference(left: Counter, right: Counter, show: int = 3) -> str:
    only_left, only_right = left - right, right - left
    if not only_left and not only_right:
        return ""
    lines = [f"{sum(only_left.values())} rows only in Spark, {sum(only_right.values())} only in SQL"]
    lines += [f"  spark: {r}" for r in list(only_left)[:show]]
    lines += [f"  sql:   {r}" for r in list(only_right)[:show]]
    return "\n".join(lines)
