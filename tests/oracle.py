"""Run a query and its SQL twin on the same tables and compare all rows without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    order = sorted(range(len(df.columns)), key=df.columns.__getitem__)
    return [df.columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in df.collect())


def differences(df, sql: str, sf_dir: str) -> str:
    names, got = spark_rows(df)
    wanted_names, wanted = sql_rows(sql, sf_dir)
    if names != wanted_names:
        return f"columns {names} against {wanted_names}"
    if got == wanted:
        return ""
    return f"{sum((got - wanted).values())} rows only in Spark, {sum((wanted - got).values())} only in SQL; " + str([*(got - wanted)][:3]) + " | " + str([*(wanted - got)][:3])
