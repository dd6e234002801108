"""Where plan modules put their queries, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


#: Chinese capitals of the digits from 1.
CAPITAL_DIGITS = "壹贰叁肆伍陆柒捌玖"


def filled(template: str, key: str) -> Column:
    """template with {a}, a number of two digits, {d}, one of one digit from 1, and {c}, its capital, of a key."""
    a, d = (F.col(key) % 90 + 10).cast("string"), (F.col(key) % 9 + 1).cast("string")
    c = F.substring(F.lit(CAPITAL_DIGITS), (F.col(key) % 9 + 1).cast("int"), F.lit(1))
    return F.replace(F.replace(F.replace(F.lit(template), F.lit("{a}"), a), F.lit("{d}"), d), F.lit("{c}"), c)


def filled_sql(column: str, key: str) -> str:
    return f"replace(replace(replace({column}, '{{a}}', ({key} % 90 + 10)::VARCHAR), '{{d}}', ({key} % 9 + 1)::VARCHAR), '{{c}}', substr('{CAPITAL_DIGITS}', ({key} % 9 + 1)::INT, 1))"


def cases(table: DataFrame, key: str, templates: Sequence[str]) -> DataFrame:
    """(key, raw): every row of the table with the template that its key's remainder picks, filled with its numbers."""
    return table.select(key, F.get(F.array(*[filled(x, key) for x in templates]), (F.col(key) % len(templates)).cast("int")).alias("raw"))


def cases_sql(table: str, key: str, rows: Sequence[tuple], names: Sequence[str]) -> str:
    """The same rows in SQL with further columns: texts are filled as well, other values are as given."""
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join(f"({i}, {', '.join(map(said, r))})" for i, r in enumerate(rows))
    text = {n for n, column in zip(names, zip(*rows, strict=True), strict=True) if any(isinstance(v, str) for v in column)}
    columns = ", ".join(f"{filled_sql(n, key) if n in text else n} AS {n}" for n in names)
    return f"SELECT {key}, {columns} FROM {table} JOIN (VALUES {values}) v(i, {', '.join(names)}) ON i = {key} % {len(rows)}"
