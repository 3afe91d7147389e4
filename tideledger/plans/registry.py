"""Registry of the checked queries.

Each query names its output columns once, with how they are compared: plain (text as is),
`:d` date as text, `:i` whole number, `:<n>` double rounded to n places. The same list
shapes the Spark result and the SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.plans.base_sql import with_tables
from tideledger.plans.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(cols: str) -> list[tuple[str, str]]:
    return [(c.split(":") + [""])[:2] for c in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    picked = []
    for name, kind in _columns(cols):
        c = F.col(name)
        if kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        picked.append(c.alias(name))
    return df.select(*picked)


def _sql_columns(cols: str) -> str:
    picked = []
    for name, kind in _columns(cols):
        if kind == "d":
            picked.append(f'CAST(CAST("{name}" AS DATE) AS VARCHAR) AS "{name}"')
        elif kind == "i":
            picked.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind:
            picked.append(f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0 AS "{name}"')
        else:
            picked.append(f'"{name}"')
    return ", ".join(picked)


def query(name: str, cols: str, tables: str = "", sql: str | None = None,
          extra: dict[str, str] | None = None):
    """Register `fn(roles) -> DataFrame`, with its SQL twin over the named role tables."""

    def wrap(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shape(fn(Roles(spark, folder)), cols)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(
                *tables.split(), extra=extra,
                body=f"SELECT {_sql_columns(cols)} FROM ({sql}) AS result_rows")
        return fn

    return wrap
