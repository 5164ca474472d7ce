"""Query registry: key -> (Spark builder, oracle SQL, output rounding).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables.  The oracle SQL is the same question written directly in SQL
(DuckDB dialect, driver tables pre-registered), usually in the most literal
form, so it also serves as a brute-force check of the scalable Spark plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.plans.oracle_views import with_views


@dataclass
class QuerySpec:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounding: dict


REGISTRY: dict[str, QuerySpec] = {}


def _round_df(df: DataFrame, rounding: dict) -> DataFrame:
    if not rounding:
        return df
    cols = []
    for c in df.columns:
        if c in rounding:
            cols.append(F.round(F.col(c).cast("double"), rounding[c]).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _round_sql(sql: str, rounding: dict) -> str:
    if not rounding:
        return sql
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) AS {c}" for c, d in rounding.items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


def register(key: str, sql: str | None = None, rounding: dict | None = None, extra_ctes=None):
    """Register a query.  ``sql`` may use the fx_* views by name."""
    rounding = rounding or {}

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _round_df(fn(spark, sf_dir), rounding)
        full_sql = None
        if sql is not None:
            full_sql = _round_sql(with_views(sql, extra_ctes), rounding)
        REGISTRY[key] = QuerySpec(key, build, full_sql, rounding)
        return fn
    return deco


def sql_flag(value: str, key: str, ascending: bool = False, name: str = "is_top") -> str:
    """SQL twin of ``rank_flag``: 1 on the arg-max row (ties -> first key)."""
    direction = "ASC" if ascending else "DESC"
    return (f"CAST(row_number() OVER (ORDER BY {value} {direction} NULLS LAST, {key}) = 1 "
            f"AND {value} IS NOT NULL AS INTEGER) AS {name}")
