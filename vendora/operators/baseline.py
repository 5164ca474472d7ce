"""Seasonal-average x growth baseline, keyed by any grouping (series, fold).

Every statistic is grouped by ``keys`` so one plan fits all series and all
backtest folds at once; nothing loops on the driver.

* annual totals per (keys, year)
* growth = geometric mean of year-over-year ratios over *full* years, as
  exp(avg(ln(ratio))) (the product form for positive ratios)
* seasonal factor per (keys, month, day) = mean over years of value / that
  year's mean value
* forecast = last full year total / 365 x growth^(year - last full year) x factor
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE_DIVISOR = 365   # fixed value: the base level divides a year's total by 365


def annual_totals(daily: DataFrame, keys: list[str], values: list[str], date_col: str = "date") -> DataFrame:
    return (daily.groupBy(*keys, F.year(date_col).alias("year"))
                 .agg(*[F.sum(v).alias(v) for v in values],
                      F.count(F.lit(1)).alias("n_days")))


def full_year_flag(year, span_start, span_end):
    """A year is full when the span covers Jan 1 .. Dec 31 of it."""
    return ((F.make_date(year, F.lit(1), F.lit(1)) >= span_start)
            & (F.make_date(year, F.lit(12), F.lit(31)) <= span_end))


def fit_stats(train: DataFrame, keys: list[str], values: list[str], date_col: str = "date",
              span_end_col: str | None = None) -> DataFrame:
    """Per key group: growth per value, last full year and its base level.

    ``span_end_col`` names a column holding the training end (a fold's
    ``train_end``); without it the group's max date is used.
    """
    span = train.groupBy(*keys).agg(
        F.min(date_col).alias("span_start"),
        (F.max(span_end_col) if span_end_col else F.max(date_col)).alias("span_end"))
    ann = annual_totals(train, keys, values, date_col).join(span, keys)
    ann = ann.filter(full_year_flag(F.col("year"), F.col("span_start"), F.col("span_end")))
    w = Window.partitionBy(*keys).orderBy("year")
    for v in values:
        ann = ann.withColumn(f"_ratio_{v}", F.try_divide(F.col(v), F.lag(v).over(w)))
    last = ann.groupBy(*keys).agg(
        F.max("year").alias("last_full_year"),
        F.count(F.lit(1)).alias("n_full_years"),
        *[F.exp(F.avg(F.ln(F.col(f"_ratio_{v}")))).alias(f"growth_{v}") for v in values],
        *[F.max_by(F.col(v), F.col("year")).alias(f"last_total_{v}") for v in values])
    return last.select(*keys, "last_full_year", "n_full_years",
                       *[F.col(f"growth_{v}") for v in values],
                       *[(F.col(f"last_total_{v}") / BASE_DIVISOR).alias(f"base_{v}") for v in values])


def seasonal_profile(train: DataFrame, keys: list[str], values: list[str], date_col: str = "date") -> DataFrame:
    """Mean over years of (value / that year's mean) per (keys, month, day)."""
    w = Window.partitionBy(*keys, F.year(date_col))
    norm = train.select(*keys, F.month(date_col).alias("month"), F.dayofmonth(date_col).alias("day"),
                        *[F.try_divide(F.col(v), F.avg(v).over(w)).alias(f"norm_{v}") for v in values])
    return norm.groupBy(*keys, "month", "day").agg(*[F.avg(f"norm_{v}").alias(f"factor_{v}") for v in values])


def join_seasonal_lookup(target: DataFrame, seasonal: DataFrame, keys: list[str], values: list[str],
                         date_col: str = "date") -> DataFrame:
    """Left join the (month, day) factors; a missing day (Feb 29) -> 1.0."""
    t = target.withColumn("month", F.month(date_col)).withColumn("day", F.dayofmonth(date_col))
    j = t.join(seasonal, keys + ["month", "day"], "left")
    for v in values:
        j = j.withColumn(f"factor_{v}", F.coalesce(F.col(f"factor_{v}"), F.lit(1.0)))
    return j.drop("month", "day")


def predict(target: DataFrame, stats: DataFrame, seasonal: DataFrame, keys: list[str], values: list[str],
            date_col: str = "date", round_to: int | None = 2, prefix: str = "pred_") -> DataFrame:
    j = join_seasonal_lookup(target, seasonal, keys, values, date_col)
    # a series without a full year keeps its rows, with null forecasts
    j = j.join(stats, keys, "left")
    ahead = F.year(date_col) - F.col("last_full_year")
    out = j
    for v in values:
        p = F.col(f"base_{v}") * F.pow(F.col(f"growth_{v}"), ahead) * F.col(f"factor_{v}")
        out = out.withColumn(f"{prefix}{v}", F.round(p, round_to) if round_to is not None else p)
    drop = ["last_full_year", "n_full_years"] + [f"{p}_{v}" for v in values for p in ("growth", "base", "factor")]
    return out.drop(*drop)


def fit_predict(train: DataFrame, target: DataFrame, keys: list[str], values: list[str],
                date_col: str = "date", span_end_col: str | None = None, round_to: int | None = 2) -> DataFrame:
    """Fit on ``train`` and forecast the rows of ``target`` (same ``keys``).

    ``keys`` must be non-empty (series, fold...); a single series uses a
    constant series id, never a keyless cross join.
    """
    if not keys:
        raise ValueError("fit_predict needs at least one key column")
    stats = fit_stats(train, keys, values, date_col, span_end_col)
    seas = seasonal_profile(train, keys, values, date_col)
    return predict(target, stats, seas, keys, values, date_col, round_to)


def mape(df: DataFrame, actual: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Mean absolute percentage error; zero actuals are excluded and counted."""
    keys = keys or []
    ape = F.abs(F.col(actual) - F.col(pred)) / F.nullif(F.col(actual), F.lit(0.0))
    return df.groupBy(*keys).agg((F.avg(ape) * 100).alias("mape_pct"),
                                 F.count(F.when(F.col(actual) == 0, 1)).alias("n_zero_actuals"),
                                 F.count(F.lit(1)).alias("n_days"))
