"""Baseline forecaster keys and walk-forward folds (§2.9).

The company-total daily series is densified over its span; the horizon is the
548 days after the last observed day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.operators import backtest as bt
from vendora.operators import baseline as bl
from vendora.operators import calendar_ops as co
from vendora.plans import common as cm
from vendora.plans.q_calendar import SPINE_CTE
from vendora.plans.registry import register
from vendora.sources import bindings as b

HORIZON_DAYS = 548   # fixed value: 2023-01-01 .. 2024-07-01 in the reference
VALUES = ["revenue", "cogs"]

# ------------------------------------------------------------------ SQL side
DENSE_CTE = ("dense", """
    SELECT 'TOTAL' AS series_id, s.date, coalesce(x.revenue, 0) AS revenue, coalesce(x.cogs, 0) AS cogs
    FROM spine s LEFT JOIN fx_sales x USING (date)""")

HORIZON_CTE = ("horizon", f"""
    SELECT 'TOTAL' AS series_id, CAST(unnest(generate_series(CAST(hi + 1 AS TIMESTAMP),
                                      CAST(hi + {HORIZON_DAYS} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT max(date) AS hi FROM spine) b""")


def _stats_ctes(train: str, key: str, span_end: str) -> list[tuple[str, str]]:
    """SQL twin of baseline.fit_stats / seasonal_profile over table ``train``."""
    return [
        ("b_span", f"""SELECT {key}, min(date) AS span_start, max({span_end}) AS span_end
                       FROM {train} GROUP BY {key}"""),
        ("b_ann", f"""SELECT a.*, a.revenue / nullif(lag(a.revenue) OVER (PARTITION BY a.{key} ORDER BY a.year), 0)
                               AS r_rev,
                             a.cogs / nullif(lag(a.cogs) OVER (PARTITION BY a.{key} ORDER BY a.year), 0) AS r_cogs
                      FROM (SELECT {key}, CAST(year(date) AS INTEGER) AS year, sum(revenue) AS revenue,
                                   sum(cogs) AS cogs, count(*) AS n_days
                            FROM {train} GROUP BY {key}, year(date)) a
                      JOIN b_span s USING ({key})
                      WHERE make_date(a.year, 1, 1) >= s.span_start AND make_date(a.year, 12, 31) <= s.span_end"""),
        ("b_stats", f"""SELECT {key}, max(year) AS last_full_year, count(*) AS n_full_years,
                               exp(avg(ln(r_rev))) AS growth_revenue, exp(avg(ln(r_cogs))) AS growth_cogs,
                               arg_max(revenue, year) / {bl.BASE_DIVISOR} AS base_revenue,
                               arg_max(cogs, year) / {bl.BASE_DIVISOR} AS base_cogs
                        FROM b_ann GROUP BY {key}"""),
        ("b_seas", f"""SELECT {key}, month, day, avg(nr) AS factor_revenue, avg(nc) AS factor_cogs
                       FROM (SELECT {key}, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
                                    revenue / nullif(avg(revenue) OVER (PARTITION BY {key}, year(date)), 0) AS nr,
                                    cogs / nullif(avg(cogs) OVER (PARTITION BY {key}, year(date)), 0) AS nc
                             FROM {train}) t
                       GROUP BY {key}, month, day"""),
    ]


def _pred_sql(target: str, key: str, alias_actual: bool) -> str:
    act = ", t.revenue AS actual_revenue, t.cogs AS actual_cogs" if alias_actual else ""
    return f"""
SELECT t.{key}, t.date{act},
       st.base_revenue * pow(st.growth_revenue, year(t.date) - st.last_full_year)
         * coalesce(se.factor_revenue, 1.0) AS pred_revenue,
       st.base_cogs * pow(st.growth_cogs, year(t.date) - st.last_full_year)
         * coalesce(se.factor_cogs, 1.0) AS pred_cogs
FROM {target} t JOIN b_stats st USING ({key})
LEFT JOIN b_seas se ON se.{key} = t.{key} AND se.month = month(t.date) AND se.day = day(t.date)"""


BASE_CTES = [SPINE_CTE, DENSE_CTE, HORIZON_CTE] + _stats_ctes("dense", "series_id", "date")

FOLD_VALUES = ", ".join(f"('{f}', DATE '{a}', DATE '{v0}', DATE '{v1}')" for f, a, v0, v1 in bt.FOLDS)
FOLDS_CTE = ("folds", f"SELECT * FROM (VALUES {FOLD_VALUES}) v(fold, train_end, val_start, val_end)")
FOLD_TRAIN_CTE = ("f_train", """
    SELECT f.fold, f.train_end, d.date, d.revenue, d.cogs FROM dense d JOIN folds f ON d.date <= f.train_end""")
FOLD_VAL_CTE = ("f_val", """
    SELECT f.fold, d.date, d.revenue, d.cogs FROM dense d
    JOIN folds f ON d.date BETWEEN f.val_start AND f.val_end""")
# fold_predictions(fold, date, actual_revenue, actual_cogs, pred_revenue, pred_cogs)
FOLD_PRED_CTES = ([SPINE_CTE, DENSE_CTE, FOLDS_CTE, FOLD_TRAIN_CTE, FOLD_VAL_CTE]
                  + _stats_ctes("f_train", "fold", "train_end")
                  + [("fold_predictions", _pred_sql("f_val", "fold", alias_actual=True))])

# ---------------------------------------------------------------- Spark side


def total_daily(spark, sf):
    """Densified company-total series keyed by a constant series id (materialized once)."""
    return cm.total_daily(spark, sf)


def horizon(spark, daily):
    hi = daily.agg(F.max("date").alias("hi")).select("hi").scalar()
    return co.date_spine(spark, F.date_add(hi, 1), F.date_add(hi, HORIZON_DAYS)) \
             .select(F.lit("TOTAL").alias("series_id"), "date")


def fold_predictions(spark, sf):
    """Baseline backtest: fold, date, actual_*, pred_* (all folds in one plan)."""
    daily = total_daily(spark, sf)
    return bt.baseline_backtest(daily, bt.folds_df(spark), ["series_id"], VALUES).drop("series_id")


@register("annual_totals", rounding={"revenue": 2, "cogs": 2}, extra_ctes=[SPINE_CTE, DENSE_CTE], sql="""
SELECT CAST(year(date) AS INTEGER) AS year, sum(revenue) AS revenue, sum(cogs) AS cogs, count(*) AS n_days
FROM dense GROUP BY year(date)""")
def q_annual(spark, sf):
    return bl.annual_totals(total_daily(spark, sf), [], VALUES)


@register("growth_rate", rounding={"growth_revenue": 9, "growth_cogs": 9, "base_revenue": 4, "base_cogs": 4},
          extra_ctes=BASE_CTES, sql="SELECT * EXCLUDE (series_id) FROM b_stats")
def q_growth(spark, sf):
    return bl.fit_stats(total_daily(spark, sf), ["series_id"], VALUES).drop("series_id")


@register("seasonal_profile", rounding={"factor_revenue": 9, "factor_cogs": 9},
          extra_ctes=BASE_CTES, sql="SELECT * EXCLUDE (series_id) FROM b_seas")
def q_seasonal(spark, sf):
    return bl.seasonal_profile(total_daily(spark, sf), ["series_id"], VALUES).drop("series_id")


@register("join_seasonal_lookup", rounding={"factor_revenue": 9, "factor_cogs": 9}, extra_ctes=BASE_CTES, sql="""
SELECT h.date, coalesce(se.factor_revenue, 1.0) AS factor_revenue, coalesce(se.factor_cogs, 1.0) AS factor_cogs
FROM horizon h LEFT JOIN b_seas se ON se.month = month(h.date) AND se.day = day(h.date)""")
def q_seasonal_lookup(spark, sf):
    daily = total_daily(spark, sf)
    seas = bl.seasonal_profile(daily, ["series_id"], VALUES)
    return bl.join_seasonal_lookup(horizon(spark, daily), seas, ["series_id"], VALUES).drop("series_id")


@register("baseline_forecast", rounding={"pred_revenue": 2, "pred_cogs": 2}, extra_ctes=BASE_CTES,
          sql=f"SELECT date, pred_revenue, pred_cogs FROM ({_pred_sql('horizon', 'series_id', False)}) p")
def q_baseline_forecast(spark, sf):
    return baseline_forecast(spark, sf)


def baseline_forecast(spark, sf, round_to: int | None = 2):
    daily = total_daily(spark, sf)
    return bl.fit_predict(daily, horizon(spark, daily), ["series_id"], VALUES, round_to=round_to).drop("series_id")


@register("baseline_mape", rounding={"mape_revenue": 6, "mape_cogs": 6}, extra_ctes=BASE_CTES, sql=f"""
SELECT avg(abs(actual_revenue - pred_revenue) / nullif(actual_revenue, 0)) * 100 AS mape_revenue,
       avg(abs(actual_cogs - pred_cogs) / nullif(actual_cogs, 0)) * 100 AS mape_cogs,
       count(*) FILTER (WHERE actual_revenue = 0) AS n_zero_actuals, count(*) AS n_days
FROM ({_pred_sql('(SELECT d.* FROM dense d JOIN b_stats s USING (series_id) '
                 'WHERE year(d.date) IN (s.last_full_year - 1, s.last_full_year))', 'series_id', True)}) p""")
def q_baseline_mape(spark, sf):
    daily = total_daily(spark, sf)
    stats = bl.fit_stats(daily, ["series_id"], VALUES)
    last2 = (daily.join(stats.select("series_id", "last_full_year"), "series_id")
                  .filter(F.year("date").isin(F.col("last_full_year") - 1, F.col("last_full_year")))
                  .drop("last_full_year"))
    p = bl.predict(last2, stats, bl.seasonal_profile(daily, ["series_id"], VALUES), ["series_id"], VALUES,
                   round_to=None)
    by = {v: bl.mape(p, v, f"pred_{v}") for v in VALUES}           # one row each
    cogs = by["cogs"].select("mape_pct").scalar()
    return by["revenue"].select(F.col("mape_pct").alias("mape_revenue"), cogs.alias("mape_cogs"), "n_zero_actuals", "n_days")


@register("walk_forward_folds", extra_ctes=[SPINE_CTE, DENSE_CTE, FOLDS_CTE, FOLD_TRAIN_CTE, FOLD_VAL_CTE], sql="""
SELECT fold, 'train' AS role, count(*) AS rows, min(date) AS min_date, max(date) AS max_date
FROM f_train GROUP BY fold
UNION ALL
SELECT fold, 'val' AS role, count(*) AS rows, min(date) AS min_date, max(date) AS max_date
FROM f_val GROUP BY fold""")
def q_folds(spark, sf):
    return bt.fold_summary(bt.assign_folds(total_daily(spark, sf), bt.folds_df(spark)))


@register("baseline_backtest", rounding={"pred_revenue": 2, "pred_cogs": 2}, extra_ctes=FOLD_PRED_CTES,
          sql="SELECT * FROM fold_predictions")
def q_baseline_backtest(spark, sf):
    return fold_predictions(spark, sf)
