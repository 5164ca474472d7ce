"""Diagnostics, windows and sweeps over the baseline backtest.

All of them consume ``fold_predictions`` (fold, date, actual_*, pred_*), so they
have SQL oracles without any model fit.  The "outside" forecast is the
seasonal-naive value of the same day one year earlier (only when that day is
inside the fold's training span).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vendora.functions.stats import norm_ppf_sql
from vendora.operators import backtest as bt
from vendora.operators import diagnostics as dg
from vendora.operators import relational as rel
from vendora.operators.selection import exact_quantile
from vendora.plans import q_baseline as qb
from vendora.plans import common as cm
from vendora.plans.registry import register
from vendora.sources import bindings as b

PAIRS = {"revenue": ("actual_revenue", "pred_revenue"), "cogs": ("actual_cogs", "pred_cogs")}
TAIL_DAYS = 365
TOP_K = 25

NAIVE_CTE = ("preds_naive", """
    SELECT p.*, d.revenue AS naive_revenue
    FROM fold_predictions p JOIN folds f USING (fold)
    LEFT JOIN dense d ON d.date = CAST(p.date - INTERVAL 12 MONTH AS DATE) AND d.date <= f.train_end""")
RES_CTE = ("res", "SELECT fold, date, actual_revenue, actual_revenue - pred_revenue AS residual FROM fold_predictions")
FP = qb.FOLD_PRED_CTES
FPN = FP + [NAIVE_CTE]
FPR = FP + [RES_CTE]


def preds(spark, sf):
    """The baseline's walk-forward predictions, worked out once for all diagnostics."""
    return cm.materialized(spark, sf, "fold_predictions", lambda: qb.fold_predictions(spark, sf))


def preds_naive(spark, sf):
    """Fold predictions plus the seasonal-naive outside forecast."""
    daily = qb.total_daily(spark, sf)
    p = preds(spark, sf).join(F.broadcast(bt.folds_df(spark).select("fold", "train_end")), "fold")
    src = daily.select(F.col("date").alias("src_date"), F.col("revenue").alias("naive_revenue"))
    p = p.withColumn("src_date", F.add_months("date", -12))
    j = p.join(src, (p.src_date == src.src_date) & (src.src_date <= p.train_end), "left")
    return j.drop("src_date", "train_end")


def residuals(spark, sf):
    return preds(spark, sf).select("fold", "date", "actual_revenue",
                                   (F.col("actual_revenue") - F.col("pred_revenue")).alias("residual"))


M4 = {f"{t}_{m}": (9 if m == "r2" else 4) for t in PAIRS for m in ("mae", "rmse", "r2")}


@register("fold_metrics", rounding=M4, extra_ctes=FP, sql="""
SELECT fold,
       avg(abs(actual_revenue - pred_revenue)) AS revenue_mae,
       sqrt(avg((actual_revenue - pred_revenue) * (actual_revenue - pred_revenue))) AS revenue_rmse,
       1 - sum((actual_revenue - pred_revenue) * (actual_revenue - pred_revenue))
           / nullif(count(actual_revenue) * var_pop(actual_revenue), 0) AS revenue_r2,
       avg(abs(actual_cogs - pred_cogs)) AS cogs_mae,
       sqrt(avg((actual_cogs - pred_cogs) * (actual_cogs - pred_cogs))) AS cogs_rmse,
       1 - sum((actual_cogs - pred_cogs) * (actual_cogs - pred_cogs))
           / nullif(count(actual_cogs) * var_pop(actual_cogs), 0) AS cogs_r2,
       count(*) AS n_days
FROM fold_predictions GROUP BY fold""")
def q_fold_metrics(spark, sf):
    return dg.fold_metrics(preds(spark, sf), ["fold"], PAIRS)


@register("metrics_summary", rounding={**M4, "n_days": 4}, extra_ctes=FP + [("fm", """
    SELECT fold,
       avg(abs(actual_revenue - pred_revenue)) AS revenue_mae,
       sqrt(avg((actual_revenue - pred_revenue) * (actual_revenue - pred_revenue))) AS revenue_rmse,
       1 - sum((actual_revenue - pred_revenue) * (actual_revenue - pred_revenue))
           / nullif(count(actual_revenue) * var_pop(actual_revenue), 0) AS revenue_r2,
       avg(abs(actual_cogs - pred_cogs)) AS cogs_mae,
       sqrt(avg((actual_cogs - pred_cogs) * (actual_cogs - pred_cogs))) AS cogs_rmse,
       1 - sum((actual_cogs - pred_cogs) * (actual_cogs - pred_cogs))
           / nullif(count(actual_cogs) * var_pop(actual_cogs), 0) AS cogs_r2,
       CAST(count(*) AS DOUBLE) AS n_days
    FROM fold_predictions GROUP BY fold""")], sql="""
SELECT * FROM fm
UNION ALL
SELECT 'mean', avg(revenue_mae), avg(revenue_rmse), avg(revenue_r2), avg(cogs_mae), avg(cogs_rmse), avg(cogs_r2),
       avg(n_days) FROM fm""")
def q_metrics_summary(spark, sf):
    return dg.metrics_summary(dg.fold_metrics(preds(spark, sf), ["fold"], PAIRS))


@register("spike_decomposition", rounding={"threshold": 4, "mae_spike": 4, "mae_normal": 4, "pct_from_spikes": 9},
          extra_ctes=FP, sql=f"""
SELECT p.fold, first(t.threshold) AS threshold,
       count(*) FILTER (WHERE p.actual_revenue >= t.threshold) AS n_spike,
       count(*) FILTER (WHERE p.actual_revenue < t.threshold) AS n_normal,
       avg(abs(p.actual_revenue - p.pred_revenue)) FILTER (WHERE p.actual_revenue >= t.threshold) AS mae_spike,
       avg(abs(p.actual_revenue - p.pred_revenue)) FILTER (WHERE p.actual_revenue < t.threshold) AS mae_normal,
       sum(abs(p.actual_revenue - p.pred_revenue)) FILTER (WHERE p.actual_revenue >= t.threshold)
         / nullif(sum(abs(p.actual_revenue - p.pred_revenue)), 0) * 100 AS pct_from_spikes
FROM fold_predictions p
JOIN (SELECT fold, quantile_cont(actual_revenue, {dg.SPIKE_QUANTILE}) AS threshold
      FROM fold_predictions GROUP BY fold) t USING (fold)
GROUP BY p.fold""")
def q_spikes(spark, sf):
    return dg.spike_decomposition(preds(spark, sf), ["fold"], "actual_revenue", "pred_revenue")


@register("mae_band", rounding={"pred": 4, "band_lo": 4, "band_hi": 4}, extra_ctes=FP, sql="""
SELECT fold, date, pred_revenue AS pred,
       pred_revenue - avg(abs(actual_revenue - pred_revenue)) OVER (PARTITION BY fold) AS band_lo,
       pred_revenue + avg(abs(actual_revenue - pred_revenue)) OVER (PARTITION BY fold) AS band_hi
FROM fold_predictions""")
def q_mae_band(spark, sf):
    return dg.mae_band(preds(spark, sf), ["fold"], "actual_revenue", "pred_revenue")


@register("rolling_30d_mae", rounding={"abs_error": 4, "rolling_30d_mae": 4}, extra_ctes=FP, sql="""
SELECT fold, date, abs(actual_revenue - pred_revenue) AS abs_error,
       avg(abs(actual_revenue - pred_revenue)) OVER (PARTITION BY fold ORDER BY date
           RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS rolling_30d_mae
FROM fold_predictions""")
def q_rolling(spark, sf):
    return dg.rolling_mae(preds(spark, sf), ["fold"], "actual_revenue", "pred_revenue")


@register("residual_stats", rounding={"mean": 4, "median": 4, "std": 4, "skew": 6, "kurtosis": 6},
          extra_ctes=FPR, sql="""
SELECT count(residual) AS n, avg(residual) AS mean, median(residual) AS median,
       stddev_pop(residual) AS std,
       avg(power(residual - m, 3)) / power(avg(power(residual - m, 2)), 1.5) AS skew,
       avg(power(residual - m, 4)) / power(avg(power(residual - m, 2)), 2) - 3 AS kurtosis
FROM res, (SELECT avg(residual) AS m FROM res) mm""")
def q_residual_stats(spark, sf):
    return dg.residual_stats(residuals(spark, sf))


@register("residual_histogram", rounding={"bin_lo": 4, "bin_hi": 4}, extra_ctes=FPR, sql=f"""
SELECT b.bin, b.lo + b.bin * (b.hi - b.lo) / {dg.HIST_BINS} AS bin_lo, b.lo + (b.bin + 1) * (b.hi - b.lo) / {dg.HIST_BINS} AS bin_hi,
       count(t.bin) AS n
FROM (SELECT CAST(unnest(generate_series(0, {dg.HIST_BINS - 1})) AS INTEGER) AS bin, lo, hi
      FROM (SELECT min(residual) AS lo, max(residual) AS hi FROM res) x) b
LEFT JOIN (SELECT CAST(coalesce(greatest(0, least(floor((residual - lo) / nullif(hi - lo, 0) * {dg.HIST_BINS}),
                                 {dg.HIST_BINS - 1})), 0) AS INTEGER) AS bin, lo, hi
      FROM res, (SELECT min(residual) AS lo, max(residual) AS hi FROM res) b) t ON t.bin = b.bin
GROUP BY b.bin, b.lo, b.hi""")
def q_residual_hist(spark, sf):
    return dg.residual_histogram(residuals(spark, sf))


_QQ_M = ("CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) "
         "ELSE (rank - 0.3175) / (n + 0.365) END")


@register("qq_points", rounding={"theoretical": 6, "ordered": 4, "slope": 4, "intercept": 4}, extra_ctes=FPR + [
    ("qq", f"""SELECT rank, {norm_ppf_sql('m')} AS theoretical, residual AS ordered
               FROM (SELECT rank, residual, {_QQ_M} AS m
                     FROM (SELECT row_number() OVER (ORDER BY residual) AS rank, residual,
                                  count(*) OVER () AS n FROM res) r) t""")], sql="""
SELECT qq.*, f.slope, f.intercept
FROM qq, (SELECT regr_slope(ordered, theoretical) AS slope, regr_intercept(ordered, theoretical) AS intercept
          FROM qq) f""")
def q_qq(spark, sf):
    return dg.qq_points(residuals(spark, sf), keys=["fold", "date"])


@register("empirical_cdf", rounding={"residual": 4, "cdf": 9}, extra_ctes=FPR, sql="""
SELECT residual, row_number() OVER (ORDER BY residual) AS rank,
       CAST(row_number() OVER (ORDER BY residual) AS DOUBLE) / count(*) OVER () AS cdf
FROM res""")
def q_ecdf(spark, sf):
    return dg.empirical_cdf(residuals(spark, sf), keys=["fold", "date"])


@register("residual_vs_actual", rounding={"residual": 4, "log_actual": 9, "log_pred": 9}, extra_ctes=FP, sql="""
SELECT p.fold, p.date, p.actual_revenue AS actual, p.actual_revenue - p.pred_revenue AS residual,
       CAST(p.actual_revenue >= t.threshold AS INTEGER) AS is_spike,
       log10(greatest(p.actual_revenue, 1)) AS log_actual, log10(greatest(p.pred_revenue, 1)) AS log_pred
FROM fold_predictions p
JOIN (SELECT fold, quantile_cont(actual_revenue, 0.9) AS threshold FROM fold_predictions GROUP BY fold) t
  USING (fold)""")
def q_res_vs_actual(spark, sf):
    p = preds(spark, sf)
    j = p.join(exact_quantile(p, ["fold"], "actual_revenue", dg.SPIKE_QUANTILE, "threshold"), "fold")
    return j.select("fold", "date", F.col("actual_revenue").alias("actual"),
                    (F.col("actual_revenue") - F.col("pred_revenue")).alias("residual"),
                    (F.col("actual_revenue") >= F.col("threshold")).cast("int").alias("is_spike"),
                    F.log10(F.greatest("actual_revenue", F.lit(1.0))).alias("log_actual"),
                    F.log10(F.greatest("pred_revenue", F.lit(1.0))).alias("log_pred"))


@register("error_correlation", rounding={"error_corr": 9, "mae_a": 4, "mae_b": 4}, extra_ctes=FPN, sql="""
SELECT fold, corr(actual_revenue - pred_revenue, actual_revenue - naive_revenue) AS error_corr,
       avg(abs(actual_revenue - pred_revenue)) AS mae_a, avg(abs(actual_revenue - naive_revenue)) AS mae_b,
       count(*) AS n
FROM preds_naive WHERE pred_revenue IS NOT NULL AND naive_revenue IS NOT NULL GROUP BY fold""")
def q_error_corr(spark, sf):
    return dg.error_correlation(preds_naive(spark, sf), ["fold"], "actual_revenue", "pred_revenue", "naive_revenue")


_W = ", ".join(f"({w!r})" for w in dg.SWEEP_WEIGHTS)


@register("weight_sweep", rounding={"w": 4, "mae": 4}, extra_ctes=FPN, sql=f"""
SELECT fold, w, mae, CAST(mae < mae_base AS INTEGER) AS better
FROM (SELECT fold, w,
             avg(abs(actual_revenue - ((1 - w) * pred_revenue + w * coalesce(naive_revenue, 0.0)))) AS mae,
             avg(abs(actual_revenue - pred_revenue)) AS mae_base
      FROM preds_naive, (SELECT * FROM (VALUES {_W}) v(w)) ws
      GROUP BY fold, w) t""")
def q_weight_sweep(spark, sf):
    return dg.weight_sweep(preds_naive(spark, sf), ["fold"], "actual_revenue", "pred_revenue", "naive_revenue")


# The factor of the one target while the other's is swept.
CAL_HELD_COGS, CAL_HELD_REVENUE = 1.32, 1.26


def _cal_pairs():
    return [(cr, CAL_HELD_COGS) for cr in dg.CAL_REVENUE_RANGE] + [(CAL_HELD_REVENUE, cc) for cc in dg.CAL_COGS_RANGE]


@register("calibration_sweep", rounding={"cal_revenue": 4, "cal_cogs": 4, "revenue": 2, "cogs": 2},
          extra_ctes=qb.BASE_CTES + [("bf", f"""SELECT date, pred_revenue, pred_cogs
              FROM ({qb._pred_sql('horizon', 'series_id', False)}) p""")], sql=f"""
SELECT c.cal_revenue, c.cal_cogs, bf.date,
       greatest(c.cal_revenue * bf.pred_revenue, 0) AS revenue, greatest(c.cal_cogs * bf.pred_cogs, 0) AS cogs
FROM bf, (SELECT * FROM (VALUES {", ".join(f"({a!r}, {c!r})" for a, c in _cal_pairs())}) v(cal_revenue, cal_cogs)) c""")
def q_cal_sweep(spark, sf):
    f = qb.baseline_forecast(spark, sf, round_to=None)
    pairs = F.array(*[F.struct(F.lit(a).alias("cal_revenue"), F.lit(c).alias("cal_cogs")) for a, c in _cal_pairs()])
    x = f.select("date", "pred_revenue", "pred_cogs", F.explode(pairs).alias("c"))
    return x.select(F.col("c.cal_revenue").alias("cal_revenue"), F.col("c.cal_cogs").alias("cal_cogs"), "date",
                    F.greatest(F.col("c.cal_revenue") * F.col("pred_revenue"), F.lit(0.0)).alias("revenue"),
                    F.greatest(F.col("c.cal_cogs") * F.col("pred_cogs"), F.lit(0.0)).alias("cogs"))


@register("forecast_with_tail", rounding={"revenue": 2, "cogs": 2}, extra_ctes=qb.BASE_CTES, sql=f"""
SELECT date, revenue, cogs, 'actual' AS kind FROM (
  SELECT date, revenue, cogs, row_number() OVER (ORDER BY date DESC) AS rn FROM dense) t
WHERE rn <= {TAIL_DAYS}
UNION ALL
SELECT date, pred_revenue, pred_cogs, 'forecast' FROM ({qb._pred_sql('horizon', 'series_id', False)}) p""")
def q_forecast_tail(spark, sf):
    daily = qb.total_daily(spark, sf)
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    tail = (daily.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= TAIL_DAYS)
                 .select("date", "revenue", "cogs", F.lit("actual").alias("kind")))
    fc = qb.baseline_forecast(spark, sf, round_to=None).select("date", F.col("pred_revenue").alias("revenue"),
                                                F.col("pred_cogs").alias("cogs"), F.lit("forecast").alias("kind"))
    return tail.unionByName(fc)


@register("tail_n_days", rounding={"revenue": 2, "cogs": 2}, extra_ctes=qb.BASE_CTES, sql=f"""
SELECT series_id, date, revenue, cogs FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM dense) t
WHERE rn <= {TAIL_DAYS}""")
def q_tail(spark, sf):
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc())
    d = qb.total_daily(spark, sf)
    return d.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= TAIL_DAYS).drop("rn")


@register("union_folds", rounding={"sum_abs_error": 4}, extra_ctes=FP, sql=" UNION ALL ".join(
    f"SELECT '{f}' AS fold, count(*) AS n_days, sum(abs(actual_revenue - pred_revenue)) AS sum_abs_error "
    f"FROM fold_predictions WHERE fold = '{f}'" for f, *_ in bt.FOLDS))
def q_union_folds(spark, sf):
    """The folds are one table already: one grouping gives all of them."""
    return preds(spark, sf).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(F.abs(F.col("actual_revenue") - F.col("pred_revenue"))).alias("sum_abs_error"))


@register("monthly_forecast_totals", rounding={"revenue": 2, "cogs": 2}, extra_ctes=qb.BASE_CTES, sql=f"""
SELECT strftime(date, '%Y-%m') AS month, sum(pred_revenue) AS revenue, sum(pred_cogs) AS cogs
FROM ({qb._pred_sql('horizon', 'series_id', False)}) p GROUP BY 1""")
def q_monthly(spark, sf):
    f = qb.baseline_forecast(spark, sf, round_to=None)
    return f.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("pred_revenue").alias("revenue"), F.sum("pred_cogs").alias("cogs"))


@register("forecast_summary", rounding={"total": 2, "mean": 4, "max": 2, "min": 2}, extra_ctes=qb.BASE_CTES, sql=f"""
SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS days, sum(pred_revenue) AS total,
       avg(pred_revenue) AS mean, max(pred_revenue) AS max, min(pred_revenue) AS min,
       count(*) FILTER (WHERE pred_revenue = 0) AS zero_days
FROM ({qb._pred_sql('horizon', 'series_id', False)}) q""")
def q_forecast_summary(spark, sf):
    f = qb.baseline_forecast(spark, sf, round_to=None)
    return f.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                 F.count(F.lit(1)).alias("days"), F.sum("pred_revenue").alias("total"),
                 F.avg("pred_revenue").alias("mean"), F.max("pred_revenue").alias("max"),
                 F.min("pred_revenue").alias("min"),
                 F.count(F.when(F.col("pred_revenue") == 0, 1)).alias("zero_days"))


# ------------------------------------------------------------ §2.5 windows


@register("lag_diff", sql="""
SELECT customer_id, order_id, order_date,
       CAST(date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id),
                      order_date) AS INTEGER) AS gap_days
FROM fx_orders""")
def q_lag_diff(spark, sf):
    o = b.orders(b.Sources(spark, sf)).select("customer_id", "order_id", "order_date")
    return rel.lag_diff(o, ["customer_id"], "order_date", "order_id", out="gap_days")


@register("pct_change", rounding={"revenue": 2, "yoy_pct": 9}, extra_ctes=[qb.SPINE_CTE, qb.DENSE_CTE], sql="""
SELECT year, revenue, revenue / nullif(lag(revenue) OVER (ORDER BY year), 0) - 1 AS yoy_pct
FROM (SELECT CAST(year(date) AS INTEGER) AS year, sum(revenue) AS revenue FROM dense GROUP BY 1) a""")
def q_pct_change(spark, sf):
    a = qb.total_daily(spark, sf).groupBy(F.year("date").alias("year")).agg(F.sum("revenue").alias("revenue"))
    # one row per year: the unpartitioned window sees a handful of rows
    w = Window.orderBy("year")
    return a.withColumn("yoy_pct", F.try_divide(F.col("revenue"), F.lag("revenue").over(w)) - 1)


@register("group_mean_broadcast", rounding={"revenue": 2, "year_mean": 4, "rev_norm": 9},
          extra_ctes=[qb.SPINE_CTE, qb.DENSE_CTE], sql="""
SELECT date, revenue, avg(revenue) OVER (PARTITION BY year(date)) AS year_mean,
       revenue / nullif(avg(revenue) OVER (PARTITION BY year(date)), 0) AS rev_norm
FROM dense""")
def q_group_mean(spark, sf):
    d = qb.total_daily(spark, sf)
    w = Window.partitionBy("series_id", F.year("date"))
    return d.select("date", "revenue", F.avg("revenue").over(w).alias("year_mean"),
                    F.try_divide(F.col("revenue"), F.avg("revenue").over(w)).alias("rev_norm"))


@register("sort_top_k", rounding={"revenue": 2}, sql=f"""
SELECT date, revenue FROM fx_sales ORDER BY revenue DESC, date LIMIT {TOP_K}""")
def q_top_k(spark, sf):
    return rel.sort_top_k(cm.sales_daily(spark, sf).select("date", "revenue"), "revenue", TOP_K, "date")


@register("argmax_group", rounding={"revenue": 2}, sql="""
SELECT series_id, sum(revenue) AS revenue FROM fx_sales_panel GROUP BY series_id
ORDER BY revenue DESC, series_id LIMIT 1""")
def q_argmax(spark, sf):
    tot = cm.panel_daily(spark, sf).groupBy("series_id").agg(F.sum("revenue").alias("revenue"))
    return rel.argmax_group(tot, "series_id", "revenue")
