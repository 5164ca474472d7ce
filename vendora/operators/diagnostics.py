"""Backtest metrics and error diagnostics over a predictions table.

Input: a tidy predictions frame with a group column (``fold``, optionally a
series id), ``date``, an actual column and a prediction column.  Every
statistic is grouped by the group keys; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions.stats import norm_ppf
from vendora.operators.cut_windows import range_frame
from vendora.operators.relational import global_prefix
from vendora.operators.selection import exact_quantile

SPIKE_QUANTILE = 0.90
HIST_BINS = 60
ROLLING_DAYS = 30
BLOCK_DAYS = 365           # days of a window's block
# Outside-forecast weights and calibration grids.
SWEEP_WEIGHTS = [0.0, 0.05, 0.08, 0.10, 0.12, 0.15, 0.20]
CAL_REVENUE_RANGE = [1.18, 1.20, 1.22, 1.24, 1.26, 1.28, 1.30, 1.32]
CAL_COGS_RANGE = [1.28, 1.30, 1.32, 1.34, 1.36]


def error_metrics(df: DataFrame, keys: list[str], actual: str, pred: str, prefix: str = "") -> list:
    """MAE, RMSE, R^2 aggregate expressions (R^2 null when actuals are constant)."""
    e = F.col(actual) - F.col(pred)
    sse = F.sum(e * e)
    sst = F.count(F.col(actual)) * F.var_pop(actual)
    return [F.avg(F.abs(e)).alias(f"{prefix}mae"),
            F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
            (1 - sse / F.nullif(sst, F.lit(0.0))).alias(f"{prefix}r2")]


def fold_metrics(preds: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs``: name -> (actual col, pred col); columns <name>_mae, _rmse, _r2."""
    aggs = []
    for name, (a, p) in pairs.items():
        aggs += error_metrics(preds, keys, a, p, prefix=f"{name}_")
    return preds.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_days"))


def metrics_summary(metrics: DataFrame, key: str = "fold", label: str = "mean") -> DataFrame:
    """Per-fold rows plus one row of the mean over folds."""
    num = [c for c, t in metrics.dtypes if c != key and t in ("double", "float", "int", "bigint")]
    mean = metrics.agg(*[F.avg(c).alias(c) for c in num]).select(F.lit(label).alias(key), *num)
    return metrics.select(key, *[F.col(c).cast("double").alias(c) for c in num]).unionByName(mean)


def spike_decomposition(preds: DataFrame, keys: list[str], actual: str, pred: str,
                        q: float = SPIKE_QUANTILE) -> DataFrame:
    """Days with actual >= the group's q-quantile (linear) vs the rest.

    The quantile is exact and comes from counted bins, so a group may be of any size
    (all series of a fold, say) and no task holds its values.
    """
    j = preds.join(exact_quantile(preds, keys, actual, q, "threshold"), keys)
    spike = F.col(actual) >= F.col("threshold")
    err = F.abs(F.col(actual) - F.col(pred))
    return j.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.count(F.when(spike, 1)).alias("n_spike"),
        F.count(F.when(~spike, 1)).alias("n_normal"),
        F.avg(F.when(spike, err)).alias("mae_spike"),
        F.avg(F.when(~spike, err)).alias("mae_normal"),
        (F.sum(F.when(spike, err)) / F.nullif(F.sum(err), F.lit(0.0)) * 100).alias("pct_from_spikes"),
    )


def mae_band(preds: DataFrame, keys: list[str], actual: str, pred: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    mae = F.avg(F.abs(F.col(actual) - F.col(pred))).over(w)
    return preds.select(*keys, "date", F.col(pred).alias("pred"),
                        (F.col(pred) - mae).alias("band_lo"), (F.col(pred) + mae).alias("band_hi"))


def rolling_mae(preds: DataFrame, keys: list[str], actual: str, pred: str, days: int = ROLLING_DAYS) -> DataFrame:
    """Trailing ``days``-day mean absolute error, today included (pandas '30D').  A group's
    days are cut in blocks of a year with the days before as a halo, so one group spreads
    over many tasks."""
    err = preds.select(*keys, "date", F.abs(F.col(actual) - F.col(pred)).alias("abs_error"))
    return range_frame(err, keys, F.unix_date("date"), days - 1, {f"rolling_{days}d_mae": F.avg("abs_error")}, BLOCK_DAYS)


def residual_stats(res: DataFrame, col: str = "residual") -> DataFrame:
    """Mean, median, population std, skew and excess kurtosis (biased moments) of all rows.

    The median is exact and comes from counted bins: no sort, and a value that half of the
    rows share is counted where it is read."""
    values = res.select(col).filter(F.col(col).isNotNull())
    median = exact_quantile(values, [], col, 0.5, "median").select("median").scalar()
    moments = values.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                         F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurtosis"))
    return moments.select("n", "mean", median.alias("median"), "std", "skew", "kurtosis")


def residual_histogram(res: DataFrame, col: str = "residual", bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins from min to max; the last bin is closed on the right."""
    b = res.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = b.select("lo").scalar(), b.select("hi").scalar()
    width = (hi - lo) / bins
    # clamped on both sides: min/max come from a separate evaluation of the
    # input, whose floating sums may differ in the last bit
    idx = F.greatest(F.lit(0), F.least(F.floor((F.col(col) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins),
                                       F.lit(bins - 1)))
    h = res.select(F.coalesce(idx, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    every = res.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))      # empty bins too
    h = every.join(h, "bin", "left").fillna(0, ["n"])
    return h.select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "n")


def global_row_number(df: DataFrame, order_col: str, keys: list[str] | None = None, out: str = "rank") -> DataFrame:
    """1-based position in ``order_col`` order without a single-partition window.

    Equal values are ordered by ``keys`` (the rows' own key), so a value that many rows share is cut
    by them, and a task that runs again deals its rows as before."""
    return global_prefix(df, [order_col, *(keys or [])], None, rank_out=out).drop("cum")


def empirical_cdf(res: DataFrame, col: str = "residual", keys: list[str] | None = None) -> DataFrame:
    """(col, rank, cdf); ``keys`` tell rows with equal values apart."""
    keys = keys or []
    n = res.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    r = global_row_number(res.select(col, *keys), col, keys)
    return r.select(col, "rank", (F.col("rank") / n).alias("cdf"))


def qq_points(res: DataFrame, col: str = "residual", keys: list[str] | None = None) -> DataFrame:
    """Ordered values against normal quantiles at Filliben plotting positions,
    plus the least-squares line through them (as probplot does).  ``keys`` tell rows with equal
    values apart."""
    keys = keys or []
    n = res.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    r = global_row_number(res.select(col, *keys), col, keys)
    i = F.col("rank").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    m = (F.when(F.col("rank") == n, last).when(F.col("rank") == 1, 1 - last)
          .otherwise((i - 0.3175) / (n + 0.365)))
    # plotting position first, as its own column, so the approximation below
    # references a plain column instead of copying the position expression
    pts = (r.select("rank", m.alias("_m"), F.col(col).alias("ordered"))
            .select("rank", norm_ppf(F.col("_m")).alias("theoretical"), "ordered"))
    fit = pts.agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                  F.regr_intercept("ordered", "theoretical").alias("intercept"))
    return pts.select("*", fit.select("slope").scalar().alias("slope"),
                      fit.select("intercept").scalar().alias("intercept"))


def weight_sweep(preds: DataFrame, keys: list[str], actual: str, base: str, other: str,
                 weights=SWEEP_WEIGHTS) -> DataFrame:
    """MAE of (1-w)*base + w*other for each weight; absent other -> 0 (as in
    the reference).  Weights are exploded per row (a generator, no join)."""
    x = preds.select(*keys, actual, base, F.coalesce(F.col(other), F.lit(0.0)).alias("_o"),
                     F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w"))
    blend = (1 - F.col("w")) * F.col(base) + F.col("w") * F.col("_o")
    agg = x.groupBy(*keys, "w").agg(F.avg(F.abs(F.col(actual) - blend)).alias("mae"),
                                    F.avg(F.abs(F.col(actual) - F.col(base))).alias("mae_base"))
    return agg.withColumn("better", (F.col("mae") < F.col("mae_base")).cast("int")).drop("mae_base")


def error_correlation(preds: DataFrame, keys: list[str], actual: str, a: str, b: str) -> DataFrame:
    ea = F.col(actual) - F.col(a)
    eb = F.col(actual) - F.col(b)
    x = preds.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return x.groupBy(*keys).agg(F.corr(ea, eb).alias("error_corr"),
                                F.avg(F.abs(ea)).alias("mae_a"), F.avg(F.abs(eb)).alias("mae_b"),
                                F.count(F.lit(1)).alias("n"))
