"""Forecast models: ridge, boosted trees (base + quarter specialists), a trend-season
regression, and the blending layers.

Every (series, fold, target, component) is one group: its days, a calendar's worth of
rows, are fitted in one task by the small helpers of ``local_fit``, and all groups
run side by side, for one series or a panel of any width.  Date features are the same
for all series: one row per calendar day (bounded by the span), sent to the tasks
once, so that a group ships only its dates and values.

``fit_ridge`` is the distributed form of the ridge, for one model over a whole panel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendora.functions import calendar as cal
from vendora.functions.exprs import clip_floor
from vendora.operators import local_fit


@dataclass(frozen=True)
class EnsembleConfig:
    # Blend weights, eras and holdout that must equal the published model's.
    ridge_alpha: float = 3.0
    alpha: float = 0.60          # layer 1: specialist weight
    w_ridge: float = 0.10        # layer 2
    w_trend: float = 0.10
    w_trees: float = 0.80
    cal_revenue: float = 1.0     # layer 3
    cal_cogs: float = 1.0
    q_boost: float = 2.0
    era_weight: float = 1.0
    off_era_weight: float = 0.01
    era_first_year: int = 2014
    era_last_year: int = 2018
    holdout_days: int = 180
    # boosted trees: rounds go on until ``patience`` of them bring no gain on the holdout
    max_rounds: int = 1000
    patience: int = 40
    depth: int = 5
    rate: float = 0.05
    subsample: float = 0.85
    feature_share: float = 0.85
    min_leaf: int = 30
    bins: int = 32
    seed: int = 42
    zero_days: str = "drop"      # days without a positive value: "drop" or "keep" (as ln 1)
    trend_start: str | None = "2020-01-01"   # None: all history
    trend_changepoints: int = 10
    trend_yearly_order: int = 10
    trend_weekly_order: int = 3
    trend_reg: float = 0.1
    trend_hinge_reg: float = 10.0
    targets: tuple = ("revenue", "cogs")


# ------------------------------------------------------------------ weights

def era_weight(year: Column, cfg: EnsembleConfig = EnsembleConfig()) -> Column:
    return (F.when((year >= cfg.era_first_year) & (year <= cfg.era_last_year), F.lit(cfg.era_weight))
             .otherwise(F.lit(cfg.off_era_weight)))


def quarter_weight(year: Column, quarter: Column, target_q: int, cfg: EnsembleConfig = EnsembleConfig()) -> Column:
    return era_weight(year, cfg) * F.when(quarter == target_q, F.lit(cfg.q_boost)).otherwise(F.lit(1.0))


def holdout_flag(df: DataFrame, date_col: str = "date", days: int = 180, keys: list[str] | None = None) -> DataFrame:
    """is_holdout = date > max(date) - days (per series when keys are given)."""
    if keys:
        mx = F.max(date_col).over(Window.partitionBy(*keys))
        return df.withColumn("is_holdout", (F.col(date_col) > F.date_sub(mx, days)).cast("int"))
    mx = df.agg(F.max(date_col).alias("m")).select("m").scalar()
    return df.withColumn("is_holdout", (F.col(date_col) > F.date_sub(mx, days)).cast("int"))


# ------------------------------------------------------------------ z-score

def zscore_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mu, sigma) with population std; sigma 0 -> 1.

    One pass of ``Summarizer`` over the assembled vector (a single vector
    aggregate instead of two scalar aggregates per feature, which would be
    slow to compile with 81 features).
    """
    vec = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep").transform(df)
    s = vec.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    s = s.select(vector_to_array("s.mean").alias("mu"), vector_to_array("s.variance").alias("var"),
                 F.col("s.count").alias("n"))
    names = F.array(*[F.lit(f) for f in features])
    z = s.select(F.posexplode(names).alias("i", "feature"), "mu", "var", "n")
    sd = F.sqrt(F.col("var")[F.col("i")] * (F.col("n") - 1) / F.col("n"))
    return z.select("feature", F.col("mu")[F.col("i")].alias("mu"),
                    F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sigma"))


def standardized_vector(df: DataFrame, features: list[str], stats: dict, out: str = "zfeatures") -> DataFrame:
    cols = [((F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1])).alias(f"z__{f}") for f in features]
    z = df.select("*", *cols)
    return VectorAssembler(inputCols=[f"z__{f}" for f in features], outputCol=out).transform(z) \
        .drop(*[f"z__{f}" for f in features])


# ------------------------------------------------------------------ ridge

def fit_ridge(train: DataFrame, features: list[str], label: str, alpha: float) -> tuple:
    """Ridge on z-scored features: sklearn's ||r||^2 + alpha ||w||^2 equals
    Spark's normal-equation least squares with regParam = alpha * std(y) / n
    (Spark standardizes the label internally)."""
    srow = zscore_stats(train, features).collect()          # len(features) rows
    stats = {r.feature: (r.mu, r.sigma) for r in srow}
    lab = train.agg(F.stddev_pop(label).alias("s"), F.count(F.lit(1)).alias("n")).collect()[0]
    reg = alpha * (lab.s or 1.0) / lab.n
    data = standardized_vector(train, features, stats)
    lr = LinearRegression(featuresCol="zfeatures", labelCol=label, regParam=reg, elasticNetParam=0.0,
                          standardization=False, solver="normal", fitIntercept=True)
    return lr.fit(data), stats


def predict_ridge(model, stats, df: DataFrame, features: list[str], out: str) -> DataFrame:
    """exp of the ridge prediction on z-scored features.

    w.((x - mu) / sigma) + b is scored as w.(x / sigma) + b - sum(w mu / sigma):
    one element-wise scaling of the assembled ``features`` vector instead of
    one z column per feature (the shift only moves the constant)."""
    had_vec = "features" in df.columns
    v = df if had_vec else _assemble(df, features)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([1.0 / stats[f][1] for f in features]),
                               inputCol="features", outputCol="zfeatures")
    shift = float(sum(w * stats[f][0] / stats[f][1] for w, f in zip(model.coefficients.toArray(), features)))
    p = model.setFeaturesCol("zfeatures").setPredictionCol("_p").transform(scale.transform(v))
    p = p.withColumn(out, F.exp(F.col("_p") - F.lit(shift))).drop("_p", "zfeatures")
    return p if had_vec else p.drop("features")


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


# ------------------------------------------------------------------ grouped fits

COMPONENTS = ("ridge", "trend", "trees", "spec1", "spec2", "spec3", "spec4")


def promo_flag_names() -> list[str]:
    return [f"promo_{c.name}" for c in cal.campaigns()]


def _year_weight(dates: pd.DatetimeIndex, quarter: int | None, cfg: EnsembleConfig) -> np.ndarray:
    w = np.where((dates.year >= cfg.era_first_year) & (dates.year <= cfg.era_last_year), cfg.era_weight, cfg.off_era_weight)
    return w if quarter is None else w * np.where(dates.quarter == quarter, cfg.q_boost, 1.0)


def _trees(cfg: EnsembleConfig) -> local_fit.Trees:
    return local_fit.Trees(cfg.depth, cfg.rate, cfg.min_leaf, cfg.max_rounds, cfg.patience, cfg.subsample, cfg.feature_share, cfg.bins, cfg.seed)


def _training_rows(dates, y, role, cfg):
    use = (role == "train") & np.isfinite(y)
    if cfg.zero_days == "drop":
        use &= y > 0
    if not use.any():
        raise ValueError("a series has no training day with a value")
    return use, np.log(np.maximum(y[use], 1.0))


def fit_component(component: str, dates: pd.DatetimeIndex, x: np.ndarray, flags: np.ndarray, y: np.ndarray, role: np.ndarray, cfg: EnsembleConfig):
    """(prediction for the rows to score, rounds used or None) of one component."""
    use, ly = _training_rows(dates, y, role, cfg)
    score = role == "score"
    if component == "ridge":
        return np.exp(local_fit.ridge(x[use], ly, cfg.ridge_alpha)(x[score])), None
    if component == "trend":
        if cfg.trend_start is not None:
            recent = use & (dates >= pd.Timestamp(cfg.trend_start))
            if not recent.any():
                raise ValueError(f"no training day after trend_start {cfg.trend_start}; pass trend_start=None for all history")
            use, ly = recent, np.log(np.maximum(y[recent], 1.0))
        parts = lambda k: (dates.to_julian_date().to_numpy()[k], dates.dayofyear.to_numpy()[k], dates.dayofweek.to_numpy()[k], flags[k])
        f = local_fit.trend_season(*parts(use), ly, cfg.trend_changepoints, cfg.trend_yearly_order, cfg.trend_weekly_order, cfg.trend_reg, cfg.trend_hinge_reg)
        return np.exp(f(*parts(score))), None
    quarter = None if component == "trees" else int(component[-1])
    held = dates[use] > dates[use].max() - pd.Timedelta(days=cfg.holdout_days)
    t = _trees(cfg).fit(x[use], ly, _year_weight(dates[use], quarter, cfg), np.asarray(held))
    return np.exp(t.predict(x[score])), t.best_round


def _grid(features: DataFrame, names: list[str], date_col: str):
    """Date features as arrays: one row per calendar day."""
    pdf = features.select(date_col, *names).toPandas()
    order = np.argsort(pd.to_datetime(pdf[date_col]).to_numpy())
    return pd.to_datetime(pdf[date_col]).to_numpy()[order], pdf[names].to_numpy(np.float64)[order]


def fit_predict(rows: DataFrame, features: DataFrame, keys: list[str], cfg: EnsembleConfig = EnsembleConfig(),
                date_col: str = "date", components=COMPONENTS, names: list[str] | None = None) -> DataFrame:
    """Fit on the rows with role 'train', predict those with role 'score'.

    ``rows``: keys, date, role and the targets (null where unknown).  ``features``: one
    row per date.  Returns keys, target, component, date, pred, best_round, train_end
    (the last day that was fitted)."""
    names = names or cal.feature_names()
    days, x_all = _grid(features, names, date_col)
    flag_at = [names.index(f) for f in promo_flag_names() if f in names]
    known = rows.sparkSession.sparkContext.broadcast((days, x_all))
    key_types = [f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_d=pd.to_datetime(pdf[date_col])).sort_values("_d")
        dates = pd.DatetimeIndex(pdf["_d"])
        days, x_all = known.value
        x = x_all[np.searchsorted(days, dates.to_numpy())]
        role, y = pdf["role"].to_numpy(), pdf["y"].to_numpy(np.float64)
        pred, best = fit_component(pdf["component"].iloc[0], dates, x, x[:, flag_at], y, role, cfg)
        out = pdf.loc[role == "score", [*keys, "target", "component", date_col]].copy()
        out["pred"], out["best_round"] = pred, None if best is None else int(best)
        out["train_end"] = dates[role == "train"].max().date()
        return out

    long = rows.select(*keys, F.col(date_col).cast("date").alias(date_col), "role",
                       F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in cfg.targets])).alias("v"),
                       ).select(*keys, date_col, "role", "v.target", "v.y")
    long = long.withColumn("component", F.explode(F.array(*[F.lit(c) for c in components])))
    schema = ", ".join([*key_types, "target string", "component string", f"{date_col} date", "pred double", "best_round int", "train_end date"])
    return long.groupBy(*keys, "target", "component").applyInPandas(run, schema)


def compose(components: DataFrame, keys: list[str], cfg: EnsembleConfig = EnsembleConfig(), date_col: str = "date") -> DataFrame:
    """keys, date and one blended, calibrated column per target from ``fit_predict`` rows."""
    by = [*keys, date_col, "train_end"]
    wide = components.groupBy(*by).pivot("target", list(cfg.targets)).agg(
        *[F.max(F.when(F.col("component") == c, F.col("pred"))).alias(c) for c in COMPONENTS])
    outs = []
    for t in cfg.targets:
        wide = specialist_compose(wide, F.quarter(date_col), {q: f"{t}_spec{q}" for q in (1, 2, 3, 4)}, f"_{t}_spec")
        l1 = blend_layer1(F.col(f"{t}_trees"), F.col(f"_{t}_spec"), cfg.alpha)
        raw = blend_layer2(F.col(f"{t}_ridge"), F.col(f"{t}_trend"), l1, cfg.w_ridge, cfg.w_trend, cfg.w_trees)
        outs.append(calibrate(raw, cfg.cal_revenue if t == "revenue" else cfg.cal_cogs).alias(t))
    return wide.select(*by, *outs)


def importance(rows: DataFrame, features: DataFrame, keys: list[str], target: str, top: int, cfg: EnsembleConfig = EnsembleConfig(),
               date_col: str = "date", names: list[str] | None = None) -> DataFrame:
    """keys, feature, gain_importance, rank, perm_delta_mae of the ``top`` features of
    each series' base trees: the share of the gain, and how much the absolute error on
    the log scale grows when the feature's values are dealt out anew."""
    names = names or cal.feature_names()
    days, x_all = _grid(features, names, date_col)
    known = rows.sparkSession.sparkContext.broadcast((days, x_all))
    key_types = [f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_d=pd.to_datetime(pdf[date_col])).sort_values("_d")
        dates = pd.DatetimeIndex(pdf["_d"])
        days, x_all = known.value
        x = x_all[np.searchsorted(days, dates.to_numpy())]
        use, ly = _training_rows(dates, pdf["y"].to_numpy(np.float64), np.full(len(pdf), "train"), cfg)
        held = np.asarray(dates[use] > dates[use].max() - pd.Timedelta(days=cfg.holdout_days))
        x = x[use]
        model = _trees(cfg).fit(x, ly, _year_weight(dates[use], None, cfg), held)
        gain = model.gain / max(model.gain.sum(), 1e-12)
        base = np.mean(np.abs(ly - model.predict(x)))
        out = []
        for rank, j in enumerate(np.argsort(-gain, kind="stable")[:top], start=1):
            v = x.copy()
            v[:, j] = np.random.default_rng(cfg.seed + int(j)).permutation(v[:, j])
            out.append((names[j], float(gain[j]), rank, float(np.mean(np.abs(ly - model.predict(v))) - base)))
        got = pd.DataFrame(out, columns=["feature", "gain_importance", "rank", "perm_delta_mae"])
        for k in keys:
            got.insert(0, k, pdf[k].iloc[0])
        return got[[*keys, "feature", "gain_importance", "rank", "perm_delta_mae"]]

    src = rows.select(*keys, F.col(date_col).cast("date").alias(date_col), F.col(target).cast("double").alias("y"))
    schema = ", ".join([*key_types, "feature string, gain_importance double, rank int, perm_delta_mae double"])
    return src.groupBy(*keys).applyInPandas(run, schema)


def specialist_compose(df: DataFrame, quarter: Column, cols: dict, out: str) -> DataFrame:
    """Each row takes only its own quarter's specialist."""
    expr = None
    for q, c in cols.items():
        expr = F.when(quarter == q, F.col(c)) if expr is None else expr.when(quarter == q, F.col(c))
    return df.withColumn(out, expr)


# ------------------------------------------------------------------ blending

def blend_layer1(base: Column, specialist: Column, alpha: float) -> Column:
    return (1 - alpha) * base + alpha * specialist


def blend_layer2(ridge: Column, trend: Column, trees: Column, w_ridge: float, w_trend: float, w_trees: float) -> Column:
    return w_ridge * ridge + w_trend * trend + w_trees * trees


def calibrate(x: Column, factor: float) -> Column:
    return clip_floor(F.lit(factor) * x)


EXTERNAL_COGS_RATIO = 0.88   # fixed value: cogs share applied to an outside revenue forecast


def external_blend(ridge: Column, trend: Column, trees: Column, external, cfg: EnsembleConfig,
                   w_external, cogs: bool = False) -> Column:
    """Outside forecasts (one column or several, each with its weight) take their
    weights out of the tree weight; an absent one (null) has weight 0 and leaves the
    tree weight as it is."""
    external = external if isinstance(external, (list, tuple)) else [external]
    w_external = w_external if isinstance(w_external, (list, tuple)) else [w_external]
    ratio = EXTERNAL_COGS_RATIO if cogs else 1.0
    w_trees, outside = F.lit(cfg.w_trees), F.lit(0.0)
    for x, w in zip(external, w_external, strict=True):
        w_ext = F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        w_trees, outside = w_trees - w_ext, outside + w_ext * F.coalesce(x, F.lit(0.0)) * ratio
    return cfg.w_ridge * ridge + cfg.w_trend * trend + w_trees * trees + outside
