"""Model keys and feature importance (§2.9).

Model fits have no SQL twin (rows-only check, plus the closed-form and
property tests under tests/); which days a backtest predicted is SQL-checked.  Weights, splits, z-score statistics and the
blending arithmetic are SQL-checked: the blends run on given prediction
columns (the baseline backtest and its seasonal-naive companion), so their
arithmetic is verified independently of any fit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.functions import calendar as cal
from vendora.operators import backtest as bt
from vendora.operators import calendar_ops as co
from vendora.operators import diagnostics as dg
from vendora.operators import models as md
from vendora.plans import common as cm
from vendora.plans import q_baseline as qb
from vendora.plans import q_calendar as qc
from vendora.plans import q_diagnostics as qd
from vendora.plans.registry import register
from vendora.session import scratch_path
from vendora.sources import csv_io as io

CFG = md.EnsembleConfig()
CAL_FACTORS = {"revenue": 1.31, "cogs": 1.32}   # fixed values: the final refit's level factors
QUANTILE_LEVELS = [0.1, 0.5, 0.75, 0.9]          # fixed values: levels of the outside forecast
EXTERNAL_WEIGHTS = [0.10, 0.05]   # of the two outside forecasts


def train_frame(spark, sf):
    return qc.training_frame(spark, sf)


TF_CTES = qc.FEATURE_CTES + [("tf", qc.feature_matrix_sql(
    ", coalesce(x.revenue, 0) AS revenue, coalesce(x.cogs, 0) AS cogs", "LEFT JOIN fx_sales x ON x.date = s.date"))]


@register("zscore_features", rounding={"mu": 6, "sigma": 6}, extra_ctes=TF_CTES, sql="\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, avg({f}) AS mu, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS sigma"
    f" FROM tf" for f in cal.feature_names()))
def q_zscore(spark, sf):
    return md.zscore_stats(train_frame(spark, sf), cal.feature_names())


@register("era_weights", extra_ctes=TF_CTES, sql=f"""
SELECT date, CASE WHEN year(date) BETWEEN {md.EnsembleConfig.era_first_year} AND {md.EnsembleConfig.era_last_year}
                  THEN {md.EnsembleConfig.era_weight} ELSE {md.EnsembleConfig.off_era_weight} END AS weight FROM tf""")
def q_era(spark, sf):
    return train_frame(spark, sf).select("date", md.era_weight(F.year("date")).alias("weight"))


@register("quarter_weights", extra_ctes=TF_CTES, sql=f"""
SELECT tf.date, q.q AS target_quarter,
       (CASE WHEN year(tf.date) BETWEEN {md.EnsembleConfig.era_first_year} AND {md.EnsembleConfig.era_last_year}
             THEN {md.EnsembleConfig.era_weight} ELSE {md.EnsembleConfig.off_era_weight} END)
       * (CASE WHEN quarter(tf.date) = q.q THEN {md.EnsembleConfig.q_boost} ELSE 1.0 END) AS weight
FROM tf, (SELECT * FROM (VALUES (1), (2), (3), (4)) v(q)) q""")
def q_qweights(spark, sf):
    t = train_frame(spark, sf).select("date", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)])).alias("target_quarter"))
    return t.select("date", "target_quarter",
                    md.quarter_weight(F.year("date"), F.quarter("date"), 1).alias("_w1"),
                    md.quarter_weight(F.year("date"), F.quarter("date"), 2).alias("_w2"),
                    md.quarter_weight(F.year("date"), F.quarter("date"), 3).alias("_w3"),
                    md.quarter_weight(F.year("date"), F.quarter("date"), 4).alias("_w4")) \
            .select("date", "target_quarter",
                    F.when(F.col("target_quarter") == 1, F.col("_w1")).when(F.col("target_quarter") == 2, F.col("_w2"))
                     .when(F.col("target_quarter") == 3, F.col("_w3")).otherwise(F.col("_w4")).alias("weight"))


@register("holdout_split", extra_ctes=TF_CTES, sql=f"""
SELECT date, CAST(date > (SELECT max(date) FROM tf) - INTERVAL {md.EnsembleConfig.holdout_days} DAY AS INTEGER)
         AS is_holdout FROM tf""")
def q_holdout(spark, sf):
    return md.holdout_flag(train_frame(spark, sf).select("date"), "date", md.EnsembleConfig.holdout_days)


# ------------------------------------------------------------ model fits (rows)

def role_rows(spark, sf):
    """Company total: all days to train, the horizon to score."""
    daily = qb.total_daily(spark, sf)
    known = daily.select("series_id", "date", F.lit("train").alias("role"), *qb.VALUES)
    ahead = qb.horizon(spark, daily).select("series_id", "date", F.lit("score").alias("role"),
                                            *[F.lit(None).cast("double").alias(v) for v in qb.VALUES])
    return known.unionByName(ahead)


def fold_rows(spark, sf):
    """All folds at once: the training days, and the validation days without their values."""
    a = bt.assign_folds(qb.total_daily(spark, sf), bt.folds_df(spark))
    val = F.col("role") == "val"
    return a.select("fold", "series_id", "date", F.when(val, "score").otherwise("train").alias("role"),
                    *[F.when(~val, F.col(v).cast("double")).alias(v) for v in qb.VALUES])


def all_features(rows):
    return co.feature_matrix(rows.select("date"))


def horizon_components(spark, sf):
    """Every component's forecast of the horizon, fitted once for all keys that show it."""
    def build():
        rows = role_rows(spark, sf)
        return md.fit_predict(rows, all_features(rows), ["series_id"], CFG).drop("series_id")
    return cm.materialized(spark, sf, "horizon_components", build)


def _wide(spark, sf, components, prefix):
    c = horizon_components(spark, sf).filter(F.col("component").isin(*components))
    return c.groupBy("date").agg(*[F.max(F.when(F.col("target") == t, F.col("pred"))).alias(f"{prefix}_{t}") for t in CFG.targets])


@register("boosted_trees_base")
def q_trees(spark, sf):
    best = horizon_components(spark, sf).filter("component = 'trees'")
    return best.groupBy("date").agg(*[x for t in CFG.targets for x in (
        F.max(F.when(F.col("target") == t, F.col("pred"))).alias(f"trees_{t}"),
        F.max(F.when(F.col("target") == t, F.col("best_round"))).alias(f"best_iter_{t}"))])


@register("quarter_specialists")
def q_specialists(spark, sf):
    """Each specialist's forecast of every horizon day, with the rounds it used."""
    c = horizon_components(spark, sf).filter("component LIKE 'spec%'")
    return c.select("target", F.substring("component", 5, 1).cast("int").alias("quarter"), "date", "pred", F.col("best_round").alias("best_iter"))


@register("trend_season_model")
def q_trend(spark, sf):
    return _wide(spark, sf, ["trend"], "trend")


@register("ensemble_fit_predict")
def q_ensemble(spark, sf):
    return md.compose(horizon_components(spark, sf), [], CFG).drop("train_end")


def ensemble_predictions(spark, sf):
    """Walk-forward predictions of the ensemble, refitted for each fold, calibration 1.0."""
    def build():
        rows = fold_rows(spark, sf)
        parts = md.fit_predict(rows, all_features(rows), ["fold", "series_id"], CFG)
        p = md.compose(parts, ["fold", "series_id"], CFG).select("fold", "date", "train_end", *[F.col(t).alias(f"pred_{t}") for t in CFG.targets])
        actual = qb.total_daily(spark, sf).select("date", *[F.col(t).cast("double").alias(f"actual_{t}") for t in CFG.targets])
        return p.join(actual, "date")
    return cm.materialized(spark, sf, "ensemble_backtest", build)


@register("backtest_run")
def q_backtest(spark, sf):
    return ensemble_predictions(spark, sf).select("fold", "date", "actual_revenue", "actual_cogs", "pred_revenue", "pred_cogs")


@register("backtest_coverage", extra_ctes=[qc.SPINE_CTE, qb.DENSE_CTE, qb.FOLDS_CTE, qb.FOLD_TRAIN_CTE, qb.FOLD_VAL_CTE], sql="""
SELECT v.fold, count(*) AS n_days, min(v.date) AS first_day, max(v.date) AS last_day, any_value(t.last_train) AS last_train, true AS ordered
FROM f_val v JOIN (SELECT fold, max(date) AS last_train FROM f_train GROUP BY fold) t USING (fold) GROUP BY v.fold""")
def q_backtest_coverage(spark, sf):
    """Which days the ensemble's folds predicted, and the last day each was fitted on."""
    return ensemble_predictions(spark, sf).groupBy("fold").agg(
        F.count("*").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.max("train_end").alias("last_train"), (F.max("train_end") < F.min("date")).alias("ordered"))


@register("ensemble_fold_metrics")
def q_ensemble_metrics(spark, sf):
    return dg.metrics_summary(dg.fold_metrics(ensemble_predictions(spark, sf), ["fold"], qd.PAIRS))


@register("ensemble_spike_decomposition")
def q_ensemble_spikes(spark, sf):
    return dg.spike_decomposition(ensemble_predictions(spark, sf), ["fold"], "actual_revenue", "pred_revenue")


@register("ensemble_residual_stats")
def q_ensemble_residuals(spark, sf):
    return dg.residual_stats(ensemble_predictions(spark, sf).select((F.col("actual_revenue") - F.col("pred_revenue")).alias("residual")))


@register("ensemble_error_correlation")
def q_ensemble_correlation(spark, sf):
    """Errors of the model's walk-forward predictions against the outside forecast's, by fold."""
    return dg.error_correlation(ensemble_naive(spark, sf), ["fold"], "actual_revenue", "pred_revenue", "naive_revenue")


@register("ensemble_weight_sweep")
def q_ensemble_sweep(spark, sf):
    """What the model gains by each weight of the outside forecast."""
    return dg.weight_sweep(ensemble_naive(spark, sf), ["fold"], "actual_revenue", "pred_revenue", "naive_revenue")


def ensemble_naive(spark, sf):
    outside = qd.preds_naive(spark, sf).select("fold", "date", "naive_revenue")
    return ensemble_predictions(spark, sf).join(outside, ["fold", "date"])


def exported_ensemble(spark, sf):
    """The ensemble's forecast written as the submission and read back."""
    path = scratch_path(spark, "ensemble-submission")
    io.export_forecast(q_ensemble(spark, sf), path, horizon=qb.HORIZON_DAYS)
    back = spark.read.option("header", True).csv(path)
    return back.select("Date", F.col("Revenue").cast("double"), F.col("COGS").cast("double"))


@register("ensemble_export")
def q_ensemble_export(spark, sf):
    return exported_ensemble(spark, sf)


@register("ensemble_export_contract", extra_ctes=qb.BASE_CTES, sql="""
SELECT unnest(['row_count', 'revenue_not_null', 'cogs_not_null', 'revenue_non_negative', 'cogs_non_negative', 'days_of_the_horizon']) AS "check",
       CAST(unnest([0, 0, 0, 0, 0, (SELECT count(*) FROM horizon)]) AS BIGINT) AS failures""")
def q_ensemble_contract(spark, sf):
    """The five output checks of the exported ensemble, and how many of its days are the horizon's."""
    sub = exported_ensemble(spark, sf)
    ahead = qb.horizon(spark, qb.total_daily(spark, sf)).select(F.date_format("date", "yyyy-MM-dd").alias("Date"))
    inside = sub.join(ahead, "Date").agg(F.count("*").alias("failures")).select(F.lit("days_of_the_horizon").alias("check"), "failures")
    return io.export_contract(sub, qb.HORIZON_DAYS).unionByName(inside)


# ------------------------------------------------------------ panel

@register("panel_training_rows", sql="""
SELECT s.series_id, count(*) AS n_days, count(*) FILTER (WHERE coalesce(p.revenue, 0) > 0) AS n_selling_days
FROM (SELECT DISTINCT series_id FROM fx_sales_panel) s
CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT min(date) AS lo, max(date) AS hi FROM fx_sales_panel) b) d
LEFT JOIN fx_sales_panel p ON p.series_id = s.series_id AND p.date = d.date GROUP BY s.series_id""")
def q_panel_rows(spark, sf):
    return qc.training_frame(spark, sf, panel=True).groupBy("series_id").agg(
        F.count("*").alias("n_days"), F.count(F.when(F.col("revenue") > 0, 1)).alias("n_selling_days"))


@register("panel_forecast")
def q_panel_forecast(spark, sf):
    """Ridge and trend forecasts of the horizon for every region x category series."""
    dense = cm.panel_dense(spark, sf)
    known = dense.select("series_id", "date", F.lit("train").alias("role"), *qb.VALUES)
    hi = dense.agg(F.max("date").alias("hi")).select("hi").scalar()
    days = F.sequence(F.date_add(hi, 1), F.date_add(hi, qb.HORIZON_DAYS), F.expr("INTERVAL 1 DAY"))
    ahead = dense.select("series_id").distinct().select("series_id", F.explode(days).alias("date"))
    rows = known.unionByName(ahead.select("series_id", "date", F.lit("score").alias("role"), *[F.lit(None).cast("double").alias(v) for v in qb.VALUES]))
    out = md.fit_predict(rows, all_features(rows), ["series_id"], md.EnsembleConfig(trend_start=None), components=("ridge", "trend"))
    return out.select("series_id", "target", "component", "date", "pred")


# ------------------------------------------------------------ blends on given columns (SQL)
# Component mapping on the baseline backtest: base/ridge -> pred_revenue,
# specialist/trend -> naive_revenue (the seasonal-naive outside forecast).

BL1 = f"(1 - {CFG.alpha}) * pred_revenue + {CFG.alpha} * naive_revenue"


@register("blend_layer1", rounding={"layer1": 4}, extra_ctes=qd.FPN, sql=f"""
SELECT fold, date, {BL1} AS layer1 FROM preds_naive""")
def q_bl1(spark, sf):
    p = qd.preds_naive(spark, sf)
    return p.select("fold", "date", md.blend_layer1(F.col("pred_revenue"), F.col("naive_revenue"),
                                                    CFG.alpha).alias("layer1"))


@register("blend_layer2", rounding={"layer2": 4}, extra_ctes=qd.FPN, sql=f"""
SELECT fold, date, {CFG.w_ridge} * pred_revenue + {CFG.w_trend} * naive_revenue
                   + {CFG.w_trees} * ({BL1}) AS layer2 FROM preds_naive""")
def q_bl2(spark, sf):
    p = qd.preds_naive(spark, sf)
    l1 = md.blend_layer1(F.col("pred_revenue"), F.col("naive_revenue"), CFG.alpha)
    l2 = md.blend_layer2(F.col("pred_revenue"), F.col("naive_revenue"), l1, CFG.w_ridge,
                         CFG.w_trend, CFG.w_trees)
    return p.select("fold", "date", l2.alias("layer2"))


@register("calibrate", rounding={"revenue": 2, "cogs": 2}, extra_ctes=qd.FP, sql=f"""
SELECT fold, date, greatest({CAL_FACTORS['revenue']} * pred_revenue, 0) AS revenue,
       greatest({CAL_FACTORS['cogs']} * pred_cogs, 0) AS cogs FROM fold_predictions""")
def q_calibrate(spark, sf):
    p = qd.preds(spark, sf)
    return p.select("fold", "date", md.calibrate(F.col("pred_revenue"), CAL_FACTORS["revenue"]).alias("revenue"),
                    md.calibrate(F.col("pred_cogs"), CAL_FACTORS["cogs"]).alias("cogs"))


@register("specialist_compose", rounding={"composed": 4}, extra_ctes=qd.FPN, sql="""
SELECT fold, date, CAST(quarter(date) AS INTEGER) AS quarter,
       CASE quarter(date) WHEN 1 THEN pred_revenue WHEN 2 THEN pred_cogs WHEN 3 THEN actual_revenue ELSE actual_cogs END AS composed
FROM preds_naive""")
def q_compose(spark, sf):
    """Composition on given columns: each row takes its own quarter's."""
    p = qd.preds_naive(spark, sf)
    q = F.quarter("date")
    out = md.specialist_compose(p, q, {1: "pred_revenue", 2: "pred_cogs", 3: "actual_revenue", 4: "actual_cogs"}, "composed")
    return out.select("fold", "date", q.alias("quarter"), "composed")


# The second outside forecast: the day two years earlier, joined by (fold, date).
NAIVE2_CTE = ("preds_outside", """
    SELECT p.*, d.revenue AS naive2_revenue
    FROM preds_naive p JOIN folds f USING (fold)
    LEFT JOIN dense d ON d.date = CAST(p.date - INTERVAL 24 MONTH AS DATE) AND d.date <= f.train_end""")


def _ext_sql(cogs: bool) -> str:
    names, p = ["naive_revenue", "naive2_revenue"], "pred_cogs" if cogs else "pred_revenue"
    ws = [f"(CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0.0 END)" for n, w in zip(names, EXTERNAL_WEIGHTS)]
    ext = " + ".join(f"{w} * coalesce({n}, 0.0){' * ' + repr(md.EXTERNAL_COGS_RATIO) if cogs else ''}" for n, w in zip(names, ws))
    return f"{CFG.w_ridge} * {p} + {CFG.w_trend} * {p} + ({CFG.w_trees} - {' - '.join(ws)}) * {p} + {ext}"


@register("external_forecast_blend", rounding={"revenue": 2, "cogs": 2}, extra_ctes=qd.FPN + [NAIVE2_CTE], sql=f"""
SELECT fold, date, greatest({_ext_sql(False)}, 0) AS revenue, greatest({_ext_sql(True)}, 0) AS cogs
FROM preds_outside""")
def q_external(spark, sf):
    """Two outside revenue forecasts (the same day one and two years earlier), joined by
    fold and date, blended into a model whose three components are all the baseline
    here; cogs take 0.88 of them."""
    p = qd.preds_naive(spark, sf)
    outside = (qb.total_daily(spark, sf).select(F.add_months("date", 24).alias("date"), F.col("date").alias("src"), F.col("revenue").alias("naive2_revenue"))
               .join(F.broadcast(bt.folds_df(spark).select("fold", "train_end"))).filter(F.col("src") <= F.col("train_end")))
    # the month end of a leap year has two days mapped to one; the SQL twin takes the day itself
    outside = outside.filter(F.add_months("date", -24) == F.col("src")).select("fold", "date", "naive2_revenue")
    p = p.join(outside, ["fold", "date"], "left")
    out = []
    for t, is_cogs in (("revenue", False), ("cogs", True)):
        c = F.col(f"pred_{t}")
        out.append(md.calibrate(md.external_blend(c, c, c, [F.col("naive_revenue"), F.col("naive2_revenue")], CFG, EXTERNAL_WEIGHTS, is_cogs), 1.0).alias(t))
    return p.select("fold", "date", *out)


# ------------------------------------------------------------ quantile forecast (SQL)



@register("quantile_select", rounding={"yhat_q75": 4, "yhat_q60": 4}, extra_ctes=qb.FOLD_PRED_CTES + [
    ("qlong", f"""
        SELECT fold, date, unnest([{", ".join(repr(q) for q in QUANTILE_LEVELS)}]) AS level, unnest(qs) AS yhat
        FROM (SELECT v.fold, v.date,
                     quantile_cont(t.revenue, [{", ".join(repr(q) for q in QUANTILE_LEVELS)}]) AS qs
              FROM f_val v JOIN f_train t
                ON t.fold = v.fold AND month(t.date) = month(v.date) AND day(t.date) = day(v.date)
              GROUP BY v.fold, v.date) x
        UNION ALL
        SELECT v.fold, v.date, NULL AS level, avg(t.revenue) AS yhat
        FROM f_val v JOIN f_train t ON t.fold = v.fold AND month(t.date) = month(v.date) AND day(t.date) = day(v.date)
        GROUP BY v.fold, v.date""")], sql="""
SELECT fold, date,
       greatest(coalesce(max(yhat) FILTER (WHERE level = 0.75), max(yhat) FILTER (WHERE level = 0.5),
                         max(yhat) FILTER (WHERE level IS NULL)), 0) AS yhat_q75,
       greatest(coalesce(max(yhat) FILTER (WHERE level = 0.6), max(yhat) FILTER (WHERE level = 0.5),
                         max(yhat) FILTER (WHERE level IS NULL)), 0) AS yhat_q60
FROM qlong GROUP BY fold, date""")
def q_quantile_select(spark, sf):
    long = climatology_quantiles(spark, sf)
    return long.groupBy("fold", "date").agg(
        quantile_pick(0.75).alias("yhat_q75"), quantile_pick(0.6).alias("yhat_q60"))


def quantile_pick(level: float):
    """Named level, else the median, else the mean (level null); floor 0.
    Keyed on the numeric level (no label formatting)."""
    pick = lambda lv: F.max(F.when(F.col("level") == F.lit(lv), F.col("yhat")))
    mean = F.max(F.when(F.col("level").isNull(), F.col("yhat")))
    return F.greatest(F.coalesce(pick(level), pick(0.5), mean), F.lit(0.0))


def climatology_quantiles(spark, sf):
    """Outside quantile forecast per (fold, val day): quantiles of the training
    actuals on the same calendar day in earlier years (long format).  Groups
    are bounded by the number of training years."""
    a = bt.assign_folds(qb.total_daily(spark, sf), bt.folds_df(spark))
    tr = a.filter(F.col("role") == "train").select("fold", F.month("date").alias("m"), F.dayofmonth("date").alias("d"),
                                                   "revenue")
    qs = tr.groupBy("fold", "m", "d").agg(F.percentile("revenue", QUANTILE_LEVELS).alias("qs"),
                                         F.avg("revenue").alias("mean"))
    val = a.filter(F.col("role") == "val").select("fold", "date", F.month("date").alias("m"),
                                                  F.dayofmonth("date").alias("d"))
    j = val.join(qs, ["fold", "m", "d"], "left")     # a day without history keeps its row, with null quantiles
    levels = F.array(*[F.struct(F.lit(q).alias("level"), F.col("qs")[i].alias("yhat"))
                       for i, q in enumerate(QUANTILE_LEVELS)]
                     + [F.struct(F.lit(None).cast("double").alias("level"), F.col("mean").alias("yhat"))])
    return j.select("fold", "date", F.inline(levels))


# ------------------------------------------------------------ feature importance (rows)

TOP_FEATURES = 25


@register("feature_importance")
def q_importance(spark, sf):
    daily = qb.total_daily(spark, sf)
    return md.importance(daily, all_features(daily), ["series_id"], "revenue", TOP_FEATURES, CFG).drop("series_id")
