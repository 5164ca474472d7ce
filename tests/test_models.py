"""Model pieces: ridge closed form, weights, folds and blends."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vendora.operators import backtest as bt
from vendora.operators import models as md


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(500, 4)) * [1.0, 3.0, 0.5, 2.0] + [0.0, 1.0, -2.0, 5.0]
    y = X @ [1.5, -2.0, 0.7, 0.1] + 3.0 + rng.normal(scale=0.5, size=500)
    names = [f"x{i}" for i in range(4)]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)], names + ["y"])
    model, stats = md.fit_ridge(df, names, "y", 3.0)
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + 3.0 * np.eye(4), Z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-8)
    assert model.intercept == pytest.approx(y.mean(), abs=1e-8)
    assert [stats[n][1] for n in names] == pytest.approx(list(sd))


def test_era_and_quarter_weights(spark):
    df = spark.createDataFrame([(2013, 1), (2014, 2), (2018, 3), (2019, 3)], "y int, q int")
    got = df.select(md.era_weight(F.col("y")).alias("e"),
                    md.quarter_weight(F.col("y"), F.col("q"), 3).alias("w")).collect()
    assert [r.e for r in got] == [0.01, 1.0, 1.0, 0.01]
    assert [r.w for r in got] == [0.01, 1.0, 2.0, 0.02]


def test_blend_weights_sum_to_one():
    c = md.EnsembleConfig()
    assert c.w_ridge + c.w_trend + c.w_trees == pytest.approx(1.0)


def test_external_blend_absent_forecast_keeps_tree_weight(spark):
    cfg = md.EnsembleConfig()
    df = spark.createDataFrame([(10.0, None), (10.0, 20.0)], "p double, ext double")
    got = [r.b for r in df.select(md.external_blend(F.col("p"), F.col("p"), F.col("p"), F.col("ext"),
                                                    cfg, 0.1).alias("b")).collect()]
    assert got == pytest.approx([10.0, 0.9 * 10.0 + 0.1 * 20.0])


def test_folds_never_leak(spark):
    days = [(dt.date(2019, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(4 * 366)]
    daily = spark.createDataFrame(days, "date date, revenue double")
    a = bt.assign_folds(daily, bt.folds_df(spark))
    s = {(r.fold, r.role): r for r in bt.fold_summary(a).collect()}
    for f, *_ in bt.FOLDS:
        assert s[(f, "train")].max_date < s[(f, "val")].min_date


def test_specialist_compose_picks_own_quarter(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (3, 1.0, 2.0, 3.0, 4.0)], "q int, a double, b double, c double, d double")
    out = md.specialist_compose(df, F.col("q"), {1: "a", 2: "b", 3: "c", 4: "d"}, "s").collect()
    assert [r.s for r in out] == [1.0, 3.0]


def seasonal(spark, n=4 * 365, zero_every=0):
    """Seeded daily series with a yearly and a weekly season and noise; features by date."""
    from vendora.operators import calendar_ops as co
    rng = np.random.default_rng(11)
    start, rows = dt.date(2018, 1, 1), []
    for i in range(n):
        d = start + dt.timedelta(days=i)
        v = 1000 * (1 + 0.5 * np.sin(2 * np.pi * d.timetuple().tm_yday / 365.25)) * (1.6 if d.weekday() >= 5 else 1.0) * np.exp(rng.normal(0, 0.05))
        if zero_every and i % zero_every == 0:
            v = 0.0
        rows.append(("s", d, "train" if i < n - 200 else "score", float(v), float(v) * 0.6))
    df = spark.createDataFrame(rows, "series_id string, date date, role string, revenue double, cogs double")
    known = F.col("role") == "train"
    hidden = df.select("series_id", "date", "role", *[F.when(known, F.col(t)).alias(t) for t in ("revenue", "cogs")])
    return df, hidden, co.feature_matrix(df.select("date"))


@pytest.mark.parametrize("zero_every", [0, 97])
def test_every_model_beats_the_mean_on_seasonal_data(spark, zero_every):
    df, hidden, feats = seasonal(spark, zero_every=zero_every)
    cfg = md.EnsembleConfig(trend_start=None)
    parts = md.fit_predict(hidden, feats, ["series_id"], cfg).cache()
    truth = {r.date: r.revenue for r in df.filter("role = 'score'").collect()}
    mean = df.filter("role = 'train'").agg(F.avg("revenue")).first()[0]
    bar = np.mean([abs(v - mean) for v in truth.values()])
    got = {}
    for r in parts.filter("target = 'revenue'").collect():
        got.setdefault(r.component, []).append(abs(truth[r.date] - r.pred))
    assert set(got) == set(md.COMPONENTS) and all(len(v) == 200 for v in got.values())
    for c, e in got.items():
        assert np.mean(e) < 0.75 * bar, c
    whole = [abs(truth[r.date] - r.revenue) for r in md.compose(parts, ["series_id"], cfg).collect()]
    assert len(whole) == 200 and np.mean(whole) < 0.5 * bar


def test_predictions_come_after_the_last_fitted_day(spark):
    _, hidden, feats = seasonal(spark, 800)
    out = md.fit_predict(hidden, feats, ["series_id"], md.EnsembleConfig(trend_start=None), components=("ridge",))
    r = out.agg(F.max("train_end").alias("a"), F.min("date").alias("b")).first()
    assert r.a < r.b


def test_trend_start_without_days_raises(spark):
    _, hidden, feats = seasonal(spark, 400)
    with pytest.raises(Exception, match="trend_start"):
        md.fit_predict(hidden, feats, ["series_id"], md.EnsembleConfig(trend_start="2030-01-01"), components=("trend",)).collect()


def test_importance_of_a_constant_column_is_zero(spark):
    _, hidden, feats = seasonal(spark, 800)
    from vendora.functions import calendar as cal
    names = [*cal.feature_names(), "flat"]
    got = md.importance(hidden.filter("role = 'train'"), feats.withColumn("flat", F.lit(1.0)), ["series_id"], "revenue", len(names), names=names).collect()
    assert len(got) == len(names) and all(r.perm_delta_mae is not None for r in got)
    flat = next(r for r in got if r.feature == "flat")
    assert flat.gain_importance == 0 and flat.perm_delta_mae == 0
    assert max(r.perm_delta_mae for r in got) > 0


def test_holdout_per_series(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d)) for d in range(1, 11)] + [("b", dt.date(2021, 1, d)) for d in range(1, 6)], "s string, date date")
    got = md.holdout_flag(df, "date", 3, keys=["s"]).groupBy("s").agg(F.sum("is_holdout").alias("n")).collect()
    assert {r.s: r.n for r in got} == {"a": 3, "b": 3}


def test_two_outside_forecasts_take_their_weights_from_the_trees(spark):
    cfg = md.EnsembleConfig()
    df = spark.createDataFrame([(10.0, None, None), (10.0, 20.0, None), (10.0, 20.0, 40.0)], "p double, e1 double, e2 double")
    p = F.col("p")
    got = [r.b for r in df.select(md.external_blend(p, p, p, [F.col("e1"), F.col("e2")], cfg, [0.1, 0.05]).alias("b")).collect()]
    assert got == pytest.approx([10.0, 11.0, 0.85 * 10 + 2 + 2])


def test_panel_groups_are_independent(spark):
    df, hidden, feats = seasonal(spark, 600)
    two = hidden.unionByName(hidden.withColumn("series_id", F.lit("t")).withColumns({t: F.col(t) * 3 for t in ("revenue", "cogs")}))
    cfg = md.EnsembleConfig(trend_start=None)
    out = md.fit_predict(two, feats, ["series_id"], cfg, components=("ridge",)).filter("target = 'revenue'").collect()
    by = {s: {r.date: r.pred for r in out if r.series_id == s} for s in ("s", "t")}
    assert len(by["s"]) == 200 and all(by["t"][d] == pytest.approx(3 * v) for d, v in by["s"].items())
