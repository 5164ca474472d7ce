"""Panel models, sparse series, exact selection, cut windows, dyadic joins and the permutation deal against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vendora.functions import calendar as cal
from vendora.operators import calendar_ops as co
from vendora.operators import cut_windows as cw
from vendora.operators import diagnostics as dg
from vendora.operators import intervals as iv
from vendora.operators import panel_ridge as pr
from vendora.operators import permutation as pm
from vendora.operators import selection as sl
from vendora.operators import sparse_days as sd

LO, HI = dt.date(2018, 1, 1), dt.date(2020, 6, 30)
DAYS = [LO + dt.timedelta(i) for i in range((HI - LO).days + 1)]
FOLDS = [("early", "2018-12-31"), ("late", "2019-12-31"), ("all", None)]
NAMES = cal.feature_names()


@pytest.fixture(scope="module")
def features(spark):
    return co.feature_matrix(co.date_spine(spark, str(LO), str(HI))).orderBy("date").checkpoint()


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    rows = [(s, d, round(rng.lognormvariate(5, 1), 2), rng.choice([0.0, None, 7.5, float("nan")]))
            for s, share in (("a", 0.9), ("b", 0.2), (None, 0.5), ("young", 0.3)) for d in DAYS
            if rng.random() < share and (s != "young" or d.year > 2018)]
    return spark.createDataFrame(rows, "series string, date date, revenue double, cogs double").repartition(5)


def solve(x, y, alpha):
    mu, sigma = x.mean(axis=0), x.std(axis=0)
    sigma[np.isclose(sigma, 0, atol=1e-12)] = 1.0
    z = (x - mu) / sigma
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return mu, sigma, coef, y.mean()


@pytest.mark.parametrize("zero_days", ["drop", "keep"])
def test_ridge_equals_a_solve(panel, features, zero_days):
    known = pr.Calendar.of(features, NAMES)
    moments = pr.day_moments(panel, known, ["series"], ["revenue", "cogs"], FOLDS, zero_days=zero_days)
    fits = pr.fit(moments, known, ["series"], FOLDS, zero_days=zero_days, span=(str(LO), str(HI)))
    got = {(r.series, r.fold, r.target): r for r in fits.collect()}
    rows = {}
    for r in panel.collect():
        rows.setdefault(r.series, {})[r.date] = r
    n = 0
    for s, days in rows.items():
        for fold, end in FOLDS:
            last = dt.date.fromisoformat(end) if end else HI
            for t in ("revenue", "cogs"):
                y = {d: r[t] for d, r in days.items() if d <= last and r[t] is not None and np.isfinite(r[t])}
                use = [d for d in DAYS if d <= last and (zero_days == "keep" or y.get(d, 0) > 0)]
                if not use or (zero_days == "keep" and not any(d <= last for d in days) and (s, fold, t) not in got):
                    continue
                x = known.x[[(d - LO).days for d in use]]
                mu, sigma, coef, mean = solve(x, np.log([max(y.get(d, 0.0), 1.0) for d in use]), pr.ALPHA)
                r = got[s, fold, t]
                assert r.n == len(use)
                np.testing.assert_allclose(r.mu, mu, rtol=1e-9, atol=1e-9)
                np.testing.assert_allclose(r.sigma, sigma, rtol=1e-8, atol=1e-9)
                np.testing.assert_allclose(r.coef, coef, rtol=1e-8, atol=1e-8)
                assert r.intercept == pytest.approx(mean, abs=1e-9)
                n += 1
    assert n >= 20


def test_moments_add_up(features):
    """Blocks of any cut give the moments of the whole."""
    known = pr.Calendar.of(features, NAMES)
    y = np.random.default_rng(1).normal(size=len(known.x))
    whole = pr.Moments.of(known.x, y)
    parts = [pr.Moments.of(known.x[a:b], y[a:b]) for a, b in ((0, 1), (1, 40), (40, 500), (500, len(y)))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    assert total.n == whole.n
    np.testing.assert_allclose(total.xx, whole.xx, rtol=1e-9, atol=1e-7)
    np.testing.assert_allclose(total.xy, whole.xy, rtol=1e-9, atol=1e-7)


def test_predictions(panel, features):
    known = pr.Calendar.of(features, NAMES)
    fits = pr.fit(pr.day_moments(panel, known, ["series"], ["revenue"], FOLDS), known, ["series"], FOLDS)
    got = {(r.series, r.date): r.pred for r in pr.predict(fits, known, ["series"], {"late": ("2020-01-01", "2020-06-30")}).collect()}
    fit = {r.series: r for r in fits.filter("fold = 'late'").collect()}
    assert len(got) == 182 * len(fit)
    for (s, d), p in list(got.items())[::50]:
        f = fit[s]
        want = np.exp((known.x[(d - LO).days] - f.mu) / f.sigma @ np.array(f.coef) + f.intercept)
        assert p == pytest.approx(want, rel=1e-9)


def test_ridge_edges(spark, features):
    known = pr.Calendar.of(features, NAMES)
    schema = "series string, date date, revenue double"
    fit = lambda rows, **kw: pr.fit(pr.day_moments(spark.createDataFrame(rows, schema), known, ["series"], ["revenue"], FOLDS, **kw), known, ["series"], FOLDS, **kw).collect()
    assert fit([]) == []
    assert fit([("s", DAYS[0], None), ("s", DAYS[1], float("nan")), ("s", DAYS[2], 0.0)]) == []
    one = fit([("s", DAYS[0], 20.0)])
    assert {r.fold for r in one} == {f for f, _ in FOLDS} and all(r.n == 1 and not any(r.coef) and r.intercept == pytest.approx(np.log(20)) for r in one)
    with pytest.raises(ValueError):
        pr.Calendar.of(features.filter("date <> '2019-05-05'"), NAMES)


# --- sparse days ------------------------------------------------------------------------------------

def test_runs_cover_every_day_once(spark, panel, features):
    runs = sd.day_runs(panel, ["series"], "date", ["revenue"], str(LO), str(HI))
    back = {(r.series, r.date): r.revenue for r in sd.expand(runs, ["series"], ["revenue"]).collect()}
    dense = {(r.series, r.date): r.revenue for r in panel.collect()}
    assert back == {(s, d): dense.get((s, d), 0.0) for s in ("a", "b", None, "young") for d in DAYS}
    assert runs.count() <= 2 * panel.count() + 4
    prefix = sd.prefix_sums(features, NAMES)
    got = {(r.series, r.feature): r for r in sd.feature_sums(runs, prefix, ["series"], NAMES).collect()}
    x = pr.Calendar.of(features, NAMES).x
    for s in ("a", None):
        zero = np.array([(s, d) not in dense for d in DAYS])
        for j, name in enumerate(NAMES):
            r = got[s, name]
            assert (r.n_days, r.n_zero_days) == (len(DAYS), int(zero.sum()))
            assert r.sum_all == pytest.approx(x[:, j].sum(), abs=1e-6) and r.sum_zero == pytest.approx(x[zero, j].sum(), abs=1e-6)


def test_run_edges(spark):
    df = spark.createDataFrame([("s", DAYS[3], 1.0), ("s", DAYS[3], 2.0), ("s", None, 9.0), ("t", DAYS[0], None)], "k string, date date, v double")
    got = sorted((r.k, r.start, r.n_days, r.is_gap, r.v) for r in sd.day_runs(df, ["k"], "date", ["v"]).collect())
    assert got == [("s", DAYS[0], 3, True, 0.0), ("s", DAYS[3], 1, False, 3.0), ("t", DAYS[0], 1, False, 0.0), ("t", DAYS[1], 3, True, 0.0)]
    assert sd.day_runs(df.limit(0), ["k"], "date", ["v"]).collect() == []


# --- selection --------------------------------------------------------------------------------------

@pytest.mark.parametrize("small", [sl.SMALL, 0])
def test_quantiles_of_hot_and_odd_values(spark, monkeypatch, small):
    """Half of the rows share a value; magnitudes from denormal to the largest; both ways of keeping the ranges."""
    monkeypatch.setattr(sl, "SMALL", small)
    rng = np.random.default_rng(2)
    groups = {"hot": [5.0] * 500 + rng.normal(5, 1, 500).tolist(), "wide": [float(f"{m}e{e}") for m in (1, -3) for e in range(-320, 309, 9)],
              "one": [2.5], "same": [7.0] * 30, None: rng.integers(0, 4, 99).astype(float).tolist(), "zero": [0.0, -0.0, 1e-320, 5e-324]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("nothing", None), ("same", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for buffer in (0, 60, sl.BUFFER):
        got = {(r.g, r.q): (r.quantile, r.n) for r in sl.exact_quantiles(df, ["g"], "v", qs, buffer=buffer).collect()}
        assert set(got) == {(g, q) for g in groups for q in qs}
        for (g, q), (v, n) in got.items():
            assert n == len(groups[g]) and v == pytest.approx(np.quantile(groups[g], q), rel=1e-12, abs=1e-300)
    assert sl.exact_quantile(df.filter("false"), ["g"], "v", 0.5, buffer=0).collect() == []
    alone = sl.exact_quantiles(df.filter("g = 'hot'"), [], "v", [0.5], buffer=0).collect()
    assert alone[0].quantile == np.median(groups["hot"])


def test_counting_passes_spread_a_hot_value(spark):
    """What a pass shuffles are bins: few rows, though one value has half of all."""
    df = spark.range(0, 200_000, 1, 16).selectExpr("'g' AS g", "CASE WHEN id % 2 = 0 THEN 1.0 ELSE rand(3) * 2 END AS v")
    state = [{"_k0": "g", "_rank": 99_999, "_lo": 0.0, "_hi": 2.0, "_left": 99_999}]
    rows = df.select(F.col("g").alias("_k0"), F.col("v").alias("_v"))
    side = F.broadcast(spark.createDataFrame(state, "_k0 string, _rank long, _lo double, _hi double, _left long"))
    hit = sl._narrowed(rows, side, ["_k0"], 1024).collect()
    assert len(hit) == 1 and hit[0]._lo == hit[0]._hi == 1.0 or hit[0]._hi - hit[0]._lo < 2 / 1000
    want = np.median([r.v for r in df.collect()])
    assert sl.exact_quantile(df, ["g"], "v", 0.5, buffer=0).first().quantile == want


# --- windows and joins ------------------------------------------------------------------------------

def test_cut_windows(spark):
    rng = random.Random(8)
    rows = [("k", d, rng.random()) for d in DAYS if rng.random() < 0.4] + [(None, DAYS[9], 1.0), (None, DAYS[400], 3.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double").repartition(4)
    for block in (7, 29, 365, 10_000):
        got = {(r.k, r.date): r.m for r in cw.range_frame(df, ["k"], F.unix_date("date"), 29, {"m": F.sum("v")}, block).collect()}
        assert len(got) == len(rows)
        for k, d, _ in rows:
            assert got[k, d] == pytest.approx(sum(v for k2, e, v in rows if k2 == k and 0 <= (d - e).days <= 29))
        prev = {(r.k, r.date): (r._prev_date, r._prev_v) for r in cw.previous(df, ["k"], "date", F.unix_date("date"), ["date", "v"], block).collect()}
        last = {}
        for k, d, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            assert prev[k, d] == last.get(k, (None, None))
            last[k] = (d, v)


def test_one_group_is_many_window_groups(spark):
    df = spark.createDataFrame([("k", d, 1.0) for d in DAYS], "k string, date date, v double")
    halo = cw.with_halo(df, F.unix_date("date"), 30, 29)
    per = {r._block: r["count"] for r in halo.groupBy("_block").count().collect()}
    assert len(per) > len(DAYS) / 31 and max(per.values()) <= 59


@pytest.mark.parametrize("unit", ["second", "microsecond", "day", "number"])
def test_interval_join(spark, unit):
    rng = random.Random(6)
    start = dt.datetime(2001, 2, 3, 4, 5, 6)
    moment = lambda: start + dt.timedelta(seconds=rng.randrange(-40_000_000, 200_000_000), microseconds=rng.randrange(3))
    if unit == "number":
        moment = lambda: rng.randrange(-50, 50)
    kind = "long" if unit == "number" else "timestamp"
    points = [(i, moment()) for i in range(150)] + [(150, None)]
    points += [points[0]]
    windows = []
    for i in range(60):
        a, b = sorted((moment(), moment()))
        windows.append((f"w{i}", a, b))
    windows += [("back", windows[0][2], windows[0][1]), ("open", None, windows[0][2]), ("point", points[3][1], points[3][1]), windows[5]]
    p = spark.createDataFrame(points, f"id long, at {kind}")
    w = spark.createDataFrame(windows, f"name string, start {kind}, stop {kind}")
    trunc = {"second": lambda x: x.replace(microsecond=0), "microsecond": lambda x: x, "day": lambda x: x.date(), "number": lambda x: x}[unit]
    want = sorted((i, n) for i, x in points for n, a, b in windows if None not in (x, a, b) and trunc(a) <= trunc(x) <= trunc(b))
    got = sorted((r.id, r.name) for r in iv.interval_join(p, w, "at", "start", "stop", unit).collect())
    assert got == want and len(want) > 100
    counts = sorted((r.name, r.n_points) for r in iv.count_in_windows(p, w, "at", "start", "stop", unit).collect())
    assert counts == sorted((n, sum(1 for _, x in points if None not in (x, a, b) and trunc(a) <= trunc(x) <= trunc(b))) for n, a, b in windows)


def test_pieces_are_few(spark):
    w = spark.createDataFrame([(0, 3_000_000_000), (-17, 10 ** 15), (5, 5)], "a long, b long")
    got = iv.pieces(w, F.col("a"), F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.expr("pow(2, _level)")).alias("size")).collect()
    for r in got:
        assert r.size == r.b - r.a + 1 and r.n <= 2 * max(1, np.log2(r.b - r.a + 1))


# --- permutation ------------------------------------------------------------------------------------

def test_deal_is_a_permutation(spark):
    df = spark.createDataFrame([("a" if i < 400 else "b", i, float(i)) for i in range(600)], "s string, i long, v double").repartition(5)
    got = pm.deal(df, ["s", "i"], ["v"]).collect()
    assert sorted(r.v for r in got) == sorted(r.dealt_v for r in got) == [float(i) for i in range(600)]
    assert sum(r.v == r.dealt_v for r in got) < 20
    again = {r.i: r.dealt_v for r in pm.deal(df.repartition(2), ["s", "i"], ["v"]).collect()}
    assert again == {r.i: r.dealt_v for r in got}
    assert pm.deal(df.filter("false"), ["s", "i"], ["v"]).collect() == []


def test_linear_importance(spark):
    rng = np.random.default_rng(3)
    x, coef, sigma = rng.normal(size=(300, 3)), [2.0, 0.0, -0.5], [1.0, 2.0, 4.0]
    x[:, 2] = 1.5
    y = x @ (np.array(coef) / sigma) + rng.normal(size=300) * 0.1
    pred = x @ (np.array(coef) / sigma)
    df = spark.createDataFrame([(i, float(y[i]), float(pred[i]), x[i].tolist()) for i in range(300)], "i long, y double, p double, x array<double>")
    dealt = pm.deal(df, ["i"], ["x"]).withColumns({"c": F.lit(coef), "s": F.lit(sigma)}).checkpoint()
    got = {r.feature: r for r in pm.linear_importance(dealt, ["big", "none", "flat"], "y", "p", "x", "dealt_x", "s", "c").collect()}
    rows = dealt.collect()
    err = np.array([abs(r.y - r.p) for r in rows])
    want = np.array([abs(r.y - r.p - 2.0 * (r.dealt_x[0] - r.x[0])) for r in rows])
    assert got["big"].delta_mae == pytest.approx((want - err).mean()) and got["big"].delta_mae > 1
    assert got["none"].delta_mae == 0 and got["flat"].delta_mae == 0


def test_rank_of_tied_values(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 2 else float(i)) for i in range(200)], "i long, residual double").repartition(6)
    got = sorted((r["rank"], r.residual) for r in dg.empirical_cdf(df, keys=["i"]).collect())
    assert [g[0] for g in got] == list(range(1, 201)) and [g[1] for g in got] == sorted(1.0 if i % 2 else float(i) for i in range(200))
