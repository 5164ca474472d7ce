"""Panel keys: models and sums of many series without a
series x days frame.

SQL writes the dense form out; Spark reads runs, moments and pieces, so each row checks one against the other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from vendora.functions import calendar as cal
from vendora.operators import backtest as bt
from vendora.operators import calendar_ops as co
from vendora.operators import cut_windows as cw
from vendora.operators import diagnostics as dg
from vendora.operators import intervals as iv
from vendora.operators import panel_ridge as pr
from vendora.operators import permutation as pm
from vendora.operators import relational as rel
from vendora.operators import selection as sl
from vendora.operators import sparse_days as sd
from vendora.plans import common as cm
from vendora.plans import q_baseline as qb
from vendora.plans import q_calendar as qc
from vendora.plans.registry import register

NAMES = cal.feature_names()
TARGETS = ["revenue", "cogs"]
KEYS = ["series_id"]
FOLDS = [(f, end) for f, end, _, _ in bt.FOLDS] + [("ALL", None)]       # ALL: up to the last day, for the forecast

# ------------------------------------------------------------ SQL side

_ARRAY = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in NAMES) + "]"
_FEATURES = "[" + ", ".join(f"'{c}'" for c in NAMES) + "]"
# one row for each day with its features as a list, so that joins meet days and not features
FEATURES_LONG = [("tf", qc.feature_matrix_sql()), ("tfa", f"SELECT date, {_ARRAY} AS x FROM tf")]
SPARSE_CTE = ("panel_and_total", """
    SELECT series_id, date, revenue, cogs FROM fx_sales_panel
    UNION ALL SELECT 'TOTAL' AS series_id, date, revenue, cogs FROM fx_sales""")
DENSE_PANEL_CTE = ("dense_panel", """
    SELECT s.series_id, d.date, coalesce(p.revenue, 0) AS revenue, coalesce(p.cogs, 0) AS cogs
    FROM (SELECT DISTINCT series_id FROM panel_and_total) s CROSS JOIN spine d
    LEFT JOIN panel_and_total p ON p.series_id = s.series_id AND p.date = d.date""")
FOLDS_CTE = ("folds", "SELECT fold, train_end FROM (" + qb.FOLDS_CTE[1] + ") f UNION ALL SELECT 'ALL', DATE '9999-12-31'")
CTES = qc.FEATURE_CTES + FEATURES_LONG + [SPARSE_CTE, FOLDS_CTE]

# ------------------------------------------------------------ Spark side


def sparse_panel(spark, sf):
    """Every region x category series and the company total: days with orders only."""
    total = cm.sales_daily(spark, sf).select(F.lit("TOTAL").alias("series_id"), "date", *TARGETS)
    return cm.panel_daily(spark, sf).select("series_id", "date", *TARGETS).unionByName(total)


def span(spark, sf):
    """First and last observed day."""
    r = cm.sales_daily(spark, sf).agg(F.min("date").cast("string").alias("lo"), F.max("date").cast("string").alias("hi")).first()
    return r.lo, r.hi


def calendar(spark, sf, ahead: int = 0):
    """Features of the observed days and ``ahead`` days more."""
    lo, hi = co.date_bounds(cm.sales_daily(spark, sf), "date")
    return pr.Calendar.of(co.feature_matrix(co.date_spine(spark, lo, F.date_add(hi, ahead))), NAMES)


def panel_fits(spark, sf, zero_days="drop"):
    """Ridge of every series, fold and target from one scan of the sparse panel."""
    def build():
        known = calendar(spark, sf)
        moments = pr.day_moments(sparse_panel(spark, sf), known, KEYS, TARGETS, FOLDS, zero_days=zero_days)
        return pr.fit(moments, known, KEYS, FOLDS, zero_days=zero_days, span=span(spark, sf))
    return cm.materialized(spark, sf, f"panel_fits_{zero_days}", build)


@register("panel_zscores", rounding={"total": 4, "sigma": 6}, extra_ctes=CTES, sql=f"""
SELECT series_id, fold, feature, count(*) AS n, sum(v) AS total, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS sigma
FROM (SELECT p.series_id, f.fold, unnest({_FEATURES}) AS feature, unnest(t.x) AS v
      FROM panel_and_total p JOIN folds f ON p.date <= f.train_end JOIN tfa t ON t.date = p.date WHERE p.revenue > 0) e
GROUP BY series_id, fold, feature""")
def q_zscores(spark, sf):
    """Means (as totals over n, which are whole numbers for most features) and deviations of the features over each series'
    selling days, by fold, out of the merged moments."""
    z = pr.zscores(panel_fits(spark, sf).filter("target = 'revenue'"), KEYS, NAMES)
    return z.select("series_id", "fold", "feature", "n", (F.col("mu") * F.col("n")).alias("total"), "sigma")


def _optimality(spark, sf, zero_days):
    """Is each fit the minimum?  The gradient of the penalised error, Z'(y - prediction) - alpha w, added up over the rows that
    were fitted, apart from the solver: 0 but for rounding.  Also n and the intercept, the mean of ln y."""
    fits = panel_fits(spark, sf, zero_days)
    rows = sparse_panel(spark, sf) if zero_days == "drop" else co.densify(sparse_panel(spark, sf), KEYS, "date", TARGETS)
    lo, hi = co.date_bounds(cm.sales_daily(spark, sf), "date")
    feats = co.feature_matrix(co.date_spine(spark, lo, hi)).select("date", F.array(*[F.col(c).cast("double") for c in NAMES]).alias("x"))
    long = rows.select("series_id", "date", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS])).alias("t"))
    long = long.select("series_id", "date", "t.target", "t.y").filter("y > 0" if zero_days == "drop" else "true")
    folds = spark.createDataFrame([(f, end or "9999-12-31") for f, end in FOLDS], "fold string, train_end string").withColumn("train_end", F.col("train_end").cast("date"))
    long = long.join(F.broadcast(folds), F.col("date") <= F.col("train_end")).drop("train_end")
    by = [*KEYS, "fold", "target"]
    own = F.log(F.greatest("y", F.lit(1.0))) - pr.score(F.col("x"), F.col("mu"), F.col("sigma"), F.col("coef"), F.col("intercept"))
    # the residuals are written, so that each is worked out once
    res = rel.materialize(long.join(fits.drop("n"), by).join(F.broadcast(feats), "date").select(*by, "date", own.alias("r")))
    j = res.join(F.broadcast(feats), "date").select(*by, "r", array_to_vector(F.transform("x", lambda a: a * F.col("r"))).alias("xr"))
    g = j.groupBy(*by).agg(Summarizer.sum(F.col("xr")).alias("xr"), F.sum("r").alias("r"), F.count("*").alias("n_rows")).join(fits, by)
    # sum of z r, from the sums of x r and r
    zr = F.zip_with(F.zip_with(vector_to_array("xr"), "mu", lambda s, m: s - m * F.col("r")), "sigma", lambda s, d: s / d)
    worst = F.array_max(F.zip_with(zr, "coef", lambda s, w: F.abs(s - pr.ALPHA * w)))
    return g.select(*by, F.col("n").alias("n_train"), "n_rows", "intercept", (worst <= 1e-8 * F.col("n_rows") + 1e-6).alias("optimal"))


def _optimality_sql(source: str, where: str) -> str:
    return "\nUNION ALL\n".join(f"""
SELECT p.series_id, f.fold, '{t}' AS target, count(*) AS n_train, count(*) AS n_rows, avg(ln(greatest(p.{t}, 1))) AS intercept, true AS optimal
FROM {source} p JOIN folds f ON p.date <= f.train_end WHERE {where.format(t=t)} GROUP BY p.series_id, f.fold""" for t in TARGETS)


@register("panel_ridge_optimality", rounding={"intercept": 6}, extra_ctes=[SPARSE_CTE, FOLDS_CTE], sql=_optimality_sql("panel_and_total", "p.{t} > 0"))
def q_optimality(spark, sf):
    return _optimality(spark, sf, "drop")


@register("panel_ridge_all_days_optimality", rounding={"intercept": 6}, extra_ctes=[qc.SPINE_CTE, SPARSE_CTE, DENSE_PANEL_CTE, FOLDS_CTE],
          sql=_optimality_sql("dense_panel", "true"))
def q_optimality_keep(spark, sf):
    """The fit on all days came from sparse rows and the calendar; the check reads the dense frame."""
    return _optimality(spark, sf, "keep")


@register("panel_ridge_backtest")
def q_panel_backtest(spark, sf):
    """Walk-forward ridge of every series: predictions of each fold's validation days (tests hold the coefficients against
    numpy's solve)."""
    known = calendar(spark, sf, ahead=1)
    _, last = span(spark, sf)
    spans = {f: (a, min(b, last)) for f, _, a, b in bt.FOLDS if a <= last}
    p = pr.predict(panel_fits(spark, sf), known, KEYS, spans)
    return p.groupBy(*KEYS, "fold", "date").pivot("target", TARGETS).agg(F.first("pred")).withColumnsRenamed({t: f"pred_{t}" for t in TARGETS})


@register("ridge_forecast")
def q_ridge(spark, sf):
    """The company total's ridge over the horizon, out of the same moments (``panel_ridge_optimality`` proves its fit in SQL:
    series TOTAL, fold ALL)."""
    known = calendar(spark, sf, ahead=qb.HORIZON_DAYS)
    last = dt.date.fromisoformat(span(spark, sf)[1])
    ahead = (str(last + dt.timedelta(1)), str(last + dt.timedelta(qb.HORIZON_DAYS)))
    p = pr.predict(panel_fits(spark, sf).filter("series_id = 'TOTAL'"), known, KEYS, {"ALL": ahead})
    return p.groupBy("date").pivot("target", TARGETS).agg(F.first("pred")).withColumnsRenamed({t: f"ridge_{t}" for t in TARGETS})


# ------------------------------------------------------------ sparse days

RUNS_SQL = """
SELECT series_id, min(date) AS start, CAST(count(*) AS INTEGER) AS n_days, is_gap, sum(revenue) AS revenue, sum(cogs) AS cogs
FROM (SELECT d.*, p.date IS NULL AS is_gap,
             sum(CASE WHEN p.date IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY d.series_id ORDER BY d.date) AS seen
      FROM dense_panel d LEFT JOIN panel_and_total p ON p.series_id = d.series_id AND p.date = d.date) x
GROUP BY series_id, is_gap, seen"""
DENSE_CTES = [qc.SPINE_CTE, SPARSE_CTE, DENSE_PANEL_CTE]


def runs(spark, sf):
    return sd.day_runs(sparse_panel(spark, sf), KEYS, "date", TARGETS)


@register("sparse_day_runs", rounding={"revenue": 2, "cogs": 2}, extra_ctes=DENSE_CTES, sql=RUNS_SQL)
def q_runs(spark, sf):
    """Days with orders and the gaps between them as runs."""
    return runs(spark, sf)


@register("sparse_feature_sums", rounding={"sum_all": 5, "sum_zero": 5}, extra_ctes=qc.FEATURE_CTES + FEATURES_LONG + [SPARSE_CTE, DENSE_PANEL_CTE], sql=f"""
SELECT series_id, feature, count(*) AS n_days, count(*) FILTER (WHERE is_zero) AS n_zero_days, sum(v) AS sum_all, coalesce(sum(v) FILTER (WHERE is_zero), 0) AS sum_zero
FROM (SELECT d.series_id, p.date IS NULL AS is_zero, unnest({_FEATURES}) AS feature, unnest(t.x) AS v
      FROM dense_panel d JOIN tfa t ON t.date = d.date LEFT JOIN panel_and_total p ON p.series_id = d.series_id AND p.date = d.date) e
GROUP BY series_id, feature""")
def q_feature_sums(spark, sf):
    """Feature sums of the dense panel from the calendar's prefix sums at the ends of the runs."""
    prefix = sd.prefix_sums(sd.span_features(cm.sales_daily(spark, sf), "date", co.feature_matrix), NAMES)
    return sd.feature_sums(runs(spark, sf), prefix, KEYS, NAMES)


@register("panel_annual_totals", rounding={"revenue": 2, "cogs": 2}, extra_ctes=DENSE_CTES, sql="""
SELECT series_id, CAST(year(date) AS INTEGER) AS year, sum(revenue) AS revenue, sum(cogs) AS cogs, count(*) AS n_days
FROM dense_panel GROUP BY series_id, year(date)""")
def q_panel_annual(spark, sf):
    """Annual totals with the dense frame's day counts: a gap adds its share of days to each year that it touches."""
    years = runs(spark, sf).withColumn("year", F.explode(F.sequence(F.year("start"), F.year(F.date_add("start", F.col("n_days") - 1)))))
    first = F.greatest("start", F.make_date("year", F.lit(1), F.lit(1)))
    last = F.least(F.date_add("start", F.col("n_days") - 1), F.make_date("year", F.lit(12), F.lit(31)))
    return years.groupBy(*KEYS, "year").agg(*[F.sum(v).alias(v) for v in TARGETS], F.sum(F.datediff(last, first) + 1).alias("n_days"))


# ------------------------------------------------------------ permutation importance

SEEDS = ("own", "dealt")
FIT_FOLD = "A"


def dealt_rows(spark, sf):
    """Selling days of every series up to the fold's end, each with another row's date."""
    end = dict(FOLDS)[FIT_FOLD]
    rows = sparse_panel(spark, sf).filter((F.col("revenue") > 0) & (F.col("date") <= F.lit(end).cast("date"))).select("series_id", "date", "revenue")
    return pm.deal(rows, ["series_id", "date"], ["date"], SEEDS)


def feature_arrays(spark, sf, date_col, out):
    lo, hi = co.date_bounds(cm.sales_daily(spark, sf), "date")
    f = co.feature_matrix(co.date_spine(spark, lo, hi))
    return f.select(F.col("date").alias(date_col), F.array(*[F.col(c).cast("double") for c in NAMES]).alias(out))


def panel_importance(spark, sf):
    def build():
        rows = dealt_rows(spark, sf).join(F.broadcast(feature_arrays(spark, sf, "date", "x")), "date")
        rows = rows.join(F.broadcast(feature_arrays(spark, sf, "dealt_date", "x_dealt")), "dealt_date")
        fits = panel_fits(spark, sf).filter(f"target = 'revenue' AND fold = '{FIT_FOLD}'").drop("n")
        j = rows.join(fits, KEYS)
        j = j.withColumns({"ly": F.log("revenue"), "p": pr.score(F.col("x"), F.col("mu"), F.col("sigma"), F.col("coef"), F.col("intercept"))})
        return pm.linear_importance(j, NAMES, "ly", "p", "x", "x_dealt", "sigma", "coef")
    return cm.materialized(spark, sf, "panel_importance", build)


DEAL_CTES = CTES + [("own", f"SELECT series_id, date FROM panel_and_total WHERE revenue > 0 AND date <= DATE '{dict(FOLDS)[FIT_FOLD]}'")]


@register("panel_permutation_importance")
def q_panel_importance(spark, sf):
    """What the panel's ridge loses (mean absolute error of ln revenue) when a feature is dealt out over all rows."""
    return panel_importance(spark, sf)


RANKED_CTE = ("r", f"""
    SELECT series_id, date, row_number() OVER (ORDER BY md5('{SEEDS[0]}|' || series_id || '|' || CAST(date AS VARCHAR)), series_id, date) AS a,
           row_number() OVER (ORDER BY md5('{SEEDS[1]}|' || series_id || '|' || CAST(date AS VARCHAR)), series_id, date) AS b FROM own""")


@register("permutation_deal", rounding={"sum_own": 4, "sum_dealt": 4, "sum_product": 3}, extra_ctes=[*DEAL_CTES, RANKED_CTE], sql=f"""
SELECT feature, count(*) AS n, sum(v) AS sum_own, sum(w) AS sum_dealt, sum(v * w) AS sum_product
FROM (SELECT unnest({_FEATURES}) AS feature, unnest(x.x) AS v, unnest(y.x) AS w
      FROM r JOIN r s ON s.b = r.a JOIN tfa x ON x.date = r.date JOIN tfa y ON y.date = s.date) e GROUP BY feature""")
def q_deal(spark, sf):
    """The deal itself: each feature's sums with its own and its dealt values, and of their products."""
    rows = dealt_rows(spark, sf).join(F.broadcast(feature_arrays(spark, sf, "date", "x")), "date")
    rows = rows.join(F.broadcast(feature_arrays(spark, sf, "dealt_date", "y")), "dealt_date")
    each = rows.select(F.posexplode(F.arrays_zip("x", "y")).alias("i", "v")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("v.x").alias("sum_own"), F.sum("v.y").alias("sum_dealt"), F.sum(F.col("v.x") * F.col("v.y")).alias("sum_product"))
    return each.select(F.array(*[F.lit(c) for c in NAMES])[F.col("i")].alias("feature"), "n", "sum_own", "sum_dealt", "sum_product")


@register("permutation_constant_features", extra_ctes=DEAL_CTES, sql=f"""
SELECT feature, count(*) AS n, 0.0::DOUBLE AS delta_mae
FROM (SELECT unnest({_FEATURES}) AS feature, unnest(x) AS v FROM tfa JOIN own USING (date)) e GROUP BY feature HAVING min(v) = max(v)""")
def q_constant(spark, sf):
    """Features that have one value over all rows lose exactly nothing; any other with exactly 0 would show here too."""
    return panel_importance(spark, sf).filter("delta_mae = 0").select("feature", "n", "delta_mae")


# ------------------------------------------------------------ intervals

INCIDENT_SECONDS = 400_000   # of an error's value: incidents last from minutes to years
FOLLOW_SECONDS = 60          # of a signup's value: up to some hours


@register("interval_counts", extra_ctes=[], sql=f"""
WITH w AS (SELECT event_id, date_trunc('second', ts) AS start, date_trunc('second', ts) + to_seconds(CAST(floor(value * {INCIDENT_SECONDS}) AS BIGINT)) AS stop
           FROM events WHERE event_type = 'error')
SELECT w.event_id, w.start, w.stop, count(p.ts) AS n_points
FROM w LEFT JOIN (SELECT ts FROM events WHERE event_type = 'purchase') p ON date_trunc('second', p.ts) BETWEEN w.start AND w.stop GROUP BY w.event_id, w.start, w.stop""")
def q_interval_counts(spark, sf):
    """Purchases during each incident (an error and as long after it as its value says, up to years), to the second."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    start = F.date_trunc("second", "ts")
    length = F.floor(F.col("value") * INCIDENT_SECONDS)
    w = e.filter("event_type = 'error'").select("event_id", start.alias("start"), F.timestamp_seconds(F.unix_seconds(start.cast("timestamp")) + length).cast(e.schema["ts"].dataType).alias("stop"))
    return iv.count_in_windows(e.filter("event_type = 'purchase'").select("ts"), w, "ts", "start", "stop")


@register("join_interval_seconds", sql=f"""
WITH w AS (SELECT user_id, ts AS signed_up, value FROM events WHERE event_type = 'signup')
SELECT w.user_id, w.signed_up, p.event_id AS click_id
FROM w JOIN (SELECT event_id, ts FROM events WHERE event_type = 'click') p
  ON date_trunc('second', p.ts) BETWEEN date_trunc('second', w.signed_up) AND date_trunc('second', w.signed_up) + to_seconds(CAST(floor(w.value * {FOLLOW_SECONDS}) AS BIGINT))""")
def q_interval_seconds(spark, sf):
    """Clicks in the time after each signup that its value grants."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    w = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("signed_up"), F.timestamp_seconds(
        F.unix_seconds(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * FOLLOW_SECONDS)).alias("until"))
    p = e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "ts")
    return iv.interval_join(p, w, "ts", "signed_up", "until").select("user_id", "signed_up", "click_id")


# ------------------------------------------------------------ windows over cut groups

DAY_MICROS = 86_400_000_000


@register("lag_diff_micros", sql="""
SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_micros FROM events""")
def q_lag_micros(spark, sf):
    """Time since the same user's last event: the axis is unbounded, so a user's events are cut by day, and a day gets the
    last event before it."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("at", F.struct("us", "event_id"))
    out = cw.previous(e, ["user_id"], "at", F.col("us"), ["us"], DAY_MICROS)
    return out.select("event_id", "user_id", (F.col("us") - F.col("_prev_us")).alias("gap_micros"))


@register("panel_day_change", rounding={"revenue": 2, "change": 9}, extra_ctes=[SPARSE_CTE], sql="""
SELECT series_id, date, revenue, revenue / nullif(lag(revenue) OVER (PARTITION BY series_id ORDER BY date), 0) - 1 AS change FROM panel_and_total""")
def q_day_change(spark, sf):
    """Change of each series' revenue since its last selling day."""
    out = cw.previous(sparse_panel(spark, sf), KEYS, "date", F.unix_date("date"), ["revenue"], dg.BLOCK_DAYS)
    return out.select("series_id", "date", "revenue", (F.try_divide("revenue", "_prev_revenue") - 1).alias("change"))


@register("panel_rolling_30d", rounding={"rolling_mean": 6}, extra_ctes=[SPARSE_CTE], sql="""
SELECT series_id, date, avg(revenue) OVER (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS rolling_mean
FROM panel_and_total""")
def q_panel_rolling(spark, sf):
    """Mean revenue of each series' selling days in the last 30 days."""
    out = cw.range_frame(sparse_panel(spark, sf), KEYS, F.unix_date("date"), 29, {"rolling_mean": F.avg("revenue")}, dg.BLOCK_DAYS)
    return out.select("series_id", "date", "rolling_mean")


# ------------------------------------------------------------ exact selection

LEVELS = [0.0, 0.1, 0.5, 0.9, 1.0]


@register("panel_quantiles", rounding={"revenue": 4}, extra_ctes=[SPARSE_CTE], sql="\nUNION ALL\n".join(
    f"SELECT series_id, {q}::DOUBLE AS q, quantile_cont(revenue, {q}) AS revenue, count(*) AS n FROM panel_and_total GROUP BY series_id" for q in LEVELS))
def q_panel_quantiles(spark, sf):
    """Exact quantiles of each series' daily revenue by counted bins."""
    return sl.exact_quantiles(sparse_panel(spark, sf), KEYS, "revenue", LEVELS, "revenue")


@register("line_quantiles", rounding={"quantity": 4}, sql="\nUNION ALL\n".join(
    f"SELECT l_returnflag, {q}::DOUBLE AS q, quantile_cont(CAST(l_quantity AS DOUBLE), {q}) AS quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag" for q in LEVELS))
def q_line_quantiles(spark, sf):
    """Exact quantiles over all lines, three groups of many equal values."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_quantity")
    return sl.exact_quantiles(li, ["l_returnflag"], "l_quantity", LEVELS, "quantity")
