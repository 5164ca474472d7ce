"""Calendar keys.

Spark side: features are pure expressions (vendora.functions.calendar).
SQL side: the literal formulation - Lunar New Year by a range join with a
holiday table and arg-min, campaigns by expanding windows and joining - so
the oracle independently checks the expression form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.functions import calendar as cal
from vendora.operators import calendar_ops as co
from vendora.plans import common as cm
from vendora.plans.registry import register
from vendora.sources import bindings as b

# ------------------------------------------------------------------ SQL side

SPINE_CTE = ("spine", """
    SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY))
                AS DATE) AS date
    FROM (SELECT min(date) AS lo, max(date) AS hi FROM fx_sales) bnd""")


def _i(expr: str, name: str) -> str:
    return f"CAST({expr} AS INTEGER) AS {name}"


def sql_calendar(d="date") -> list[str]:
    return [
        _i(f"year({d})", "year"), _i(f"month({d})", "month"), _i(f"day({d})", "day"),
        _i(f"isodow({d}) - 1", "dayofweek"), _i(f"dayofyear({d})", "dayofyear"),
        _i(f"quarter({d})", "quarter"), _i(f"isodow({d}) - 1 >= 5", "is_weekend"),
        _i(f"year({d}) % 2", "is_odd_year"), _i(f"day(last_day({d}))", "dim"),
    ]


def sql_regime(d="date") -> list[str]:
    td = f"date_diff('day', DATE '{cal.TIME_ANCHOR}', {d})"
    return [
        _i(f"year({d}) <= {cal.REGIME_PRE_LAST_YEAR}", "regime_pre2019"),
        _i(f"year({d}) = {cal.REGIME_MID_YEAR}", "regime_2019"),
        _i(f"year({d}) >= {cal.REGIME_POST_FIRST_YEAR}", "regime_post2019"),
        _i(td, "t_days"),
        f"CAST({td} AS DOUBLE) / {cal.DAYS_PER_YEAR!r} AS t_years",
    ]


def sql_fourier(d="date") -> list[str]:
    out = []
    doy = f"CAST(dayofyear({d}) AS DOUBLE)"
    dow = f"CAST(isodow({d}) - 1 AS DOUBLE)"
    pos = f"CAST(day({d}) - 1 AS DOUBLE)"
    dim = f"CAST(day(last_day({d})) AS DOUBLE)"
    for k in range(1, 6):
        a = f"({cal.TAU * k!r} * {doy}) / {cal.DAYS_PER_YEAR!r}"
        out += [f"sin({a}) AS sin_y{k}", f"cos({a}) AS cos_y{k}"]
    for k in range(1, 3):
        a = f"({cal.TAU * k!r} * {dow}) / 7.0"
        out += [f"sin({a}) AS sin_w{k}", f"cos({a}) AS cos_w{k}"]
    for k in range(1, 3):
        a = f"({cal.TAU * k!r} * {pos}) / {dim}"
        out += [f"sin({a}) AS sin_m{k}", f"cos({a}) AS cos_m{k}"]
    return out


def sql_month_edge(d="date") -> list[str]:
    te = f"(day(last_day({d})) - day({d}))"
    fs = f"(day({d}) - 1)"
    out = [_i(te, "days_to_eom"), _i(fs, "days_from_som")]
    for k in (1, 2, 3):
        out += [_i(f"{te} <= {k - 1}", f"is_last{k}"), _i(f"{fs} <= {k - 1}", f"is_first{k}")]
    return out


def sql_holidays(d="date", black_friday=True, fixed=True) -> list[str]:
    out = []
    if fixed:
        out += [_i(f"month({d}) = {m} AND day({d}) = {dd}", f"hol_{n}") for m, dd, n in cal.FIXED_HOLIDAYS]
    if black_friday:
        nov30 = f"make_date(year({d}), 11, 30)"
        out.append(_i(f"{d} = {nov30} - CAST((((isodow({nov30}) - 1) - 4) % 7 + 7) % 7 AS INTEGER)",
                      "hol_black_friday"))
    return out


LNY_VALUES = ", ".join(f"(DATE '{t}')" for t in cal.LUNAR_NEW_YEAR)
TET_CTE = ("tet_feat", f"""
    SELECT date, tdd AS tet_days_diff,
           CAST(abs(tdd) <= 7 AS INTEGER) AS tet_in_7, CAST(abs(tdd) <= 14 AS INTEGER) AS tet_in_14,
           CAST(tdd >= -7 AND tdd < 0 AS INTEGER) AS tet_before_7,
           CAST(tdd > 0 AND tdd <= 7 AS INTEGER) AS tet_after_7, CAST(tdd = 0 AS INTEGER) AS tet_on
    FROM (SELECT s.date,
                 CAST(coalesce(arg_min(date_diff('day', t.tet, s.date), abs(date_diff('day', t.tet, s.date))),
                               {cal.LNY_NONE}) AS INTEGER) AS tdd
          FROM spine s LEFT JOIN (SELECT * FROM (VALUES {LNY_VALUES}) v(tet)) t
            ON abs(date_diff('day', t.tet, s.date)) <= {cal.LNY_WINDOW_DAYS}
          GROUP BY s.date) x""")


def _camp_values() -> str:
    rows = []
    for n, m, d, dur, disc, odd in cal.CAMPAIGNS:
        rows.append(f"('{n}', {m}, {d}, {dur}, {'NULL' if disc is None else float(disc)}, {str(odd).lower()})")
    return ", ".join(rows)


WINDOWS_CTE = ("promo_windows", f"""
    SELECT name, y AS year, make_date(y, m, dd) AS start_date,
           CAST(make_date(y, m, dd) + dur AS DATE) AS end_date,
           CAST(coalesce(disc, 0) AS DOUBLE) AS discount_pct
    FROM (SELECT * FROM (VALUES {_camp_values()}) v(name, m, dd, dur, disc, odd)) c,
         (SELECT unnest(range(lo - 1, hi + 2)) AS y
          FROM (SELECT min(year(date)) AS lo, max(year(date)) AS hi FROM spine) s) yrs
    WHERE NOT c.odd OR y % 2 = 1""")


def _promo_select() -> str:
    parts = []
    for c in cal.campaigns():
        n = c.name
        hit = f"w.name = '{n}'"
        parts += [
            f"CAST(max(CASE WHEN {hit} THEN 1 ELSE 0 END) AS INTEGER) AS promo_{n}",
            f"coalesce(max(CASE WHEN {hit} THEN CAST(date_diff('day', w.start_date, s.date) AS DOUBLE) END), -1.0)"
            f" AS promo_{n}_since",
            f"coalesce(max(CASE WHEN {hit} THEN CAST(date_diff('day', s.date, w.end_date) AS DOUBLE) END), -1.0)"
            f" AS promo_{n}_until",
            f"coalesce(max(CASE WHEN {hit} THEN w.discount_pct END), 0.0) AS promo_{n}_disc",
        ]
    return ",\n           ".join(parts)


PROMO_CTE = ("promo_feat", f"""
    SELECT s.date,
           {_promo_select()}
    FROM spine s LEFT JOIN promo_windows w ON s.date BETWEEN w.start_date AND w.end_date
    GROUP BY s.date""")

FOURIER_ROUND = {f"{t}_{tag}{k}": 9 for tag, ks in (("y", range(1, 6)), ("w", range(1, 3)), ("m", range(1, 3)))
                 for k in ks for t in ("sin", "cos")}
ALL_FEATURE_ROUND = {**FOURIER_ROUND, "t_years": 9}


def feature_matrix_sql(extra_select: str = "", extra_join: str = "") -> str:
    base = ",\n       ".join(sql_calendar("s.date") + sql_regime("s.date") + sql_fourier("s.date")
                             + sql_month_edge("s.date"))
    tet = "t.tet_days_diff, t.tet_in_7, t.tet_in_14, t.tet_before_7, t.tet_after_7, t.tet_on"
    hol = ",\n       ".join(sql_holidays("s.date"))
    promo = ", ".join(f"p.{n}" for n in cal.feature_names() if n.startswith("promo_"))
    return f"""
SELECT s.date,
       {base},
       {tet},
       {hol},
       {promo}{extra_select}
FROM spine s JOIN tet_feat t USING (date) JOIN promo_feat p USING (date) {extra_join}"""


FEATURE_CTES = [SPINE_CTE, TET_CTE, WINDOWS_CTE, PROMO_CTE]

# ---------------------------------------------------------------- Spark side


def S(spark, sf):
    return b.Sources(spark, sf)


def sales_spine(spark, sf):
    lo, hi = co.date_bounds(cm.sales_daily(spark, sf), "date")
    return co.date_spine(spark, lo, hi)


@register("date_spine", sql="""
SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
         AS date
FROM (SELECT min(order_date) AS lo, max(order_date) AS hi FROM fx_orders) b""")
def q_date_spine(spark, sf):
    lo, hi = co.date_bounds(b.orders(S(spark, sf)), "order_date")
    return co.date_spine(spark, lo, hi)


@register("densify_daily", rounding={"revenue": 2, "cogs": 2}, sql="""
SELECT s.series_id, d.date, coalesce(p.revenue, 0) AS revenue, coalesce(p.cogs, 0) AS cogs
FROM (SELECT DISTINCT series_id FROM fx_sales_panel) s
CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                               INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT min(date) AS lo, max(date) AS hi FROM fx_sales_panel) b) d
LEFT JOIN fx_sales_panel p ON p.series_id = s.series_id AND p.date = d.date""")
def q_densify(spark, sf):
    return cm.panel_dense(spark, sf)


def _feat_query(key, groups, sql_cols, rounding=None, extra_ctes=None, sql_body=None):
    body = sql_body or ("SELECT s.date,\n       " + ",\n       ".join(sql_cols) + "\nFROM spine s")

    @register(key, rounding=rounding, sql=body, extra_ctes=extra_ctes or [SPINE_CTE])
    def _q(spark, sf):
        return co.with_features(sales_spine(spark, sf), "date", groups)
    return _q


_feat_query("feat_calendar", ["calendar"], sql_calendar("s.date"))
_feat_query("feat_regime", ["regime"], sql_regime("s.date"), rounding={"t_years": 9})
_feat_query("feat_fourier", ["fourier"], sql_fourier("s.date"), rounding=FOURIER_ROUND)
_feat_query("feat_month_edge", ["month_edge"], sql_month_edge("s.date"))
_feat_query("feat_lunar_new_year", ["lunar_new_year"], None,
            extra_ctes=[SPINE_CTE, TET_CTE], sql_body="SELECT * FROM tet_feat")
_feat_query("feat_promo_windows", ["promo"], None,
            extra_ctes=[SPINE_CTE, WINDOWS_CTE, PROMO_CTE], sql_body="SELECT * FROM promo_feat")


@register("feat_fixed_holidays", sql="SELECT s.date,\n       " + ",\n       ".join(
    sql_holidays("s.date", black_friday=False)) + "\nFROM spine s", extra_ctes=[SPINE_CTE])
def q_fixed_holidays(spark, sf):
    return sales_spine(spark, sf).select("date", *cal.fixed_holiday_cols(F.col("date")))


@register("feat_black_friday", sql="SELECT s.date, " + sql_holidays("s.date", fixed=False)[0]
          + "\nFROM spine s", extra_ctes=[SPINE_CTE])
def q_black_friday(spark, sf):
    return sales_spine(spark, sf).select("date", cal.black_friday(F.col("date")))


@register("promo_calendar", sql="SELECT * FROM promo_windows", extra_ctes=[SPINE_CTE, WINDOWS_CTE])
def q_promo_calendar(spark, sf):
    spine = sales_spine(spark, sf)
    yrs = spine.agg(F.min(F.year("date")).alias("lo"), F.max(F.year("date")).alias("hi"))
    return co.promo_calendar(co.campaigns_df(spark), yrs.select("lo").scalar(), yrs.select("hi").scalar())


@register("join_interval", sql="""
SELECT s.date, w.name, w.start_date, w.end_date
FROM spine s JOIN promo_windows w ON s.date BETWEEN w.start_date AND w.end_date""",
          extra_ctes=[SPINE_CTE, WINDOWS_CTE])
def q_join_interval(spark, sf):
    spine = sales_spine(spark, sf)
    win = q_promo_calendar(spark, sf)
    return co.join_interval(spine, win, "date").select("date", "name", "start_date", "end_date")


@register("feature_matrix", rounding=ALL_FEATURE_ROUND, sql=feature_matrix_sql(), extra_ctes=FEATURE_CTES)
def q_feature_matrix(spark, sf):
    return co.feature_matrix(sales_spine(spark, sf))


@register("training_frame", rounding={**ALL_FEATURE_ROUND, "revenue": 2, "cogs": 2},
          sql=feature_matrix_sql(", coalesce(x.revenue, 0) AS revenue, coalesce(x.cogs, 0) AS cogs",
                                 "LEFT JOIN fx_sales x ON x.date = s.date"),
          extra_ctes=FEATURE_CTES)
def q_training_frame(spark, sf):
    return training_frame(spark, sf)


def training_frame(spark, sf, panel: bool = False):
    """Features + densified targets.  ``panel=True`` keys it by series_id."""
    dense = cm.panel_dense(spark, sf) if panel else cm.total_daily(spark, sf).drop("series_id")
    feats = co.feature_matrix(dense.select("date").distinct())
    return co.attach_features(dense, feats)
