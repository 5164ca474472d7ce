"""Calendar features as pure column expressions of one date column.

Nothing here joins or shuffles: every feature is a projection, so a feature
matrix is one whole-stage-codegen span over the date dimension.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------- fixed values
# Lunar New Year (Tet) dates, 2013-2024; dates outside +-45 days of one -> 999.
LUNAR_NEW_YEAR = [
    "2013-02-10", "2014-01-31", "2015-02-19", "2016-02-08", "2017-01-28", "2018-02-16",
    "2019-02-05", "2020-01-25", "2021-02-12", "2022-02-01", "2023-01-22", "2024-02-10",
]
LNY_WINDOW_DAYS = 45
LNY_NONE = 999

# Recurring campaigns: (name, start month, start day, duration days, discount %, odd years only)
CAMPAIGNS = [
    ("spring_sale", 3, 18, 30, 12, False),
    ("mid_year", 6, 23, 29, 18, False),
    ("fall_launch", 8, 30, 32, 10, False),
    ("year_end", 11, 18, 45, 20, False),
    ("urban_blowout", 7, 30, 33, None, True),
    ("rural_special", 1, 30, 30, 15, True),
]

# Fixed-date holidays and shopping days: (month, day, name)
FIXED_HOLIDAYS = [
    (1, 1, "new_year"),
    (3, 8, "womens_day"),
    (4, 30, "reunification"),
    (5, 1, "labor_day"),
    (9, 2, "national_day"),
    (10, 20, "vn_womens_day"),
    (11, 11, "dd_1111"),
    (12, 12, "dd_1212"),
    (12, 24, "christmas_eve"),
    (12, 25, "christmas"),
]

# Regime boundaries and the time anchor
REGIME_PRE_LAST_YEAR = 2018
REGIME_MID_YEAR = 2019
REGIME_POST_FIRST_YEAR = 2020
TIME_ANCHOR = "2020-01-01"
DAYS_PER_YEAR = 365.25
# --------------------------------------------------------------------------

TAU = 2 * math.pi


@dataclass(frozen=True)
class Campaign:
    name: str
    start_month: int
    start_day: int
    duration_days: int
    discount_pct: float | None
    odd_years_only: bool


def campaigns(rows=CAMPAIGNS) -> list[Campaign]:
    return [Campaign(*r) for r in rows]


def dow0(d: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(d)


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def calendar_cols(d: Column) -> list[Column]:
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        dow0(d).alias("dayofweek"),
        F.dayofyear(d).alias("dayofyear"),
        F.quarter(d).alias("quarter"),
        (dow0(d) >= 5).cast("int").alias("is_weekend"),
        F.pmod(F.year(d), F.lit(2)).alias("is_odd_year"),
        days_in_month(d).alias("dim"),
    ]


def regime_cols(d: Column) -> list[Column]:
    y = F.year(d)
    t_days = F.datediff(d, F.lit(TIME_ANCHOR).cast("date"))
    return [
        (y <= REGIME_PRE_LAST_YEAR).cast("int").alias("regime_pre2019"),
        (y == REGIME_MID_YEAR).cast("int").alias("regime_2019"),
        (y >= REGIME_POST_FIRST_YEAR).cast("int").alias("regime_post2019"),
        t_days.alias("t_days"),
        (t_days / F.lit(DAYS_PER_YEAR)).alias("t_years"),
    ]


def fourier_cols(d: Column) -> list[Column]:
    doy = F.dayofyear(d).cast("double")
    dow = dow0(d).cast("double")
    pos = (F.dayofmonth(d) - 1).cast("double")
    dim = days_in_month(d).cast("double")
    out = []
    for k in range(1, 6):
        arg = F.lit(TAU * k) * doy / F.lit(DAYS_PER_YEAR)
        out += [F.sin(arg).alias(f"sin_y{k}"), F.cos(arg).alias(f"cos_y{k}")]
    for k in range(1, 3):
        arg = F.lit(TAU * k) * dow / F.lit(7.0)
        out += [F.sin(arg).alias(f"sin_w{k}"), F.cos(arg).alias(f"cos_w{k}")]
    for k in range(1, 3):
        arg = F.lit(TAU * k) * pos / dim
        out += [F.sin(arg).alias(f"sin_m{k}"), F.cos(arg).alias(f"cos_m{k}")]
    return out


def month_edge_cols(d: Column) -> list[Column]:
    to_eom = days_in_month(d) - F.dayofmonth(d)
    from_som = F.dayofmonth(d) - 1
    out = [to_eom.alias("days_to_eom"), from_som.alias("days_from_som")]
    for k in (1, 2, 3):
        out += [(to_eom <= k - 1).cast("int").alias(f"is_last{k}"),
                (from_som <= k - 1).cast("int").alias(f"is_first{k}")]
    return out


def lny_diff(d: Column, dates=LUNAR_NEW_YEAR, window: int = LNY_WINDOW_DAYS) -> Column:
    """Signed days from the nearest Lunar New Year within +-window, else 999.

    Built as an expression over the (small, fixed) holiday list: the nearest
    candidate is the array minimum of (|diff|, diff) structs.
    """
    cands = F.array(*[F.struct(F.abs(F.datediff(d, F.lit(t).cast("date"))).alias("a"),
                               F.datediff(d, F.lit(t).cast("date")).alias("s")) for t in dates])
    near = F.array_min(F.filter(cands, lambda c: c["a"] <= window))
    return F.coalesce(near["s"], F.lit(LNY_NONE))


def lny_cols(d: Column, dates=LUNAR_NEW_YEAR) -> list[Column]:
    x = lny_diff(d, dates)
    return [
        x.alias("tet_days_diff"),
        (F.abs(x) <= 7).cast("int").alias("tet_in_7"),
        (F.abs(x) <= 14).cast("int").alias("tet_in_14"),
        ((x >= -7) & (x < 0)).cast("int").alias("tet_before_7"),
        ((x > 0) & (x <= 7)).cast("int").alias("tet_after_7"),
        (x == 0).cast("int").alias("tet_on"),
    ]


def fixed_holiday_cols(d: Column, holidays=FIXED_HOLIDAYS) -> list[Column]:
    return [((F.month(d) == m) & (F.dayofmonth(d) == day)).cast("int").alias(f"hol_{name}")
            for m, day, name in holidays]


def black_friday(d: Column) -> Column:
    """Last Friday of November (Friday = 4 with Monday = 0)."""
    nov30 = F.make_date(F.year(d), F.lit(11), F.lit(30))
    last_fri = F.date_sub(nov30, F.pmod(dow0(nov30) - 4, F.lit(7)))
    return (d == last_fri).cast("int").alias("hol_black_friday")


def holiday_cols(d: Column, holidays=FIXED_HOLIDAYS) -> list[Column]:
    return fixed_holiday_cols(d, holidays) + [black_friday(d)]


def _window_start(d: Column, c: Campaign, years_back: int) -> Column:
    y = F.year(d) - years_back
    start = F.make_date(y, F.lit(c.start_month), F.lit(c.start_day))
    if c.odd_years_only:
        start = F.when(F.pmod(y, F.lit(2)) == 1, start)
    return start


def promo_cols(d: Column, camps: list[Campaign] | None = None) -> list[Column]:
    """In-window flag, days since start, days until end, discount per campaign.

    A window starting in year y ends at most ``duration`` days later, so only
    windows starting this year or last year can contain ``d``; this year's
    wins if both do (the later window overwrites, as in the reference loop).
    Ends are inclusive.
    """
    out = []
    for c in camps or campaigns():
        cur, prev = _window_start(d, c, 0), _window_start(d, c, 1)
        in_cur = (d >= cur) & (d <= F.date_add(cur, c.duration_days))
        in_prev = (d >= prev) & (d <= F.date_add(prev, c.duration_days))
        start = F.when(in_cur, cur).when(in_prev, prev)
        inside = start.isNotNull()
        disc = float(c.discount_pct or 0)
        out += [
            inside.cast("int").alias(f"promo_{c.name}"),
            F.coalesce(F.datediff(d, start).cast("double"), F.lit(-1.0)).alias(f"promo_{c.name}_since"),
            F.coalesce(F.datediff(F.date_add(start, c.duration_days), d).cast("double"), F.lit(-1.0))
             .alias(f"promo_{c.name}_until"),
            F.when(inside, F.lit(disc)).otherwise(F.lit(0.0)).alias(f"promo_{c.name}_disc"),
        ]
    return out


FEATURE_GROUPS = {
    "calendar": calendar_cols,
    "regime": regime_cols,
    "fourier": fourier_cols,
    "month_edge": month_edge_cols,
    "lunar_new_year": lny_cols,
    "holidays": holiday_cols,
    "promo": promo_cols,
}


def feature_names(holidays=FIXED_HOLIDAYS, camps: list[Campaign] | None = None) -> list[str]:
    """The feature names, in matrix order (81 with the fixed tables)."""
    names = ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "is_weekend",
             "is_odd_year", "dim", "regime_pre2019", "regime_2019", "regime_post2019",
             "t_days", "t_years"]
    for tag, ks in (("y", range(1, 6)), ("w", range(1, 3)), ("m", range(1, 3))):
        for k in ks:
            names += [f"sin_{tag}{k}", f"cos_{tag}{k}"]
    names += ["days_to_eom", "days_from_som"]
    for k in (1, 2, 3):
        names += [f"is_last{k}", f"is_first{k}"]
    names += ["tet_days_diff", "tet_in_7", "tet_in_14", "tet_before_7", "tet_after_7", "tet_on"]
    names += [f"hol_{n}" for _, _, n in holidays] + ["hol_black_friday"]
    for c in camps or campaigns():
        names += [f"promo_{c.name}", f"promo_{c.name}_since", f"promo_{c.name}_until",
                  f"promo_{c.name}_disc"]
    return names
