"""Date spine, densification and the date-feature dimension.

Scale design
* The date dimension (one row per day in the span) is bounded by the span in
  days, not by the data: ten years are ~3,700 rows x 82 columns (~2.5 MB), so
  it is broadcast to the panel.  ``bounded_hi`` fails the job beyond that bound.
* Densification never forms a cross join: every series row explodes its own
  ``sequence(lo, hi)`` of days, where (lo, hi) are scalar subqueries over the
  data, and the data is then left-joined on (series, day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.functions import calendar as cal

# A date dimension larger than this many days is not a calendar any more.
MAX_SPAN_DAYS = 200_000


def date_bounds(df: DataFrame, date_col: str = "date"):
    """(min, max) of a date column as lazy scalar-subquery columns."""
    b = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    return b.select("lo").scalar(), b.select("hi").scalar()


def date_spine(spark: SparkSession, lo, hi, name: str = "date", max_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """Contiguous daily calendar between two dates (both ends in).

    ``lo``/``hi`` are date literals or scalar-subquery columns.  The span is a
    handful of thousand days, so exploding it in one task is cheap.
    """
    lo = F.lit(lo).cast("date") if isinstance(lo, str) else lo
    hi = F.lit(hi).cast("date") if isinstance(hi, str) else hi
    seq = F.sequence(lo, bounded_hi(lo, hi, max_days), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(seq).alias(name))


def bounded_hi(lo, hi, limit: int = MAX_SPAN_DAYS):
    """``hi``, or a job failure when the span is not a calendar (> limit days)."""
    return F.when(F.datediff(hi, lo) <= limit, hi).otherwise(
        F.raise_error(F.lit(f"date span exceeds {limit} days")).cast("date"))


def densify(df: DataFrame, keys: list[str], date_col: str, values: list[str],
            lo=None, hi=None, fill=0.0, max_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """One row per (series, day) on the span, missing days -> ``fill``.

    Duplicate (series, day) rows are summed first (the reference would fail).
    Span defaults to the data's global min..max; every series gets all days.
    """
    agg = df.groupBy(*keys, date_col).agg(*[F.sum(v).alias(v) for v in values])
    if lo is None or hi is None:
        # bounds from the aggregate, not the raw input: the scalar subquery then
        # shares the aggregate's exchange instead of rescanning the source
        blo, bhi = date_bounds(agg, date_col)
        lo = blo if lo is None else lo
        hi = bhi if hi is None else hi
    lo = F.lit(lo).cast("date") if isinstance(lo, str) else lo
    hi = F.lit(hi).cast("date") if isinstance(hi, str) else hi
    if keys:
        series = agg.select(*keys).distinct()
    else:
        series = df.sparkSession.range(1).select()
    seq = F.sequence(lo, bounded_hi(lo, hi, max_days), F.expr("INTERVAL 1 DAY"))
    grid = series.select(*keys, F.explode(seq).alias(date_col))
    out = grid.join(agg, keys + [date_col], "left")
    return out.select(*keys, date_col, *[F.coalesce(F.col(v), F.lit(fill)).alias(v) for v in values])


def with_features(dates: DataFrame, date_col: str = "date", groups: list[str] | None = None,
                  lunar_new_year=cal.LUNAR_NEW_YEAR, holidays=cal.FIXED_HOLIDAYS, campaigns=None) -> DataFrame:
    """Add calendar feature groups to a frame of dates (pure projection).  The tables of
    movable dates, fixed holidays and campaigns may be the caller's own."""
    d = F.col(date_col)
    own = {"lunar_new_year": {"dates": lunar_new_year}, "holidays": {"holidays": holidays}, "promo": {"camps": campaigns}}
    cols = []
    for g in groups or list(cal.FEATURE_GROUPS):
        cols += cal.FEATURE_GROUPS[g](d, **own.get(g, {}))
    return dates.select("*", *cols)


def feature_matrix(dates: DataFrame, date_col: str = "date", **tables) -> DataFrame:
    """All features (81 with the fixed tables); nulls -> 0 (there are none by construction)."""
    return with_features(dates.select(date_col).distinct(), date_col, **tables).na.fill(0)


def attach_features(panel: DataFrame, features: DataFrame, date_col: str = "date") -> DataFrame:
    """Broadcast the date dimension onto a panel (bounded by the day span)."""
    return panel.join(F.broadcast(features), date_col)


def campaigns_df(spark: SparkSession, rows=cal.CAMPAIGNS) -> DataFrame:
    return spark.createDataFrame(
        [(n, m, d, dur, None if disc is None else float(disc), odd) for n, m, d, dur, disc, odd in rows],
        "name string, start_month int, start_day int, duration_days int, discount_pct double, "
        "odd_years_only boolean")


def promo_calendar(campaigns: DataFrame, first_year, last_year) -> DataFrame:
    """Expand recurring campaigns to dated windows for years first-1 .. last+1.

    ``first_year``/``last_year`` are ints or scalar columns.  Output rows are
    campaigns x years (a few dozen): small enough to broadcast.
    """
    fy = F.lit(first_year) if isinstance(first_year, int) else first_year
    ly = F.lit(last_year) if isinstance(last_year, int) else last_year
    y = campaigns.select("*", F.explode(F.sequence(fy - 1, ly + 1)).alias("year"))
    y = y.filter(~F.col("odd_years_only") | (F.pmod(F.col("year"), F.lit(2)) == 1))
    start = F.make_date(F.col("year"), F.col("start_month"), F.col("start_day"))
    return y.select("name", "year", start.alias("start_date"),
                    F.date_add(start, F.col("duration_days")).alias("end_date"),
                    F.coalesce(F.col("discount_pct"), F.lit(0.0)).alias("discount_pct"))


def join_interval(points: DataFrame, windows: DataFrame, point_col: str,
                  start_col: str = "start_date", end_col: str = "end_date",
                  how: str = "inner") -> DataFrame:
    """Points inside [start, end] windows of days (both ends in).

    Each window gives one row per day it covers, so the join is an equi-join on the
    day, for any number of windows.
    """
    day = F.explode(F.sequence(F.col(start_col), F.col(end_col), F.expr("INTERVAL 1 DAY"))).alias("_day")
    days = windows.filter(F.col(start_col) <= F.col(end_col)).select("*", day)
    return points.join(days, points[point_col] == days["_day"], how).drop("_day")
