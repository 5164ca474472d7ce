"""Daily series without their zero days.

A dense panel is series x days, nearly all of it zeros once series are many.  Here a series is
its days with rows and the gaps between them as runs (start, number of days), at most two rows for each
selling day.  What a model needs from the zero days are counts and sums of date features, and those are differences of
the calendar's prefix sums at the two ends of a run: one lookup for a gap of any length.

Scale: rows are summed by (series, day) before the window; a window holds the days of one series, at most a
calendar's worth.  The prefix table has one row per calendar day and is broadcast (``bounded_hi`` fails beyond that).

Cases: repeated (series, day) rows are summed; null values add nothing; a series outside the span keeps only the days inside;
days without a date are left out; null keys are a series; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.operators.calendar_ops import bounded_hi, date_bounds, date_spine


def _span(agg: DataFrame, date_col: str, lo, hi):
    found_lo, found_hi = date_bounds(agg, date_col)
    lo = found_lo if lo is None else F.lit(lo).cast("date") if isinstance(lo, str) else lo
    hi = found_hi if hi is None else F.lit(hi).cast("date") if isinstance(hi, str) else hi
    return lo, bounded_hi(lo, hi)


def day_runs(df: DataFrame, keys: list[str], date_col: str, values: list[str], lo=None, hi=None) -> DataFrame:
    """(keys, start, n_days, is_gap, *values) covering every day of the span for every series once: a day with rows is a run
    of one day with its sums, days without are one run for each gap, with values of zero."""
    agg = df.groupBy(*keys, F.col(date_col).cast("date").alias("_d")).agg(*[F.sum(v).alias(v) for v in values])
    agg = agg.filter(F.col("_d").isNotNull())
    lo, hi = _span(agg, "_d", lo, hi)
    agg = agg.withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_d").between(F.col("_lo"), F.col("_hi")))
    w = Window.partitionBy(*keys).orderBy("_d")
    agg = agg.withColumns({"_from": F.date_add(F.coalesce(F.lag("_d").over(w), F.date_sub("_lo", 1)), 1), "_last": F.lead("_d").over(w).isNull()})
    types = {v: agg.schema[v].dataType for v in values}
    zero = [F.lit(0).cast(types[v]).alias(v) for v in values]
    day = F.struct(F.col("_d").alias("start"), F.lit(1).alias("n_days"), F.lit(False).alias("is_gap"), *[F.coalesce(F.col(v), F.lit(0).cast(types[v])).alias(v) for v in values])

    def gap(start, n):
        return F.when(n > 0, F.struct(start.alias("start"), n.alias("n_days"), F.lit(True).alias("is_gap"), *zero))

    before = gap(F.col("_from"), F.datediff("_d", "_from"))
    after = F.when(F.col("_last"), gap(F.date_add("_d", 1), F.datediff("_hi", "_d")))
    runs = agg.select(*keys, F.explode(F.filter(F.array(before, day, after), lambda r: r.isNotNull())).alias("_r"))
    return runs.select(*keys, "_r.*")


def expand(runs: DataFrame, keys: list[str], values: list[str], date_col: str = "date") -> DataFrame:
    """The dense frame again: one row for each day of each run."""
    return runs.select(*keys, F.explode(F.sequence("start", F.date_add("start", F.col("n_days") - 1))).alias(date_col), *values)


def prefix_sums(features: DataFrame, names: list[str], date_col: str = "date") -> DataFrame:
    """(day, s): the sums of the features over all days before ``day``, as an array; the day after the last is there
    too.  One row per calendar day, so one window over them is bounded."""
    # each day's sums stand at the day after it; the first day has none before
    w = Window.orderBy(date_col)
    sums = F.array(*[F.sum(F.col(c).cast("double")).over(w) for c in names])
    rows = features.select(F.date_add(date_col, 1).alias("day"), sums.alias("s"))
    first = features.agg(F.min(date_col).alias("day")).filter("day IS NOT NULL").select("day", F.array(*[F.lit(0.0)] * len(names)).alias("s"))
    return rows.unionByName(first)


def feature_sums(runs: DataFrame, prefix: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, feature, n_days, n_zero_days, sum_all, sum_zero): sums of each date feature over all days of a series and over
    its zero days, as the dense frame would give them."""
    begin = prefix.select(F.col("day").alias("_b"), F.col("s").alias("_sb"))
    end = prefix.select(F.col("day").alias("_e"), F.col("s").alias("_se"))
    j = runs.withColumn("_stop", F.date_add("start", "n_days"))
    j = j.join(F.broadcast(begin), j["start"] == F.col("_b")).join(F.broadcast(end), F.col("_stop") == F.col("_e"))
    part = j.select(*keys, "n_days", "is_gap", F.zip_with("_se", "_sb", lambda a, b: a - b).alias("_x"))
    gaps = F.when(F.col("is_gap"), F.col("n_days")).otherwise(0)
    # sums of one column for each feature: the rows stay runs, and partial sums stay one row for each series
    out = part.groupBy(*keys).agg(
        F.sum("n_days").alias("n_days"), F.sum(gaps).alias("n_zero_days"),
        F.array(*[F.sum(F.col("_x")[i]) for i in range(len(names))]).alias("_all"),
        F.array(*[F.sum(F.when(F.col("is_gap"), F.col("_x")[i]).otherwise(0.0)) for i in range(len(names))]).alias("_zero"))
    each = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("_all").alias("sum_all"), F.col("_zero").alias("sum_zero"))
    return out.select(*keys, "n_days", "n_zero_days", F.inline(each))


def span_features(df: DataFrame, date_col: str, build) -> DataFrame:
    """``build`` (dates -> features) over all days from the first to the last of ``df``."""
    lo, hi = date_bounds(df, date_col)
    return build(date_spine(df.sparkSession, lo, hi))
