"""Generic relational building blocks used by the business questions.

All take DataFrames and column names, so they run on any table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filter_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def filter_in_set(df: DataFrame, col: str, values) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def filter_date_range(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Both ends inclusive; either may be None.  Pushed into the Parquet scan."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col(col) <= F.lit(end).cast("date"))
    return df.filter(cond)


def join_left_fill(left: DataFrame, right: DataFrame, on, fill: dict) -> DataFrame:
    """Left join, then missing right-side values replaced by the ``fill`` constants."""
    out = left.join(right, on, "left")
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def align_ratio(num: DataFrame, den: DataFrame, key: str, num_col: str, den_col: str,
                out_col: str = "ratio") -> DataFrame:
    """Divide two keyed series aligned on their key; an absent side gives null."""
    j = num.join(den, key, "full_outer")
    return j.withColumn(out_col, F.try_divide(F.col(num_col).cast("double"), F.col(den_col).cast("double")))


def rank_flag(df: DataFrame, key: str, value: str, ascending: bool = False,
              flag: str = "is_top") -> DataFrame:
    """Mark the arg-max (or arg-min) row of an aggregated table.

    Ties go to the first key in sort order, nulls never win (pandas ``idxmax``).
    The window has no partition, so it is only used on tables whose row count
    is bounded by a categorical key (segments, regions, sizes...).  For
    unbounded key sets use ``argmax_group``, which is a distributed top-1.
    """
    order_v = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    w = Window.orderBy(order_v, F.col(key).asc())
    return df.withColumn(flag, ((F.row_number().over(w) == 1) & F.col(value).isNotNull()).cast("int"))


def argmax_group(df: DataFrame, key: str, value: str, ascending: bool = False) -> DataFrame:
    """Key of the largest (smallest) value: a distributed top-1 (TakeOrdered)."""
    order_v = F.col(value).asc() if ascending else F.col(value).desc()
    return df.filter(F.col(value).isNotNull()).orderBy(order_v, F.col(key).asc()).limit(1)


def sort_top_k(df: DataFrame, value: str, k: int, key: str | None = None) -> DataFrame:
    keys = [F.col(value).desc()] + ([F.col(key).asc()] if key else [])
    return df.orderBy(*keys).limit(k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def lag_diff(df: DataFrame, partition: list[str], order: str, tie: str, out: str = "diff",
             days: bool = True) -> DataFrame:
    """``order - lag(order)`` within ``partition`` in (order, tie) order, for an
    ``order`` column of bounded domain per group (a date).

    Skew-safe form of the plain window: a group holding a third of all rows
    would put all of them in one window task.  Instead rows are reduced to
    (group, order value, first tie key); the window runs over those distinct
    values only (at most one row per calendar day per group), and the result
    is joined back on (group, order value), a join AQE can split when one
    (group, day) is hot.  Every row but the first of its (group, value) has
    the same order value as its predecessor, so its difference is zero.
    ``tie`` must be a non-null unique key (the primary key).  Rows with a null in
    ``partition`` belong to no group and get no difference.
    """
    known = F.lit(True)
    for p in partition:
        known = known & F.col(p).isNotNull()
    nobody = df.filter(~known)
    df = df.filter(known)
    keys = [*partition, order]
    first = df.groupBy(*keys).agg(F.min(tie).alias("_first"))
    w = Window.partitionBy(*partition).orderBy(order)
    first = first.withColumn("_prev", F.lag(order).over(w))
    cond = [df[k].eqNullSafe(first[k]) for k in keys]
    j = df.join(first, cond).select(df["*"], first["_first"], first["_prev"])
    o = F.col(order)
    diff = (lambda a, b: F.datediff(a, b)) if days else (lambda a, b: a - b)
    out_rows = j.select(*[F.col(c) for c in df.columns],
                        F.when(F.col(tie) == F.col("_first"), diff(o, F.col("_prev")))
                         .otherwise(diff(o, o)).alias(out))
    return out_rows.unionByName(nobody.withColumn(out, F.lit(None).cast(out_rows.schema[out].dataType)))


def exact_quantile_from_counts(hist: DataFrame, value: str, weight: str, q: float,
                               group: list[str] | None = None, out: str = "quantile",
                               n_out: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantile from a (value, count) histogram.

    Equal to numpy/pandas ``quantile(q)`` (linear) of the multiset the
    histogram describes.  Used where values are few and repeated (day gaps),
    so the whole table never has to sit in one task: only the distinct values
    of each group are ordered.
    """
    group = group or []
    w_tot = Window.partitionBy(*group) if group else Window.partitionBy()
    w_run = (Window.partitionBy(*group).orderBy(value) if group else Window.orderBy(value))
    h = (hist.withColumn("_n", F.sum(weight).over(w_tot))
             .withColumn("_hi", F.sum(weight).over(w_run.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_lo", F.col("_hi") - F.col(weight)))
    pos = (F.col("_n") - 1) * F.lit(q)
    h = h.withColumn("_pos", pos)
    # rank r (0-based) sits in the bucket with _lo <= r < _hi
    lo_r = F.floor(F.col("_pos"))
    hi_r = F.ceil(F.col("_pos"))
    agg = h.groupBy(*group).agg(
        F.min(F.when((F.col("_lo") <= lo_r) & (lo_r < F.col("_hi")), F.col(value))).alias("_vlo"),
        F.min(F.when((F.col("_lo") <= hi_r) & (hi_r < F.col("_hi")), F.col(value))).alias("_vhi"),
        F.first("_pos").alias("_pos"),
        F.first("_n").cast("long").alias("_n"),
    )
    frac = F.col("_pos") - F.floor(F.col("_pos"))
    extra = [F.col("_n").alias(n_out)] if n_out else []
    return agg.select(*group, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).cast("double").alias(out),
                      *extra)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared
    ``spark.checkpoint.dir`` (used before a table is referenced many times)."""
    from vendora.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def line_value(items: DataFrame) -> Column:
    """A line's value as exact money: ``extended_price`` where the table has it, else
    quantity x unit price, each as a decimal before they are multiplied."""
    if "extended_price" in items.columns:
        return F.col("extended_price").cast("decimal(18,2)")
    return F.col("quantity").cast("decimal(18,0)") * F.col("unit_price").cast("decimal(18,4)")


def money(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("double"), digits)


def global_prefix(df: DataFrame, order_cols: list[str], value: str | None = None, rank_out: str = "rank",
                  cum_out: str = "cum") -> DataFrame:
    """Global 1-based row number (and running sum of ``value``) in the order of
    ``order_cols`` (all ascending, nulls first), without a single-partition window.

    Rows are range-partitioned on all order columns, so a value that a third of the
    table shares is cut by the next column (any type), and the number of ranges is the
    session's number of shuffle partitions.  The ranges are written to the checkpoint
    folder, since both the sizes and the ranks must see the same ones; their counts and
    sums become offsets (one row per range, prefix-summed), and each range adds its own
    row numbers and running sums.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = materialize(df.repartitionByRange(n, *order_cols).withColumn("_b", F.spark_partition_id()))
    val = F.col(value) if value else F.lit(0)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.sum(val).alias("_s"))
    # one row per shuffle partition: an unpartitioned window is fine here
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
                        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off_s"))
    w = Window.partitionBy("_b").orderBy(*order_cols)
    r = b.join(F.broadcast(offs), "_b").withColumn(rank_out, F.col("_off_n") + F.row_number().over(w))
    if value:
        r = r.withColumn(cum_out, F.col("_off_s") + F.sum(val).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.drop("_b", "_off_n", "_off_s")


def ntile_from_rank(rank: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` of the row at 1-based ``rank`` among ``n`` rows (first
    buckets one larger when k does not divide n), as Spark/SQL define it."""
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return F.when(rank <= big, F.ceil(rank / (q + 1))).otherwise(rem + F.ceil((rank - big) / q)).cast("int")
