"""Exact order statistics without a sort, for groups of any size.

Groups are counted first.  One of at most ``BUFFER`` values is read in one aggregate, whose buffer is bounded by that
count.  A larger group's wanted ranks start with the range of all its values.  Each pass counts the values of that range in
``BINS`` equal bins (with the least and greatest value in each), takes the bin that holds the rank and
goes on with the values found in it, until they are all the same.  A value that half of the rows share needs no special
care: its rows are counted in the tasks that read them.  The least and greatest value of a range never
share a bin, so every pass gets nearer: to 1/1024 or less, and as every second pass bins logarithms, ranges over all
magnitudes close in a few passes too.

Scale: what is shuffled are bins, at most ``BINS`` for each rank and task (2**18 in all where ranges are few), never rows.
The ranges (one for each group and rank) are broadcast where they are counted to be ``SMALL`` or fewer; more are a table joined
by group.

Cases: null and NaN values are left out; a group without values has no row; quantiles are interpolated as numpy and SQL's
``quantile_cont`` do; null keys are a group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.operators.relational import materialize

BINS = 1024
BUFFER = 100_000           # values of a group that one task may hold
SMALL = 4_096              # ranges that the driver keeps and sends to the tasks; more are a table joined by group


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], out: str = "quantile", buffer: int = BUFFER) -> DataFrame:
    """(keys, q, out, n): the exact ``qs`` of each group, interpolated between the two nearest values.  Groups of at most
    ``buffer`` values are read in one aggregate, larger ones are narrowed by counting."""
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ks = [f"_k{i}" for i in range(len(keys))]
    sizes = rows.groupBy(*ks).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n > 0")
    large = sizes.filter(F.col("_n") > buffer)
    if large.isEmpty():
        got = _buffered(rows, ks, qs)
    else:
        # groups and values alone, written once: every pass reads them
        rows = materialize(rows)
        large = materialize(large)
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in ks] or F.lit(True)
        small = rows.join(large.select(*ks), same(rows, large), "left_anti") if ks else rows.filter("false")
        got = _counted(rows, large, ks, qs).unionByName(_buffered(small, ks, qs))
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_q").alias("q"), F.col("_got").alias(out), F.col("_n").alias("n"))


def _buffered(rows: DataFrame, ks: list[str], qs: list[float]) -> DataFrame:
    levels = F.array(*[F.lit(float(q)) for q in qs])
    got = rows.groupBy(*ks).agg(F.percentile("_v", levels).alias("_p"), F.count("*").alias("_n")).filter("_n > 0")
    return got.select(*ks, F.inline(F.arrays_zip(levels.alias("_q"), F.col("_p").alias("_got"))), "_n").select(*ks, "_q", "_got", "_n")


def _counted(rows: DataFrame, sizes: DataFrame, ks: list[str], qs: list[float]) -> DataFrame:
    # the two ranks (from zero) around each quantile
    at = (F.col("_n") - 1) * F.col("_q")
    want = sizes.withColumn("_q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    want = want.withColumns({"_a": F.floor(at).cast("long"), "_b": F.ceil(at).cast("long"), "_frac": at - F.floor(at)})
    # the ranges to narrow: one for each group and distinct rank
    state = want.select(*ks, F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_rank"), "_lo", "_hi").distinct()
    state = state.select("*", F.col("_rank").alias("_left"))
    few = state.limit(SMALL + 1).collect()
    found = _few(rows, few, state.schema, ks) if len(few) <= SMALL else _many(rows, state, ks)
    for rank, got in (("_a", "_va"), ("_b", "_vb")):
        v = found.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("_rank").alias("_r"), F.col("_lo").alias(got))
        cond = F.col(rank) == F.col("_r")
        for k in ks:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_"))
        want = want.join(v, cond).drop("_r", *[f"{k}_" for k in ks])
    return want.select(*ks, "_q", (F.col("_va") + (F.col("_vb") - F.col("_va")) * F.col("_frac")).alias("_got"), "_n")


def _few(rows: DataFrame, state: list, schema, ks: list[str]) -> DataFrame:
    """All ranges narrowed to one value each; their number is bounded, so the driver holds them.  With few ranges the bins
    are finer."""
    spark, done, log = rows.sparkSession, [], False
    while state:
        done += [r for r in state if r._lo == r._hi]
        state = [r for r in state if r._lo < r._hi]
        if state:
            bins = max(BINS, (1 << 18) // len(state))
            state = _narrowed(rows, F.broadcast(spark.createDataFrame(state, schema)), ks, bins, log).collect()
            log = not log
    return spark.createDataFrame(done, schema)


def _many(rows: DataFrame, state: DataFrame, ks: list[str]) -> DataFrame:
    """The same with a written table of ranges."""
    state, done, log = materialize(state), None, False
    while True:
        found = state.filter("_lo = _hi")
        done = found if done is None else done.unionByName(found)
        state = state.filter("_lo < _hi")
        if state.isEmpty():
            return done
        state = materialize(_narrowed(rows, state, ks, BINS, log))
        log = not log


def _scaled(v, log: bool):
    """Halves keep the width finite for ranges over all doubles; signed logarithms order them too."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100)) if log else v / 2


def _narrowed(rows: DataFrame, state: DataFrame, ks: list[str], bins: int, log: bool = False) -> DataFrame:
    """One counting pass: each open range narrowed to the values of the bin that holds its rank."""
    side = state.select(*[F.col(k).alias(f"{k}_") for k in ks], "_rank", "_lo", "_hi", "_left")
    cond = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k in ks:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_"))
    j = rows.join(side, cond)
    v, lo, hi = (_scaled(F.col(c), log) for c in ("_v", "_lo", "_hi"))
    part = F.try_divide(v - lo, hi - lo)
    bin_ = F.when(F.col("_v") == F.col("_hi"), F.lit(bins - 1)).otherwise(F.least(F.coalesce(F.floor(part * bins), F.lit(0)), F.lit(bins - 2)).cast("int"))
    counts = j.groupBy(*ks, "_rank", "_left", bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy(*ks, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)      # at most ``bins`` rows
    counts = counts.withColumn("_upto", F.sum("_c").over(w))
    hit = counts.filter((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c")))
    return hit.select(*ks, "_rank", "_lo", "_hi", (F.col("_left") - (F.col("_upto") - F.col("_c"))).alias("_left"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str = "quantile", buffer: int = BUFFER) -> DataFrame:
    """(keys, out) for one quantile."""
    return exact_quantiles(df, keys, value, [q], out, buffer).select(*keys, out)
