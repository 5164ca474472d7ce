"""Interval joins as equi-joins, for any unit and any length, by dyadic pieces.

A window of n units is cut into at most 2 log2(n) aligned pieces, each a node (level, number) that covers 2**level units;
a point lies in one node of each level.  The pieces of a window don't overlap, so a point meets a window in one piece at
most, and the join on (level, node) gives every pair once.  Only levels that some window uses are probed (at most 63, read
from the windows).

``count_in_windows`` needs no pairs: points are counted by node before the join, so a node that many
points share is one row and the work grows with windows x log(length).

Cases: both ends of a window are in it; a window that ends before it starts, or with a null end, holds nothing; null points are in no
window; repeated points and windows pair as often as they occur; timestamps are taken to whole units (``unit``) on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"day": lambda c: F.unix_date(c.cast("date")).cast("long"), "second": lambda c: F.unix_seconds(c.cast("timestamp")),
         "microsecond": lambda c: F.unix_micros(c.cast("timestamp")), "number": lambda c: c.cast("long")}


def pieces(windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """``windows`` with one row for each dyadic piece (_level, _node) of the integers start..end."""
    w = windows.withColumns({"_a": start, "_e": end + 1}).filter("_a < _e")
    # at a level a piece can stand at the left end (an odd node) and at the right end (an even node)
    node = F.expr("""flatten(transform(sequence(0, cast(floor(log2(_e - _a)) as int)), l -> filter(array(
        named_struct('_level', l, '_node', -shiftright(-_a, l), 'use', pmod(-shiftright(-_a, l), 2) = 1 AND shiftleft(-shiftright(-_a, l) + 1, l) <= _e),
        named_struct('_level', l, '_node', shiftright(_e, l) - 1, 'use', pmod(shiftright(_e, l) - 1, 2) = 0 AND shiftleft(shiftright(_e, l) - 1, l) >= _a)),
        x -> x.use)))""")
    out = w.withColumn("_p", F.explode(node))
    return out.select(*windows.columns, "_p._level", "_p._node")


def _levels(cut: DataFrame) -> list:
    """Levels in use: at most 63 numbers."""
    return sorted(r[0] for r in cut.select("_level").distinct().collect())


def _probes(points: DataFrame, at: Column, levels: list) -> DataFrame:
    p = points.withColumns({"_v": at, "_level": F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))})
    return p.filter("_v IS NOT NULL").withColumn("_node", F.expr("shiftright(_v, _level)")).drop("_v")


def interval_join(points: DataFrame, windows: DataFrame, point_col: str, start_col: str, end_col: str, unit: str = "second") -> DataFrame:
    """All (point, window) pairs with the point in the window; columns of both."""
    of = UNITS[unit]
    cut = pieces(windows, of(F.col(start_col)), of(F.col(end_col)))
    return _probes(points, of(F.col(point_col)), _levels(cut)).join(cut, ["_level", "_node"]).drop("_level", "_node")


def count_in_windows(points: DataFrame, windows: DataFrame, point_col: str, start_col: str, end_col: str, unit: str = "second",
                     keys: list[str] | None = None, out: str = "n_points") -> DataFrame:
    """``windows`` with the number of points in each; ``keys`` (columns of both) must agree too."""
    of, keys = UNITS[unit], keys or []
    ided = windows.withColumn("_w", F.struct(*windows.columns))
    cut = pieces(ided, of(F.col(start_col)), of(F.col(end_col)))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    counts = _probes(points.select(*own, F.col(point_col).alias("_p")), of(F.col("_p")), _levels(cut))
    counts = counts.groupBy(*[f"_k{i}" for i in range(len(keys))], "_level", "_node").agg(F.count("*").alias("_n"))
    cond = [cut["_level"] == counts["_level"], cut["_node"] == counts["_node"], *[cut[k].eqNullSafe(counts[f"_k{i}"]) for i, k in enumerate(keys)]]
    # a repeated window's pieces add up over its copies, so the sum is shared among them
    hits = cut.join(counts, cond).groupBy("_w").agg(F.sum("_n").alias("_n"))
    copies = windows.groupBy(*windows.columns).agg(F.count("*").alias("_copies")).withColumn("_w", F.struct(*windows.columns))
    total = copies.join(hits, copies["_w"].eqNullSafe(hits["_w"]), "left").select(
        *windows.columns, F.explode(F.array_repeat(F.coalesce((F.col("_n") / F.col("_copies")).cast("long"), F.lit(0).cast("long")), F.col("_copies").cast("int"))).alias(out))
    return total
