"""Windows over groups of any length: a group's axis is cut in blocks, and blocks are windows of their own.

A frame that looks back ``before`` units sees nothing older, so each block gets its neighbour's rows of that reach as a
halo, and results of the halo are dropped: one group spreads over as many tasks as it has blocks.  A window over
rows (``lag``) needs one row of the past, however far it is; the halo of a block is then the last row of the nearest
earlier block with rows, found from one row for each block.

Cases: rows with a null position get null results of range frames and come first in row frames, as in a plain window; null keys
are a group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, at: Column, block: int, before: int) -> DataFrame:
    """Rows with _at, _block and _own: each row in its own block, and again (not _own) in the later blocks whose
    rows look back on it."""
    df = df.withColumn("_at", at.cast("long"))
    home = F.floor(F.col("_at") / block)
    out = df.withColumn("_block", F.explode_outer(F.sequence(home, F.floor((F.col("_at") + before) / block))))
    return out.withColumn("_own", F.col("_block").eqNullSafe(home))


def range_frame(df: DataFrame, keys: list[str], at: Column, before: int, results: dict, block: int) -> DataFrame:
    """``df`` with ``results`` (name -> aggregate) over the rows at most ``before`` units back, today included."""
    halo = with_halo(df, at, block, before)
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(-before, 0)
    out = halo.withColumns({name: agg.over(w) for name, agg in results.items()})
    return out.filter("_own").select(*df.columns, *results)


def previous(df: DataFrame, keys: list[str], order: str, at: Column, columns: list[str], block: int, prefix: str = "_prev_") -> DataFrame:
    """``df`` with ``columns`` of the row before it in ``order`` (unique in a group) as ``_prev_<column>``; ``at`` is a number that
    grows with ``order``."""
    own = df.withColumns({"_block": F.floor(at.cast("long") / block), "_own": F.lit(True)})
    kept = [order, *[c for c in columns if c != order]]
    ends = own.groupBy(*keys, "_block").agg(F.max_by(F.struct(*kept), F.col(order)).alias("_end"))
    # one row for each block of a group
    next_block = F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block"))
    halo = ends.withColumn("_next", next_block).filter("_next IS NOT NULL").select(*keys, F.col("_next").alias("_block"), "_end.*", F.lit(False).alias("_own"))
    both = own.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    out = both.withColumns({prefix + c: F.lag(c).over(w) for c in columns})
    return out.filter("_own").drop("_block", "_own")
