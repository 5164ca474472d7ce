"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 256                # a key is hot beyond this part of the rows; so there are fewer hot keys than this
PIECES = 64                # pieces that the rows of a hot key are dealt into


def left_join(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, spread: list) -> DataFrame:
    """``rows`` left join ``side`` on the non-null column ``key``, which is unique in ``side``.

    ``side[count]`` says how many of the ``total`` rows hold the key.  Rows of a hot key are
    dealt into pieces by the columns ``spread`` and meet one copy of the key for each piece.  At most
    ``SHARE`` keys are hot, so the table that marks them is bounded and is broadcast."""
    is_hot = F.col(count) * SHARE > F.lit(total)
    hot = side.filter(is_hot).select(F.col(key), F.lit(True).alias("__hot"))
    pieces = F.when(is_hot, F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    side = side.withColumn("__piece", F.explode(pieces)).drop(count)
    piece = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(PIECES)).cast("int")).otherwise(F.lit(0))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("__piece", piece).drop("__hot")
    return rows.join(side, [key, "__piece"], "left").drop("__piece")
