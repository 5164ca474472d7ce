"""Columns dealt out anew over all rows of a table, and what a linear model loses by it.

Two orders of all rows, each by a hash of the row's own key, give every row two ranks; the row at place k of the one
takes the values of the row at place k of the other.  Both ranks come from range partitions with counted offsets
(``global_prefix``), and the deal is an equi-join on the rank, so no task sees more than its share.  The
hash is md5 of the key as text: a lost task deals its rows again in the same way, and SQL can do the same.

Permutation importance: the absolute error on the log scale with one feature dealt out, less the error as it is.  For a
linear model a feature's dealt value moves the prediction by coef * (dealt - own) / sigma, so all features are scored in
one pass over the dealt rows.  The differences are added row by row, so a constant feature is exactly zero.

Cases: keys must tell rows apart (equal keys get their ranks in any order among them); null values of a row leave it
out of the scores; a table of one row is dealt to itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.operators.relational import global_prefix


def shuffle_key(seed: str, keys: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]))


def deal(rows: DataFrame, keys: list[str], carry: list[str], seeds: tuple = ("own", "dealt"), prefix: str = "dealt_") -> DataFrame:
    """``rows`` with ``carry`` of another row each, as ``dealt_<column>``: every row gives its values once."""
    here = global_prefix(rows.withColumn("_h", shuffle_key(seeds[0], keys)), ["_h", *keys], rank_out="_at").drop("_h", "cum")
    there = rows.select(*keys, *[F.col(c).alias(prefix + c) for c in carry if c not in keys], *[F.col(c).alias(prefix + c) for c in carry if c in keys])
    there = global_prefix(there.withColumn("_h", shuffle_key(seeds[1], keys)), ["_h", *keys], rank_out="_at")
    return here.join(there.select("_at", *[prefix + c for c in carry]), "_at").drop("_at")


def linear_importance(dealt: DataFrame, names: list[str], y: str, pred: str, x: str, x_dealt: str, sigma: str, coef: str) -> DataFrame:
    """(feature, n, mae, delta_mae) of a linear model; all columns but ``y`` and ``pred`` are arrays with one entry for each feature."""
    err = F.abs(F.col(y) - F.col(pred))
    move = F.zip_with(F.zip_with(x_dealt, x, lambda a, b: a - b), F.zip_with(coef, sigma, lambda w, s: w / s), lambda d, w: d * w)
    known = dealt.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    each = known.select(err.alias("_e"), F.posexplode(F.transform(move, lambda m: F.abs(F.col(y) - F.col(pred) - m) - err)).alias("_i", "_d"))
    out = each.groupBy("_i").agg(F.count("*").alias("n"), F.avg("_e").alias("mae"), F.avg("_d").alias("delta_mae"))
    return out.select(F.array(*[F.lit(c) for c in names])[F.col("_i")].alias("feature"), "n", "mae", "delta_mae")
