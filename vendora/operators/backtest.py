"""Walk-forward folds as data: the fold is a column, not a loop.

A row may sit in several folds (folds overlap), so the daily frame is range-
joined to the folds table (3 rows, broadcast) and every later statistic is
grouped by ``fold``.  One plan therefore fits and scores all folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.operators import baseline as bl

# Fixed values: (fold, train_end, val_start, val_end)
FOLDS = [
    ("A", "2021-12-31", "2022-01-01", "2022-12-31"),
    ("B", "2020-12-31", "2021-01-01", "2021-12-31"),
    ("C", "2021-06-30", "2021-07-01", "2022-06-30"),
]


def folds_df(spark: SparkSession, folds=FOLDS) -> DataFrame:
    rows = [(f, a, b, c) for f, a, b, c in folds]
    df = spark.createDataFrame(rows, "fold string, train_end string, val_start string, val_end string")
    return df.select("fold", *[F.col(c).cast("date").alias(c) for c in ("train_end", "val_start", "val_end")])


def assign_folds(daily: DataFrame, folds: DataFrame, date_col: str = "date") -> DataFrame:
    """(fold, role, train_end, *daily) with role 'train' (date <= train_end) or
    'val' (val_start <= date <= val_end).  The folds table is a handful of rows."""
    d = F.col(date_col)
    cond = (d <= F.col("train_end")) | ((d >= F.col("val_start")) & (d <= F.col("val_end")))
    j = daily.join(F.broadcast(folds), cond)
    role = F.when(d <= F.col("train_end"), F.lit("train")).otherwise(F.lit("val"))
    return j.select("fold", role.alias("role"), "train_end", *daily.columns)


def fold_summary(assigned: DataFrame, date_col: str = "date") -> DataFrame:
    return assigned.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"),
                                                F.min(date_col).alias("min_date"),
                                                F.max(date_col).alias("max_date"))


def baseline_backtest(daily: DataFrame, folds: DataFrame, keys: list[str], values: list[str],
                      date_col: str = "date") -> DataFrame:
    """Fit the seasonal baseline per (fold, keys) on train rows; score val rows.

    Output: fold, *keys, date, actual_<v>, pred_<v> (unrounded predictions).
    """
    a = assign_folds(daily, folds, date_col)
    train = a.filter(F.col("role") == "train")
    val = a.filter(F.col("role") == "val").drop("role", "train_end")
    k = ["fold"] + keys
    pred = bl.fit_predict(train, val, k, values, date_col, span_end_col="train_end", round_to=None)
    return pred.select(*k, date_col, *[F.col(v).alias(f"actual_{v}") for v in values],
                       *[F.col(f"pred_{v}") for v in values])
