"""Shared, materialized intermediates of the plans.

The daily sales series (company total and region x category panel) feed most
forecasting and diagnostic keys, and each of those plans references the series
several times (bounds as scalar subqueries, folds, horizon).  Without
materialization every reference re-runs the lineitem x orders x part join.
The series is bounded by days x series, so it is computed once per session
and source folder and cut from its lineage with a reliable ``checkpoint()``
into the session's ``spark.checkpoint.dir`` (shared storage on a cluster, so it
survives executor loss; never ``localCheckpoint``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.operators import calendar_ops as co
from vendora.session import ensure_checkpoint_dir
from vendora.sources import bindings as b

VALUES = ["revenue", "cogs"]
_MEMO: dict = {}


_SEEN: dict = {}


def _files(spark: SparkSession, sf: str) -> int:
    """Fingerprint of the source files of the sales tables (their contents aren't read), taken once for each
    application and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _SEEN:
        names = [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "customer", "part", "nation", "region")]
        files = spark.read.format("binaryFile").load(names).select("path", "length", "modificationTime")
        _SEEN[at] = files.agg(F.bit_xor(F.xxhash64(*files.columns))).first()[0]
    return _SEEN[at]


def materialized(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """``build()`` checkpointed once per (application, source folder, name)."""
    # the files' names stand for their contents: a rewritten table has new ones or another size
    key = (spark.sparkContext.applicationId, sf, name, _files(spark, sf))
    if key not in _MEMO:
        ensure_checkpoint_dir(spark)
        _MEMO[key] = build().checkpoint(eager=True)
    return _MEMO[key]


def panel_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The one scan of lines, orders and products that all sales series come from."""
    return materialized(spark, sf, "panel_exact", lambda: b.sales_panel(b.Sources(spark, sf)))


def inventory_items(spark: SparkSession, sf: str) -> DataFrame:
    """Units per product and day, for all inventory keys."""
    return materialized(spark, sf, "inventory_items", lambda: b.inventory_items(b.Sources(spark, sf)))


def inventory_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Units per brand and day."""
    return materialized(spark, sf, "inventory_daily", lambda: b.inventory_daily(inventory_items(spark, sf)))


def sales_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Company daily totals (days with orders only)."""
    return materialized(spark, sf, "sales_daily", lambda: b.sales(panel_exact(spark, sf)))


def total_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Densified company-total series keyed by a constant series id."""
    def build():
        dense = co.densify(sales_daily(spark, sf), [], "date", VALUES)
        return dense.select(F.lit("TOTAL").alias("series_id"), "date", *VALUES)
    return materialized(spark, sf, "total_daily", build)


def panel_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Region x category daily series, sparse (days with orders only)."""
    return b.rounded(panel_exact(spark, sf))


def panel_dense(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "panel_dense",
                        lambda: co.densify(panel_daily(spark, sf), ["series_id"], "date", VALUES))
