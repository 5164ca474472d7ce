"""Order-keyed tables written once in co-located buckets.

Orders and their lines are both dealt into the same number of buckets by order id, each bucket one sorted file.  Every
later join on the order id, and every sum per order, then finds its rows where they lie: no exchange above the scans,
however often the tables are used.  Worth it where several reports read the same tables; the write is the one shuffle.

``n_buckets`` should make a bucket of the larger table a task's work (some 200 MB): at 100 TB some 500,000 buckets are too many
files, so write by period there (one table a year, say) and read the period.

Cases: null keys share a bucket and join with nothing; an empty table has no files and reads as empty; writing under a name that
exists replaces the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.operators.relational import line_value, rank_flag
from vendora.session import scratch_path
from vendora.sources import bindings as b


def write_bucketed(df: DataFrame, name: str, key: str, n_buckets: int, path: str) -> DataFrame:
    """Write ``df`` as table ``name`` under ``path`` and read it back; dealt by the key first, so that each bucket is
    one file."""
    (df.repartition(n_buckets, key).write.bucketBy(n_buckets, key).sortBy(key)
     .option("path", path).mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)


def bucketed_orders(spark: SparkSession, sf: str, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """(orders with their zip, lines), both bucketed by order_id under the session's scratch folder."""
    s, tag = b.Sources(spark, sf), uuid.uuid4().hex[:12]
    orders = write_bucketed(b.orders_with_zip(s), f"orders_by_id_{tag}", "order_id", n_buckets, scratch_path(spark, "orders-by-id"))
    items = b.order_items(s).select("order_id", "product_id", "line_number", "quantity", line_value(b.order_items(s)).alias("value"),
                                    F.col("promo_id").isNotNull().alias("has_promo"))
    return orders, write_bucketed(items, f"lines_by_id_{tag}", "order_id", n_buckets, scratch_path(spark, "lines-by-id"))


def order_values(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Each order with the sum of its lines; no exchange where both are bucketed alike."""
    per = items.groupBy("order_id").agg(F.sum("value").alias("value"))
    return orders.join(per.hint("merge"), "order_id")


def region_revenue(orders: DataFrame, items: DataFrame, geography: DataFrame) -> DataFrame:
    per = order_values(orders.filter("order_status = 'delivered'").select("order_id", "zip"), items)
    zips = per.groupBy("zip").agg(F.sum("value").alias("value"))
    agg = zips.join(geography, "zip").groupBy("region").agg(F.sum("value").cast("double").alias("revenue"))
    return rank_flag(agg, "region", "revenue")


def channel_mix(orders: DataFrame, items: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    per = order_values(orders.select("order_id", "order_date", "payment_method"), items)
    a = per.groupBy(F.year("order_date").alias("year"), F.col("payment_method").alias("channel")).agg(F.sum("value").cast("double").alias("revenue"))
    return a.withColumn("share", F.col("revenue") / F.sum("revenue").over(Window.partitionBy("year")))
