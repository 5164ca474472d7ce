"""The ten business questions, each a single lazy plan over commerce views.

Inputs are DataFrames with the shop's column names (see FIXTURES.md); outputs
are small tidy tables.  Where a question asks for "the" best group, the whole
aggregated table is returned with an ``is_top`` flag (ties -> first key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.operators.relational import exact_quantile_from_counts, line_value, rank_flag


def q01_median_order_gap(orders: DataFrame) -> DataFrame:
    """Median number of days between consecutive orders of the same customer.

    Skew-safe form: orders are first reduced to (customer, day, n) so a
    customer with a huge share of the orders contributes at most one row per
    calendar day to the window; the ``n - 1`` same-day repeats are zero gaps.
    The median is then exact over the (gap, count) histogram, whose size is
    bounded by the date span, so no task ever holds all gaps.
    """
    per_day = (orders.filter(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
                     .groupBy("customer_id", "order_date").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("customer_id").orderBy("order_date")
    gap = F.datediff("order_date", F.lag("order_date").over(w))
    # one pass over the per-day rows: each emits its gap to the previous order
    # day (weight 1) and its same-day repeats (gap 0, weight n - 1)
    pairs = per_day.withColumn("_gap", gap).select(F.explode(F.array(
        F.struct(F.col("_gap").alias("gap"), F.lit(1).cast("long").alias("w")),
        F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("w")))).alias("p"))
    hist = (pairs.select("p.gap", "p.w").filter(F.col("gap").isNotNull() & (F.col("w") > 0))
                 .groupBy("gap").agg(F.sum("w").alias("w")))
    return exact_quantile_from_counts(hist, "gap", "w", 0.5, out="median_gap_days", n_out="n_gaps")


def q02_segment_margin(products: DataFrame) -> DataFrame:
    margin = F.try_divide(F.col("price") - F.col("cogs"), F.col("price"))
    agg = (products.filter(F.col("segment").isNotNull())
                   .groupBy("segment").agg(F.avg(margin).alias("avg_gross_margin")))
    return rank_flag(agg, "segment", "avg_gross_margin")


def q03_top_return_reason(returns: DataFrame, products: DataFrame, category: str) -> DataFrame:
    """Return reasons within one category.  The category filter is applied to
    products before the join (the reference filters after), so only matching
    product keys are shuffled."""
    p = products.filter(F.col("category") == F.lit(category)).select("product_id")
    agg = (returns.join(p, "product_id").filter(F.col("return_reason").isNotNull())
                  .groupBy("return_reason").agg(F.count(F.lit(1)).alias("n_returns")))
    return rank_flag(agg, "return_reason", "n_returns")


def q04_bounce_by_source(traffic: DataFrame) -> DataFrame:
    agg = (traffic.filter(F.col("traffic_source").isNotNull())
                  .groupBy("traffic_source").agg(F.avg("bounce_rate").alias("avg_bounce_rate")))
    return rank_flag(agg, "traffic_source", "avg_bounce_rate", ascending=True, flag="is_lowest")


def q05_promo_line_share(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count("promo_id").alias("n_promo_lines"),
        (F.count("promo_id") * 100.0 / F.count(F.lit(1))).alias("promo_pct"),
    )


def q06_orders_per_customer_by_age(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivered orders per customer by age group, customers without one count 0.
    Counting happens per customer before the join (pre-aggregation)."""
    counts = (orders.filter(F.col("order_status") == "delivered")
                    .groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count")))
    c = customers.filter(F.col("age_group").isNotNull()).select("customer_id", "age_group")
    j = c.join(counts, "customer_id", "left").fillna(0, ["order_count"])
    agg = j.groupBy("age_group").agg(F.avg("order_count").alias("avg_orders"))
    return rank_flag(agg, "age_group", "avg_orders")


def q07_region_revenue(geography: DataFrame, orders_zip: DataFrame, items: DataFrame) -> DataFrame:
    """Revenue by region over delivered orders: the planner
    broadcasts a small geography, the delivered filter reaches the orders scan.  Lines are summed per order
    before the join (partial aggregation map-side), so the join sees one row
    per order and an order with a huge number of lines cannot skew it."""
    o = orders_zip.filter(F.col("order_status") == "delivered").select("order_id", "zip")
    go = o.join(geography, "zip")
    per = items.groupBy("order_id").agg(F.sum(line_value(items)).alias("v"))
    j = go.join(per, "order_id")
    agg = j.groupBy("region").agg(F.sum("v").cast("double").alias("revenue"))
    return rank_flag(agg, "region", "revenue")


def q08_cancelled_by_payment(orders: DataFrame) -> DataFrame:
    agg = (orders.filter((F.col("order_status") == "cancelled") & F.col("payment_method").isNotNull())
                 .groupBy("payment_method").agg(F.count(F.lit(1)).alias("n_cancelled")))
    return rank_flag(agg, "payment_method", "n_cancelled")


def q09_return_rate_by_size(items: DataFrame, products: DataFrame, returns: DataFrame) -> DataFrame:
    """Returned lines by size / order lines by size, outer-aligned on size.

    Both sides are counted per product first (at most one row per product per
    map task after the partial aggregate), then joined to the product sizes.
    """
    p = products.filter(F.col("size").isNotNull()).select("product_id", "size")
    lines = (items.groupBy("product_id").agg(F.count(F.lit(1)).alias("c")).join(p, "product_id")
                  .groupBy("size").agg(F.sum("c").alias("n_lines")))
    rets = (returns.groupBy("product_id").agg(F.count(F.lit(1)).alias("c")).join(p, "product_id")
                   .groupBy("size").agg(F.sum("c").alias("n_returns")))
    j = lines.join(rets, "size", "full_outer")
    j = j.withColumn("return_rate", F.try_divide(F.col("n_returns").cast("double"),
                                                 F.col("n_lines").cast("double")))
    return rank_flag(j, "size", "return_rate")


def q10_aov_by_installments(payments: DataFrame) -> DataFrame:
    agg = (payments.filter(F.col("installments").isNotNull())
                   .groupBy("installments").agg(F.avg("payment_value").alias("avg_order_value")))
    return rank_flag(agg, "installments", "avg_order_value")
