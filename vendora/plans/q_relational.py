"""Filters, scalar expressions and joins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from vendora.functions import exprs as ex
from vendora.operators import relational as rel
from vendora.plans import q_baseline as qb
from vendora.plans import common as cm
from vendora.plans.registry import register
from vendora.sources import bindings as b

IN_SET_YEARS = (2021, 2022)          # the last two years, as the baseline's in-sample check
DATE_RANGE = ("2021-07-01", "2022-06-30")   # fold C validation span


def S(spark, sf):
    return b.Sources(spark, sf)


@register("filter_not_null", sql="SELECT customer_id, age_group FROM fx_customers WHERE age_group IS NOT NULL")
def q_not_null(spark, sf):
    return rel.filter_not_null(b.customers(S(spark, sf)), "age_group").select("customer_id", "age_group")


@register("filter_equals", sql="""
SELECT order_id, customer_id, order_date FROM fx_orders WHERE order_status = 'delivered'""")
def q_equals(spark, sf):
    o = b.orders(S(spark, sf), "delivered")
    return rel.filter_equals(o, "order_status", "delivered").select("order_id", "customer_id", "order_date")


@register("filter_in_set", rounding={"revenue": 2, "cogs": 2}, sql=f"""
SELECT date, revenue, cogs FROM fx_sales WHERE year(date) IN {IN_SET_YEARS}""")
def q_in_set(spark, sf):
    s = cm.sales_daily(spark, sf)
    s = s.withColumn("year", F.year("date"))
    return rel.filter_in_set(s, "year", list(IN_SET_YEARS)).select("date", "revenue", "cogs")


@register("filter_date_range", sql=f"""
SELECT order_id, order_date, order_status FROM fx_orders
WHERE order_date >= DATE '{DATE_RANGE[0]}' AND order_date <= DATE '{DATE_RANGE[1]}'""")
def q_date_range(spark, sf):
    o = b.orders(S(spark, sf), dates=DATE_RANGE)
    return rel.filter_date_range(o, "order_date", *DATE_RANGE).select("order_id", "order_date", "order_status")


@register("gross_margin_expr", rounding={"gross_margin": 9}, sql="""
SELECT product_id, price, cogs, (price - cogs) / nullif(price, 0) AS gross_margin FROM fx_products""")
def q_margin(spark, sf):
    p = b.products(S(spark, sf))
    return p.select("product_id", "price", "cogs", ex.gross_margin(F.col("price"), F.col("cogs")).alias("gross_margin"))


@register("line_revenue_expr", rounding={"line_revenue": 4}, sql="""
SELECT order_id, product_id, line_number, quantity * unit_price AS line_revenue FROM fx_order_items""")
def q_line_rev(spark, sf):
    i = b.order_items(S(spark, sf))
    return i.select("order_id", "product_id", "line_number",
                    ex.line_revenue(F.col("quantity"), F.col("unit_price")).alias("line_revenue"))


@register("log_target", rounding={"log_revenue": 9, "back_revenue": 4}, extra_ctes=[qb.SPINE_CTE, qb.DENSE_CTE], sql="""
SELECT date, ln(greatest(revenue, 1)) AS log_revenue, exp(ln(greatest(revenue, 1))) AS back_revenue FROM dense""")
def q_log(spark, sf):
    d = qb.total_daily(spark, sf)
    lg = ex.log_target(F.col("revenue"))
    return d.select("date", lg.alias("log_revenue"), ex.from_log(lg).alias("back_revenue"))


@register("clip_floor", rounding={"gross_profit": 2}, sql="""
SELECT series_id, date, greatest(revenue - cogs, 0) AS gross_profit FROM fx_sales_panel""")
def q_clip(spark, sf):
    p = cm.panel_daily(spark, sf)
    return p.select("series_id", "date", ex.clip_floor(F.col("revenue") - F.col("cogs")).alias("gross_profit"))


@register("round_money", sql="""
SELECT order_id, CAST(round(CAST(order_total AS DECIMAL(18,2)) * 1.1, 2) AS DOUBLE) AS total_with_tax
FROM fx_orders""")
def q_round(spark, sf):
    """Totals plus 10% tax to the cent; exact decimals, so half-cent ties
    round the same way everywhere (half away from zero)."""
    o = b.orders(S(spark, sf))
    taxed = F.col("order_total").cast("decimal(18,2)") * F.lit(Decimal("1.1"))
    return o.select("order_id", ex.round_money(taxed).cast("double").alias("total_with_tax"))


# ------------------------------------------------------------------ joins


@register("join_inner_equi", sql="""
SELECT r.order_id, r.product_id, r.return_reason, p.category, p.size
FROM fx_returns r JOIN fx_product_dims p USING (product_id)""")
def q_inner(spark, sf):
    s = S(spark, sf)
    r = b.returns(s).select("order_id", "product_id", "return_reason")
    return r.join(b.product_dims(s).select("product_id", "category", "size"), "product_id")


@register("join_left_fill", sql="""
SELECT c.customer_id, c.age_group, coalesce(o.order_count, 0) AS order_count
FROM fx_customers c LEFT JOIN (SELECT customer_id, count(*) AS order_count FROM fx_orders
                               WHERE order_status = 'delivered' GROUP BY 1) o USING (customer_id)""")
def q_left_fill(spark, sf):
    s = S(spark, sf)
    counts = (b.orders(s, "delivered").filter(F.col("order_status") == "delivered")
                         .groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count")))
    return rel.join_left_fill(b.customers(s).select("customer_id", "age_group"), counts, "customer_id",
                              {"order_count": 0})


@register("join_multiway", rounding={"line_revenue": 4}, sql="""
SELECT g.region, o.order_id, i.product_id, i.line_number, i.quantity * i.unit_price AS line_revenue
FROM fx_geography g JOIN fx_orders_zip o ON g.zip = o.zip JOIN fx_order_items i ON o.order_id = i.order_id
WHERE o.order_status = 'delivered'""")
def q_multiway(spark, sf):
    s = S(spark, sf)
    o = b.orders_with_zip(s, "delivered").filter(F.col("order_status") == "delivered").select("order_id", "zip")
    go = o.join(b.geography(s), "zip")
    i = b.order_items(s).select("order_id", "product_id", "line_number",
                                (F.col("quantity") * F.col("unit_price")).alias("line_revenue"))
    return go.join(i, "order_id").select("region", "order_id", "product_id", "line_number", "line_revenue")


@register("align_ratio", rounding={"ratio": 9}, sql="""
SELECT coalesce(r.size, l.size) AS size, r.n_returns, l.n_lines, CAST(r.n_returns AS DOUBLE) / l.n_lines AS ratio
FROM (SELECT p.size, count(*) AS n_returns FROM fx_returns x JOIN fx_product_dims p USING (product_id) GROUP BY 1) r
FULL OUTER JOIN (SELECT p.size, count(*) AS n_lines FROM fx_order_items x JOIN fx_product_dims p USING (product_id)
                 GROUP BY 1) l ON r.size = l.size""")
def q_align(spark, sf):
    """Returns by size over lines by size."""
    s = S(spark, sf)
    dims = b.product_dims(s).select("product_id", "size")
    num = b.returns(s).join(dims, "product_id").groupBy("size").agg(F.count(F.lit(1)).alias("n_returns"))
    den = (b.order_items(s).join(dims, "product_id")
                           .groupBy("size").agg(F.count(F.lit(1)).alias("n_lines")))
    return rel.align_ratio(num, den, "size", "n_returns", "n_lines")
