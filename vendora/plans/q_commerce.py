"""Business questions Q1-Q10 and the relational operator keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.operators import commerce as cm
from vendora.operators import relational as rel
from vendora.plans.registry import register, sql_flag
from vendora.sources import bindings as b

Q3_CATEGORY = "ECONOMY"


def S(spark, sf):
    return b.Sources(spark, sf)


# ---------------------------------------------------------------- Q1 .. Q10

@register("q01_median_order_gap", rounding={"median_gap_days": 6}, sql="""
SELECT CAST(median(gap) AS DOUBLE) AS median_gap_days, count(gap) AS n_gaps
FROM (SELECT date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date),
                       order_date) AS gap
      FROM fx_orders) g""")
def q01(spark, sf):
    return cm.q01_median_order_gap(b.orders(S(spark, sf)))


@register("q02_segment_margin", rounding={"avg_gross_margin": 6}, sql=f"""
SELECT segment, avg_gross_margin, {sql_flag('avg_gross_margin', 'segment')}
FROM (SELECT segment, avg((price - cogs) / price) AS avg_gross_margin
      FROM fx_products WHERE segment IS NOT NULL GROUP BY segment) a""")
def q02(spark, sf):
    return cm.q02_segment_margin(b.products(S(spark, sf)))


@register("q03_top_return_reason", sql=f"""
SELECT return_reason, n_returns, {sql_flag('n_returns', 'return_reason')}
FROM (SELECT r.return_reason, count(*) AS n_returns
      FROM fx_returns r JOIN fx_product_dims p USING (product_id)
      WHERE p.category = '{Q3_CATEGORY}' AND r.return_reason IS NOT NULL
      GROUP BY r.return_reason) a""")
def q03(spark, sf):
    s = S(spark, sf)
    return cm.q03_top_return_reason(b.returns(s), b.product_dims(s), Q3_CATEGORY)


@register("q04_bounce_by_source", rounding={"avg_bounce_rate": 6}, sql=f"""
SELECT traffic_source, avg_bounce_rate,
       {sql_flag('avg_bounce_rate', 'traffic_source', ascending=True, name='is_lowest')}
FROM (SELECT traffic_source, avg(bounce_rate) AS avg_bounce_rate
      FROM fx_web_traffic WHERE traffic_source IS NOT NULL GROUP BY traffic_source) a""")
def q04(spark, sf):
    return cm.q04_bounce_by_source(b.web_traffic(S(spark, sf)))


@register("q05_promo_line_share", rounding={"promo_pct": 6}, sql="""
SELECT count(*) AS n_lines, count(promo_id) AS n_promo_lines,
       CAST(count(promo_id) AS DOUBLE) * 100.0 / count(*) AS promo_pct
FROM fx_order_items""")
def q05(spark, sf):
    return cm.q05_promo_line_share(b.order_items(S(spark, sf)))


@register("q06_orders_per_customer_by_age", rounding={"avg_orders": 6}, sql=f"""
SELECT age_group, avg_orders, {sql_flag('avg_orders', 'age_group')}
FROM (SELECT c.age_group, avg(coalesce(o.order_count, 0)) AS avg_orders
      FROM fx_customers c
      LEFT JOIN (SELECT customer_id, count(*) AS order_count FROM fx_orders
                 WHERE order_status = 'delivered' GROUP BY customer_id) o USING (customer_id)
      WHERE c.age_group IS NOT NULL
      GROUP BY c.age_group) a""")
def q06(spark, sf):
    s = S(spark, sf)
    return cm.q06_orders_per_customer_by_age(b.customers(s), b.orders(s, "delivered"))


@register("q07_region_revenue", rounding={"revenue": 2}, sql=f"""
SELECT region, revenue, {sql_flag('revenue', 'region')}
FROM (SELECT g.region, sum(i.quantity * i.unit_price) AS revenue
      FROM fx_geography g
      JOIN fx_orders_zip o ON g.zip = o.zip
      JOIN fx_order_items i ON o.order_id = i.order_id
      WHERE o.order_status = 'delivered'
      GROUP BY g.region) a""")
def q07(spark, sf):
    s = S(spark, sf)
    return cm.q07_region_revenue(b.geography(s), b.orders_with_zip(s, "delivered"), b.order_items(s))


@register("q08_cancelled_by_payment", sql=f"""
SELECT payment_method, n_cancelled, {sql_flag('n_cancelled', 'payment_method')}
FROM (SELECT payment_method, count(*) AS n_cancelled FROM fx_orders
      WHERE order_status = 'cancelled' AND payment_method IS NOT NULL
      GROUP BY payment_method) a""")
def q08(spark, sf):
    return cm.q08_cancelled_by_payment(b.orders(S(spark, sf), "cancelled"))


@register("q09_return_rate_by_size", rounding={"return_rate": 6}, sql=f"""
SELECT size, n_lines, n_returns, return_rate, {sql_flag('return_rate', 'size')}
FROM (SELECT coalesce(l.size, r.size) AS size, l.n_lines, r.n_returns,
             CAST(r.n_returns AS DOUBLE) / l.n_lines AS return_rate
      FROM (SELECT p.size, count(*) AS n_lines FROM fx_order_items i
            JOIN fx_product_dims p USING (product_id) WHERE p.size IS NOT NULL GROUP BY p.size) l
      FULL OUTER JOIN
           (SELECT p.size, count(*) AS n_returns FROM fx_returns r
            JOIN fx_product_dims p USING (product_id) WHERE p.size IS NOT NULL GROUP BY p.size) r
      ON l.size = r.size) a""")
def q09(spark, sf):
    s = S(spark, sf)
    return cm.q09_return_rate_by_size(b.order_items(s), b.product_dims(s), b.returns(s))


@register("q10_aov_by_installments", rounding={"avg_order_value": 4}, sql=f"""
SELECT installments, avg_order_value, {sql_flag('avg_order_value', 'installments')}
FROM (SELECT installments, avg(payment_value) AS avg_order_value FROM fx_payments
      WHERE installments IS NOT NULL GROUP BY installments) a""")
def q10(spark, sf):
    return cm.q10_aov_by_installments(b.payments(S(spark, sf)))
