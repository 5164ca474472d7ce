"""Business dashboard keys with literal SQL twins."""

from __future__ import annotations

from vendora.operators import dashboards as db
from vendora.plans import common as cm
from vendora.plans.registry import register
from vendora.sources import bindings as b


def S(spark, sf):
    return b.Sources(spark, sf)


@register("bi_revenue_yoy", rounding={"revenue": 2, "cogs": 2, "yoy": 9}, sql="""
SELECT year, revenue, cogs, revenue / nullif(lag(revenue) OVER (ORDER BY year), 0) - 1 AS yoy
FROM (SELECT CAST(year(date) AS INTEGER) AS year, sum(revenue) AS revenue, sum(cogs) AS cogs
      FROM fx_sales GROUP BY 1) a""")
def q_yoy(spark, sf):
    return db.revenue_yoy(cm.sales_daily(spark, sf))


@register("bi_revenue_cagr", rounding={"cagr": 9}, sql="""
SELECT min(year) AS first_year, max(year) AS last_year, count(*) AS n_years,
       pow(arg_max(revenue, year) / nullif(arg_min(revenue, year), 0), 1.0 / (count(*) - 1)) - 1 AS cagr
FROM (SELECT CAST(year(date) AS INTEGER) AS year, sum(revenue) AS revenue FROM fx_sales GROUP BY 1) a,
     (SELECT min(date) AS s, max(date) AS e FROM fx_sales) sp
WHERE make_date(year, 1, 1) >= sp.s AND make_date(year, 12, 31) <= sp.e""")
def q_cagr(spark, sf):
    return db.revenue_cagr(cm.sales_daily(spark, sf))


@register("bi_margin_trend", rounding={"revenue": 2, "cogs": 2, "margin": 9, "margin_3m": 9}, sql="""
SELECT *, avg(margin) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
            AS margin_3m
FROM (SELECT series_id, month, revenue, cogs, (revenue - cogs) / nullif(revenue, 0) AS margin
      FROM (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(revenue) AS revenue,
                   sum(cogs) AS cogs
            FROM fx_sales_panel GROUP BY 1, 2) a) m""")
def q_margin(spark, sf):
    return db.margin_trend(cm.panel_daily(spark, sf))


@register("bi_category_mix", rounding={"revenue": 2, "share": 9, "margin": 9}, sql="""
SELECT category, revenue, revenue / sum(revenue) OVER () AS share, (revenue - cost) / nullif(revenue, 0) AS margin
FROM (SELECT p.category, sum(i.quantity * i.unit_price) AS revenue, sum(i.quantity * p.cogs) AS cost
      FROM fx_order_items i JOIN fx_product_dims p USING (product_id) GROUP BY p.category) a""")
def q_catmix(spark, sf):
    s = S(spark, sf)
    return db.category_mix(b.order_items(s), b.product_dims(s))


@register("bi_seasonality", rounding={"avg_revenue": 2, "avg_orders": 6}, sql="""
SELECT coalesce(r.month_no, o.month_no) AS month_no, avg(r.revenue) AS avg_revenue, avg(o.orders) AS avg_orders
FROM (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_no, sum(revenue) AS revenue
      FROM fx_sales GROUP BY 1, 2) r
FULL OUTER JOIN (SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month_no,
                        count(*) AS orders FROM fx_orders GROUP BY 1, 2) o
  ON r.year = o.year AND r.month_no = o.month_no
GROUP BY 1""")
def q_season(spark, sf):
    s = S(spark, sf)
    return db.seasonality(cm.sales_daily(spark, sf), b.orders(s))


RFM_CTE = ("rfm", """
  SELECT customer_id, monetary,
         CAST(ntile(5) OVER (ORDER BY recency DESC, customer_id) AS INTEGER) AS R,
         CAST(ntile(5) OVER (ORDER BY freq, customer_id) AS INTEGER) AS F,
         CAST(ntile(5) OVER (ORDER BY monetary, customer_id) AS INTEGER) AS M
  FROM (SELECT customer_id, date_diff('day', max(order_date), (SELECT max(order_date) FROM fx_orders)) AS recency,
               count(*) AS freq, sum(CAST(order_total AS DECIMAL(18,2))) AS monetary
        FROM fx_orders WHERE order_status = 'delivered' GROUP BY customer_id) p""")


@register("bi_rfm_segments", rounding={"avg_m": 9, "monetary": 2}, extra_ctes=[RFM_CTE], sql="""
SELECT CASE WHEN s.R IS NULL THEN 'Never Purchased'
            WHEN s.R >= 4 AND s.F >= 4 THEN 'Champions'
            WHEN s.R <= 2 AND s.F >= 3 THEN 'At Risk'
            WHEN s.R <= 2 AND s.F <= 2 THEN 'Lost'
            ELSE 'Active' END AS segment, count(*) AS n_customers, avg(s.M) AS avg_m, count(*) FILTER (WHERE s.M = 5) AS n_top_m,
       CAST(sum(s.monetary) AS DOUBLE) AS monetary
FROM fx_customers c LEFT JOIN rfm s USING (customer_id)
GROUP BY 1""")
def q_rfm(spark, sf):
    s = S(spark, sf)
    return db.rfm_segments(b.customers(s), b.orders(s), b.orders(s, "delivered"))


@register("bi_rfm_scores", rounding={"monetary": 2}, extra_ctes=[RFM_CTE], sql="SELECT customer_id, R, F, M, monetary FROM rfm")
def q_rfm_scores(spark, sf):
    s = S(spark, sf)
    return db.rfm_scores(b.orders(s), b.orders(s, "delivered"))


@register("bi_cohort_retention", rounding={"rate": 9}, sql="""
SELECT a.cohort, a.month_offset, a.customers, z.cohort_size, CAST(a.customers AS DOUBLE) / z.cohort_size AS rate
FROM (SELECT c.cohort, CAST(date_diff('month', c.cohort, x.month) AS INTEGER) AS month_offset, count(*) AS customers
      FROM (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS month FROM fx_orders) x
      JOIN (SELECT customer_id, min(CAST(date_trunc('month', order_date) AS DATE)) AS cohort
            FROM fx_orders GROUP BY 1) c USING (customer_id)
      GROUP BY 1, 2) a
JOIN (SELECT cohort, count(*) AS cohort_size
      FROM (SELECT customer_id, min(CAST(date_trunc('month', order_date) AS DATE)) AS cohort FROM fx_orders GROUP BY 1)
      GROUP BY 1) z USING (cohort)""")
def q_cohort(spark, sf):
    return db.cohort_retention(b.orders(S(spark, sf)))


@register("bi_one_and_done", rounding={"share": 9}, sql="""
SELECT count(*) AS n_customers, count(*) FILTER (WHERE n = 1) AS n_one_order,
       CAST(count(*) FILTER (WHERE n = 1) AS DOUBLE) / count(*) AS share
FROM (SELECT customer_id, count(*) AS n FROM fx_orders GROUP BY 1) t""")
def q_one(spark, sf):
    return db.one_and_done(b.orders(S(spark, sf)))


@register("bi_promo_order_share", rounding={"share": 9}, sql="""
SELECT count(*) AS n_orders, sum(p) AS n_promo_orders, avg(p) AS share
FROM (SELECT order_id, max(CAST(promo_id IS NOT NULL AS INTEGER)) AS p FROM fx_order_items GROUP BY 1) t""")
def q_promo_share(spark, sf):
    return db.promo_order_share(b.order_items(S(spark, sf)))


@register("bi_promo_aov", rounding={"aov": 4}, sql="""
SELECT category, promo, avg(value) AS aov, count(*) AS n_orders
FROM (SELECT i.order_id, p.category, sum(i.quantity * i.unit_price) AS value,
             max(CAST(i.promo_id IS NOT NULL AS INTEGER)) AS promo
      FROM fx_order_items i JOIN fx_product_dims p USING (product_id) GROUP BY 1, 2) t
GROUP BY 1, 2""")
def q_promo_aov(spark, sf):
    s = S(spark, sf)
    return db.promo_aov(b.order_items(s), b.product_dims(s))


@register("bi_promo_vs_full_price", rounding={"promo_rev": 2, "full_rev": 2}, sql="""
SELECT CAST(month(o.order_date) AS INTEGER) AS month_no,
       sum(i.quantity * i.unit_price) FILTER (WHERE i.promo_id IS NOT NULL) AS promo_rev,
       sum(i.quantity * i.unit_price) FILTER (WHERE i.promo_id IS NULL) AS full_rev
FROM fx_order_items i JOIN fx_orders o USING (order_id) GROUP BY 1""")
def q_promo_full(spark, sf):
    s = S(spark, sf)
    return db.promo_vs_full_price(b.order_items(s), b.orders(s))


@register("bi_channel_mix", rounding={"revenue": 2, "share": 9}, sql="""
SELECT *, revenue / sum(revenue) OVER (PARTITION BY year) AS share
FROM (SELECT CAST(year(o.order_date) AS INTEGER) AS year, o.payment_method AS channel,
             sum(i.quantity * i.unit_price) AS revenue
      FROM fx_order_items i JOIN fx_orders o USING (order_id) GROUP BY 1, 2) a""")
def q_channel_mix(spark, sf):
    s = S(spark, sf)
    return db.channel_mix(b.order_items(s), b.orders(s))


@register("bi_channel_ltv", rounding={"avg_ltv": 4}, sql="""
SELECT c.acquisition_channel AS channel, count(*) AS n_customers, avg(coalesce(l.ltv, 0.0)) AS avg_ltv
FROM fx_customers c LEFT JOIN (
  SELECT o.customer_id, sum(v) AS ltv
  FROM fx_orders o JOIN (SELECT order_id, sum(quantity * unit_price) AS v FROM fx_order_items GROUP BY 1) x
    USING (order_id) GROUP BY 1) l USING (customer_id)
GROUP BY 1""")
def q_ltv(spark, sf):
    s = S(spark, sf)
    return db.channel_ltv(b.customers(s), b.orders(s), b.order_items(s))


@register("bi_traffic_trend", rounding={"avg_bounce_rate": 9}, sql="""
SELECT date, traffic_source, count(*) AS visits, avg(bounce_rate) AS avg_bounce_rate
FROM fx_web_traffic GROUP BY 1, 2""")
def q_traffic(spark, sf):
    return db.traffic_trend(b.web_traffic(S(spark, sf)))


@register("bi_lead_time", rounding={"avg_days": 9, "p50_days": 9, "p90_days": 9}, sql="""
SELECT g.region, 'order_to_ship' AS leg, count(*) FILTER (WHERE s.lead_days >= 0) AS n,
       avg(s.lead_days) FILTER (WHERE s.lead_days >= 0) AS avg_days,
       CAST(quantile_cont(s.lead_days, 0.5) FILTER (WHERE s.lead_days >= 0) AS DOUBLE) AS p50_days,
       CAST(quantile_cont(s.lead_days, 0.9) FILTER (WHERE s.lead_days >= 0) AS DOUBLE) AS p90_days,
       count(*) FILTER (WHERE s.lead_days < 0) AS n_excluded
FROM fx_shipments s JOIN fx_geography g USING (zip) GROUP BY 1""")
def q_lead(spark, sf):
    s = S(spark, sf)
    return db.lead_time(b.shipments(s), b.geography(s))


@register("bi_stockout_rate", rounding={"rate": 9}, sql="""
SELECT 'overall' AS scope, avg(stockout_flag) AS rate FROM fx_inventory
UNION ALL
SELECT 'latest', avg(stockout_flag) FROM fx_inventory WHERE month = (SELECT max(month) FROM fx_inventory)""")
def q_stockout(spark, sf):
    return db.stockout_rate(b.inventory(cm.inventory_daily(spark, sf)))


@register("bi_sellthrough_vs_stockout", rounding={"avg_stockout_days": 9, "corr": 9}, sql="""
SELECT CAST(least(floor(sell_through / 0.2), 4) AS INTEGER) AS bucket, count(*) AS n,
       avg(stockout_days) AS avg_stockout_days,
       (SELECT corr(sell_through, stockout_days) FROM fx_inventory) AS corr
FROM fx_inventory GROUP BY 1""")
def q_sellthrough(spark, sf):
    return db.sellthrough_vs_stockout(b.inventory(cm.inventory_daily(spark, sf)))


@register("bi_fill_rate", rounding={"fill_rate": 9}, sql="""
SELECT month, sum(filled) / nullif(sum(sold), 0) AS fill_rate FROM fx_inventory GROUP BY 1""")
def q_fill(spark, sf):
    return db.fill_rate(b.inventory(cm.inventory_daily(spark, sf)))


_HOT = ", ".join(f"max(CASE WHEN size = '{z}' THEN rate END) AS {z}" for z in db.SIZES)


@register("bi_return_hotspot", rounding={z: 9 for z in db.SIZES}, sql=f"""
SELECT category, {_HOT}
FROM (SELECT coalesce(l.category, r.category) AS category, coalesce(l.size, r.size) AS size,
             CAST(r.n_returns AS DOUBLE) / l.n_lines AS rate
      FROM (SELECT p.category, p.size, count(*) AS n_lines FROM fx_order_items i
            JOIN fx_product_dims p USING (product_id) GROUP BY 1, 2) l
      FULL OUTER JOIN (SELECT p.category, p.size, count(*) AS n_returns FROM fx_returns r
            JOIN fx_product_dims p USING (product_id) GROUP BY 1, 2) r
      ON l.category = r.category AND l.size = r.size) t
GROUP BY category""")
def q_hotspot(spark, sf):
    s = S(spark, sf)
    return db.return_hotspot(b.order_items(s), b.returns(s), b.product_dims(s))


@register("bi_top_return_products", rounding={"rate": 9}, sql=f"""
SELECT l.product_id, l.n_lines, coalesce(r.n_returns, 0) AS n_returns,
       CAST(coalesce(r.n_returns, 0) AS DOUBLE) / l.n_lines AS rate
FROM (SELECT product_id, count(*) AS n_lines FROM fx_order_items GROUP BY 1) l
LEFT JOIN (SELECT product_id, count(*) AS n_returns FROM fx_returns GROUP BY 1) r USING (product_id)
WHERE l.n_lines >= {db.TOP_RETURN_MIN_LINES}
ORDER BY rate DESC, l.product_id LIMIT {db.TOP_RETURN_K}""")
def q_top_returns(spark, sf):
    s = S(spark, sf)
    return db.top_return_products(b.order_items(s), b.returns(s))


@register("bi_refund_total", sql="""
SELECT CAST(year(return_date) AS INTEGER) AS year, CAST(round(sum(refund_amount), 2) AS DOUBLE) AS refund
FROM fx_returns GROUP BY 1""")
def q_refund(spark, sf):
    return db.refund_total(b.returns(S(spark, sf)))


@register("bi_region_orders", sql="""
SELECT g.region, count(DISTINCT o.order_id) AS n_orders
FROM fx_orders_zip o JOIN fx_geography g USING (zip) GROUP BY 1""")
def q_region_orders(spark, sf):
    s = S(spark, sf)
    return db.region_orders(b.orders(s), b.customers(s), b.geography(s))


@register("bi_abc_class", rounding={"revenue": 2, "cum_share": 9}, sql=f"""
SELECT product_id, CAST(revenue AS DOUBLE) AS revenue, rank, (CAST(cum AS DOUBLE) / CAST(total AS DOUBLE)) AS cum_share,
       CASE WHEN (CAST(cum AS DOUBLE) / CAST(total AS DOUBLE)) <= {db.ABC_A} THEN 'A'
            WHEN (CAST(cum AS DOUBLE) / CAST(total AS DOUBLE)) <= {db.ABC_B} THEN 'B' ELSE 'C' END AS abc_class
FROM (SELECT product_id, revenue,
             row_number() OVER (ORDER BY revenue DESC, product_id) AS rank,
             sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS cum,
             sum(revenue) OVER () AS total
      FROM (SELECT product_id, sum(CAST(extended_price AS DECIMAL(18,2))) AS revenue
            FROM fx_order_items GROUP BY 1) p) t""")
def q_abc(spark, sf):
    return db.abc_class(b.order_items(S(spark, sf)))


@register("bi_reorder_trigger", sql=f"""
SELECT product_id, month, min(day) AS trigger_date
FROM (SELECT d.product_id, d.month, d.day, r.received,
             sum(d.units) OVER (PARTITION BY d.product_id, d.month ORDER BY d.day
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM fx_inv_items d
      JOIN (SELECT product_id, avg(sold) AS received
            FROM (SELECT product_id, month, sum(units) AS sold FROM fx_inv_items GROUP BY 1, 2) GROUP BY 1) r
        USING (product_id)) t
WHERE running / received >= {db.REORDER_THRESHOLD}
GROUP BY 1, 2""")
def q_reorder(spark, sf):
    daily = cm.inventory_items(spark, sf)
    return db.reorder_trigger(daily, b.mean_received(daily, "product_id"))
