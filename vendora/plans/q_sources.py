"""Sources and sinks.

The loader keys write the shop's files as CSV (from the driver tables, with
the header noise the loaders must clean) into a fresh folder under the
cluster's shared checkpoint folder, then read them back with the loaders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.plans import q_baseline as qb
from vendora.plans import common as cm
from vendora.plans.registry import register
from vendora.session import scratch_path
from vendora.sources import bindings as b
from vendora.sources import csv_io as io

SALES_HEADER = [" Date ", "REVENUE", "Cogs "]
PROMO_HEADER = ["Promo_ID", " start_date", "END_DATE ", "discount_value", "Stackable_Flag"]
TRAFFIC_HEADER = ["DATE", " Traffic_Source ", "bounce_rate"]


def S(spark, sf):
    return b.Sources(spark, sf)


def sales_csv(spark, sf) -> str:
    s = cm.sales_daily(spark, sf).select("date", F.col("revenue").cast("decimal(18,2)"),
                                     F.col("cogs").cast("decimal(18,2)"))
    return io.write_csv(s, scratch_path(spark, "sales"), SALES_HEADER)


def promotions_frame(spark, sf):
    s = S(spark, sf)
    j = b.order_items(s).filter(F.col("promo_id").isNotNull()).join(
        b.orders(s).select("order_id", "order_date"), "order_id")
    return j.groupBy("promo_id").agg(
        F.min("order_date").alias("start_date"), F.max("order_date").alias("end_date"),
        F.round(F.max("discount") * 100, 2).alias("discount_value"),
        F.max(F.col("promo_id_2").isNotNull().cast("int")).alias("stackable_flag"))


def promotions_csv(spark, sf) -> str:
    return io.write_csv(promotions_frame(spark, sf), scratch_path(spark, "promotions"), PROMO_HEADER)


def traffic_csv(spark, sf) -> str:
    t = b.web_traffic(S(spark, sf)).select("date", "traffic_source", "bounce_rate")
    return io.write_csv(t, scratch_path(spark, "web_traffic"), TRAFFIC_HEADER)


@register("sales_load", sql="SELECT date, revenue, cogs FROM fx_sales")
def q_sales_load(spark, sf):
    return io.load_sales(spark, sales_csv(spark, sf))


PROMO_SQL = """
SELECT i.promo_id, min(o.order_date) AS start_date, max(o.order_date) AS end_date,
       round(max(i.discount) * 100, 2) AS discount_value,
       max(CAST(i.promo_id_2 IS NOT NULL AS INTEGER)) AS stackable_flag
FROM fx_order_items i JOIN fx_orders o USING (order_id) WHERE i.promo_id IS NOT NULL GROUP BY 1"""


@register("promotions_load", sql=PROMO_SQL)
def q_promo_load(spark, sf):
    return io.load_promotions(spark, promotions_csv(spark, sf))


@register("web_traffic_load", sql="SELECT date, traffic_source, bounce_rate FROM fx_web_traffic")
def q_traffic_load(spark, sf):
    return io.load_web_traffic(spark, traffic_csv(spark, sf))


@register("catalog_load", sql=f"""
SELECT 'sales' AS "table", count(*) AS rows FROM fx_sales
UNION ALL SELECT 'promotions', count(*) FROM ({PROMO_SQL}) p
UNION ALL SELECT 'web_traffic', count(*) FROM fx_web_traffic""")
def q_catalog(spark, sf):
    cat = io.load_catalog(spark, {"sales": sales_csv(spark, sf), "promotions": promotions_csv(spark, sf),
                                  "web_traffic": traffic_csv(spark, sf)})
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, df in cat.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("typed_csv_scan", sql="""
SELECT order_id, product_id, line_number, quantity, unit_price, promo_id, promo_id_2 FROM fx_order_items""")
def q_typed_scan(spark, sf):
    items = b.order_items(S(spark, sf)).select(*[f.name for f in io.ORDER_ITEMS_SCHEMA.fields])
    path = io.write_csv(items, scratch_path(spark, "order_items"))
    return io.read_typed(spark, path, io.ORDER_ITEMS_SCHEMA)


@register("load_profile", sql="""
SELECT 'sales' AS "table", count(*) AS rows, min(date) AS min_date, max(date) AS max_date FROM fx_sales
UNION ALL SELECT 'orders', count(*), min(order_date), max(order_date) FROM fx_orders
UNION ALL SELECT 'web_traffic', count(*), min(date), max(date) FROM fx_web_traffic""")
def q_profile(spark, sf):
    s = S(spark, sf)
    parts = [(cm.sales_daily(spark, sf), "sales", "date"), (b.orders(s), "orders", "order_date"),
             (b.web_traffic(s), "web_traffic", "date")]
    out = None
    for df, name, d in parts:
        p = df.agg(F.count(F.lit(1)).alias("rows"), F.min(d).alias("min_date"), F.max(d).alias("max_date"))
        p = p.select(F.lit(name).alias("table"), "rows", "min_date", "max_date")
        out = p if out is None else out.unionByName(p)
    return out


FORECAST_SQL = f"""
SELECT strftime(date, '%Y-%m-%d') AS "Date", round(pred_revenue, 2) AS "Revenue", round(pred_cogs, 2) AS "COGS"
FROM ({qb._pred_sql('horizon', 'series_id', False)}) p"""


@register("forecast_export", extra_ctes=qb.BASE_CTES, sql=FORECAST_SQL)
def q_export(spark, sf):
    f = qb.baseline_forecast(spark, sf, round_to=None)
    path = scratch_path(spark, "submission")
    io.export_forecast(f, path, revenue="pred_revenue", cogs="pred_cogs", horizon=qb.HORIZON_DAYS)
    back = spark.read.option("header", True).csv(path)
    return back.select("Date", F.col("Revenue").cast("double"), F.col("COGS").cast("double"))


@register("export_contract", extra_ctes=qb.BASE_CTES + [("sub", FORECAST_SQL)], sql=f"""
SELECT 'row_count' AS "check", abs(count(*) - {qb.HORIZON_DAYS}) AS failures FROM sub
UNION ALL SELECT 'revenue_not_null', count(*) FILTER (WHERE "Revenue" IS NULL OR isnan("Revenue")) FROM sub
UNION ALL SELECT 'cogs_not_null', count(*) FILTER (WHERE "COGS" IS NULL OR isnan("COGS")) FROM sub
UNION ALL SELECT 'revenue_non_negative', count(*) FILTER (WHERE "Revenue" < 0) FROM sub
UNION ALL SELECT 'cogs_non_negative', count(*) FILTER (WHERE "COGS" < 0) FROM sub""")
def q_contract(spark, sf):
    f = qb.baseline_forecast(spark, sf, round_to=None)
    sub = io.export_forecast(f, None, revenue="pred_revenue", cogs="pred_cogs")
    return io.export_contract(sub, qb.HORIZON_DAYS)
