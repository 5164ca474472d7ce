"""Driver tables -> the shop's commerce views.

The shop's own tables (orders, order_items, products, returns, customers,
geography, payments, web_traffic, sales, shipments, inventory) are bound onto
the generated star-schema tables.  Every view is a lazy DataFrame over the
Parquet scans, so Catalyst prunes columns and pushes filters through them.
The mapping is documented in FIXTURES.md; the SQL twin of each view lives in
``vendora.plans.oracle`` and must stay equivalent.

Scale notes
* ``nation`` and ``region`` have a fixed size (25 and 5 rows by the TPC-H
  spec), so ``geography`` is broadcast.  Nothing else is hinted: ``customer``
  and ``part`` grow with the scale factor, so the planner decides from
  measured sizes (AQE converts to broadcast only when runtime stats allow).
* Per-product prices, brand stock levels and the sales series are
  pre-aggregated before any join, so hot products or brands only ever shuffle
  one partial row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the binding (see FIXTURES.md).
SHIFT_MONTHS = 252            # 1995-01-01 .. 2001-08-01  ->  2016-01-01 .. 2022-08-01
PROMO_DISCOUNT_ABOVE = 0.06   # a line carries a promo code when l_discount > 0.06
STACK_DISCOUNT_ABOVE = 0.08   # second (stacked) code: l_discount > 0.08 and l_tax > 0.04
STACK_TAX_ABOVE = 0.04
AGE_NULL_EVERY = 20           # age_group is NULL when c_custkey % 20 = 0
STATUS_MAP = {"F": "delivered", "O": "shipped", "P": "cancelled"}
SIZE_LABELS = ["S", "M", "L", "XL"]   # floor((p_size - 1) / 13) -> label
INSTALLMENTS = [1, 3, 6, 12]          # o_orderkey % 4 -> installments
LINES_PER_TASK = 1 << 18      # order lines that one task sorts and sums, whatever the session's partitions
MOST_TASKS = 1 << 16          # of one exchange; beyond it tasks take more lines


@dataclass
class Sources:
    """Lazy reader of the driver's Parquet tables under one folder."""

    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self._cache[name]


def money(col: str):
    """Money as exact decimal: inputs carry two decimals, so sums are exact and
    rounding a total never depends on summation order."""
    return F.col(col).cast("decimal(18,2)")


def rate(col: str):
    return F.col(col).cast("decimal(4,2)")


def line_revenue():
    return money("l_extendedprice") * (1 - rate("l_discount"))


def shifted_date(col: str):
    return F.add_months(F.col(col).cast("date"), SHIFT_MONTHS)


def _case(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def orders(src: Sources, status: str | None = None, dates: tuple | None = None) -> DataFrame:
    """Shop orders.  ``status`` filters on the raw status code, so the
    predicate reaches the Parquet scan (a filter on the mapped label would be
    a CASE expression that cannot be pushed down)."""
    o = src.table("orders")
    if status is not None:
        codes = [k for k, v in STATUS_MAP.items() if v == status]
        o = o.filter(F.col("o_orderstatus").isin(codes))
    if dates is not None:
        # a bound on the raw column, a few days wider than the shifted one (months differ in
        # length), so that it reaches the scan; the exact test on order_date comes after
        lo, hi = (F.add_months(F.lit(d).cast("date"), -SHIFT_MONTHS) for d in dates)
        o = o.filter((F.col("o_orderdate") >= F.date_sub(lo, 4).cast(o.schema["o_orderdate"].dataType))
                     & (F.col("o_orderdate") <= F.date_add(hi, 4).cast(o.schema["o_orderdate"].dataType)))
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        shifted_date("o_orderdate").alias("order_date"),
        _case(F.col("o_orderstatus"), STATUS_MAP).alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").alias("order_total"),
    )


def orders_with_zip(src: Sources, status: str | None = None) -> DataFrame:
    """Orders plus the customer's zip (an equi-join on the customer key)."""
    c = src.table("customer").select(F.col("c_custkey").alias("customer_id"),
                                     F.col("c_nationkey").alias("zip"))
    return orders(src, status).join(c, "customer_id")


def order_items(src: Sources) -> DataFrame:
    li = src.table("lineitem")
    disc_code = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    tax_code = F.round(F.col("l_tax") * 100).cast("int").cast("string")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.when(F.col("l_discount") > PROMO_DISCOUNT_ABOVE, F.concat(F.lit("PROMO"), disc_code))
         .alias("promo_id"),
        F.when((F.col("l_discount") > STACK_DISCOUNT_ABOVE) & (F.col("l_tax") > STACK_TAX_ABOVE),
               F.concat(F.lit("STACK"), tax_code)).alias("promo_id_2"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("extended_price"),
    )


def size_label(p_size):
    idx = F.floor((p_size - 1) / 13).cast("int")
    return _case(idx, dict(enumerate(SIZE_LABELS)))


def products(src: Sources) -> DataFrame:
    """Products with the mean selling price per part (pre-aggregated, then joined)."""
    li = src.table("lineitem")
    price = (li.groupBy(F.col("l_partkey").alias("product_id"))
               .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")))
    p = src.table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_retailprice").alias("cogs"),
        F.col("p_brand").alias("segment"),
        F.col("p_type").alias("category"),
        size_label(F.col("p_size")).alias("size"),
    )
    return p.join(price, "product_id", "left")


def product_dims(src: Sources) -> DataFrame:
    """Product attributes without the price aggregate (cheaper when price is unused)."""
    return src.table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_retailprice").alias("cogs"),
        F.col("p_brand").alias("segment"),
        F.col("p_type").alias("category"),
        size_label(F.col("p_size")).alias("size"),
    )


def returns(src: Sources) -> DataFrame:
    li = src.table("lineitem").filter(F.col("l_returnflag") == "R")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("return_reason"),
        line_revenue().alias("refund_amount"),
        shifted_date("l_shipdate").alias("return_date"),
    )


def customers(src: Sources) -> DataFrame:
    c = src.table("customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_custkey") % AGE_NULL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("age_group"),
        F.col("c_mktsegment").alias("acquisition_channel"),
        F.col("c_nationkey").alias("zip"),
    )


def geography(src: Sources) -> DataFrame:
    """zip -> region; 25 rows by the spec of nation, so safe to broadcast."""
    n = src.table("nation")
    r = src.table("region")
    g = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return F.broadcast(g.select(F.col("n_nationkey").alias("zip"), F.col("r_name").alias("region")))


def payments(src: Sources) -> DataFrame:
    o = src.table("orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        _case(F.col("o_orderkey") % 4, dict(enumerate(INSTALLMENTS))).alias("installments"),
        F.col("o_totalprice").alias("payment_value"),
    )


def web_traffic(src: Sources) -> DataFrame:
    e = src.table("events")
    return e.select(
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("traffic_source"),
        (F.col("value") / 100).alias("bounce_rate"),
        F.col("user_id"),
    )


def line_tasks(src: Sources) -> int:
    """Number of tasks that share the order lines (counted from the file footers)."""
    return min(max(1, -(-src.table("lineitem").count() // LINES_PER_TASK)), MOST_TASKS)


def sales_panel(src: Sources) -> DataFrame:
    """Daily (region | category) series: (series_id, date, revenue, cogs) in exact decimals.

    Lines are summed per (day, region, product) after the orders join, so the product
    join sees one row for each of them, however many lines a hot product has.  Both
    exchanges of lines have as many partitions as the number of lines asks for: a task's
    sort and hash maps stay the same size when the tables grow."""
    n = line_tasks(src)
    li = src.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", line_revenue().alias("line_revenue"))
    o = src.table("orders").select("o_orderkey", "o_custkey", shifted_date("o_orderdate").alias("date"))
    c = src.table("customer").select("c_custkey", "c_nationkey")
    o = o.join(c, o.o_custkey == c.c_custkey).join(geography(src), F.col("c_nationkey") == F.col("zip")).select("o_orderkey", "date", "region")
    li, o = li.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select("date", "region", "l_partkey", "line_revenue", "l_quantity")
    per = (lines.repartition(n, "date", "region", "l_partkey").groupBy("date", "region", "l_partkey")
             .agg(F.sum("line_revenue").alias("revenue"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("units")))
    p = src.table("part").select("p_partkey", "p_retailprice", "p_type")
    x = per.join(p, per.l_partkey == p.p_partkey)
    return (x.groupBy(F.concat_ws("|", F.col("region"), F.col("p_type")).alias("series_id"), "date")
             .agg(F.sum("revenue").cast("decimal(28,4)").alias("revenue"),
                  F.sum(F.col("units").cast("decimal(18,2)") * money("p_retailprice")).cast("decimal(28,4)").alias("cogs")))


def sales(panel: DataFrame) -> DataFrame:
    """Daily company totals of the panel: (date, revenue, cogs), one row per day with orders."""
    return rounded(panel.groupBy("date").agg(F.sum("revenue").alias("revenue"), F.sum("cogs").alias("cogs")))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2).cast("double") for c in ("revenue", "cogs")})


def shipments(src: Sources) -> DataFrame:
    """One shipping leg per line: order date -> ship date (the driver's dates give negative
    leads too; ``lead_time`` leaves them out and counts them)."""
    li = src.table("lineitem").select("l_orderkey", "l_linenumber", shifted_date("l_shipdate").alias("ship_date"))
    o = orders_with_zip(src).select("order_id", "order_date", "zip")
    x = li.join(o, li.l_orderkey == o.order_id)
    return x.select("order_id", F.col("l_linenumber").alias("line_number"), "zip", "order_date", "ship_date")


def inventory_items(src: Sources) -> DataFrame:
    """Units sold per (product, day), with the month and the product's brand."""
    li = src.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = src.table("orders").select("o_orderkey", shifted_date("o_orderdate").alias("day"))
    p = src.table("part").select("p_partkey", F.col("p_brand").alias("brand"))
    per = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("day", "l_partkey").agg(F.sum("l_quantity").alias("units"))
    return per.join(p, per.l_partkey == p.p_partkey).select(F.col("l_partkey").alias("product_id"), "brand", "day",
                                                            F.trunc("day", "month").alias("month"), "units")


def inventory_daily(items: DataFrame) -> DataFrame:
    """Units sold per (brand, day), with the month, from those per product."""
    return items.groupBy("brand", "day", "month").agg(F.sum("units").alias("units"))


def mean_received(daily: DataFrame, item: str = "brand") -> DataFrame:
    """Stock received per month = the item's mean monthly units sold."""
    monthly = daily.groupBy(item, "month").agg(F.sum("units").alias("sold"))
    return monthly.groupBy(item).agg(F.avg("sold").alias("received"))


def inventory(daily: DataFrame) -> DataFrame:
    """Monthly stock snapshots per brand, derived from the units sold per brand and day.

    received = the brand's mean monthly units; sold = units in the month;
    stockout_days = days from the day the running sum reached ``received`` to
    the month end (0 when never reached).  The running sum is a window over
    (brand, month) groups holding at most 31 daily rows each: rows are
    pre-aggregated to (brand, day) first, so a hot brand never piles raw lines
    into one task.
    """
    monthly = daily.groupBy("brand", "month").agg(F.sum("units").alias("sold"))
    received = mean_received(daily)
    w = Window.partitionBy("brand", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    reached = (daily.join(received, "brand")
                    .withColumn("running", F.sum("units").over(w))
                    .filter(F.col("running") >= F.col("received"))
                    .groupBy("brand", "month").agg(F.min("day").alias("stockout_start")))
    m = (monthly.join(received, "brand").join(reached, ["brand", "month"], "left"))
    return m.select(
        "brand", "month", "received", "sold",
        F.least(F.lit(1.0), F.col("sold") / F.col("received")).alias("sell_through"),
        (F.col("sold") >= F.col("received")).cast("int").alias("stockout_flag"),
        F.coalesce(F.datediff(F.last_day("month"), F.col("stockout_start")), F.lit(0)).alias("stockout_days"),
        F.least(F.col("sold"), F.col("received")).alias("filled"),
    )
