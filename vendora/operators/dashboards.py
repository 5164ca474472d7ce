"""Business dashboards (descriptive / diagnostic) over the commerce views.

The reference only reports these figures; the definitions are pinned in
SURVEY §2.10.  Every function takes commerce DataFrames and returns a small
tidy table.  Windows are keyed (per series, per year, per brand-month); the
two rankings over all customers / products use ``global_prefix`` instead of
an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.operators.relational import (exact_quantile_from_counts, global_prefix, line_value, materialize,
                                            ntile_from_rank)

# Fixed values of the pinned definitions
MARGIN_WINDOW_MONTHS = 3
RFM_BUCKETS = 5
SELL_THROUGH_STEP = 0.2
REORDER_THRESHOLD = 0.45
ABC_A, ABC_B = 0.80, 0.95
TOP_RETURN_K, TOP_RETURN_MIN_LINES = 10, 25
SIZES = ["S", "M", "L", "XL"]


def revenue_yoy(daily: DataFrame) -> DataFrame:
    a = daily.groupBy(F.year("date").alias("year")).agg(F.sum("revenue").alias("revenue"),
                                                         F.sum("cogs").alias("cogs"))
    w = Window.orderBy("year")   # one row per year
    return a.withColumn("yoy", F.try_divide(F.col("revenue"), F.lag("revenue").over(w)) - 1)


def revenue_cagr(daily: DataFrame) -> DataFrame:
    span = daily.agg(F.min("date").alias("s"), F.max("date").alias("e"))
    s, e = span.select("s").scalar(), span.select("e").scalar()
    a = daily.groupBy(F.year("date").alias("year")).agg(F.sum("revenue").alias("revenue"))
    full = a.filter((F.make_date("year", F.lit(1), F.lit(1)) >= s) & (F.make_date("year", F.lit(12), F.lit(31)) <= e))
    g = full.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                 F.count(F.lit(1)).alias("n_years"),
                 F.min_by("revenue", "year").alias("_first"), F.max_by("revenue", "year").alias("_last"))
    cagr = F.pow(F.try_divide(F.col("_last"), F.col("_first")), 1.0 / (F.col("n_years") - 1)) - 1
    return g.select("first_year", "last_year", "n_years", cagr.alias("cagr"))


def margin_trend(panel: DataFrame) -> DataFrame:
    m = panel.groupBy("series_id", F.trunc("date", "month").alias("month")).agg(
        F.sum("revenue").alias("revenue"), F.sum("cogs").alias("cogs"))
    m = m.withColumn("margin", F.try_divide(F.col("revenue") - F.col("cogs"), F.col("revenue")))
    w = Window.partitionBy("series_id").orderBy("month").rowsBetween(-(MARGIN_WINDOW_MONTHS - 1), 0)
    return m.withColumn("margin_3m", F.avg("margin").over(w))


def category_mix(items: DataFrame, dims: DataFrame) -> DataFrame:
    """Lines are summed per product before the join (unit cost is a product
    attribute, so cost = units x unit cost), so the join sees one row per
    product and a hot product is collapsed map-side."""
    per = items.groupBy("product_id").agg(F.sum(line_value(items)).alias("rev"),
                                          F.sum("quantity").alias("units"))
    j = per.join(dims.select("product_id", "category", F.col("cogs").alias("unit_cogs")), "product_id")
    a = j.groupBy("category").agg(F.sum("rev").alias("revenue"),
                                  F.sum(F.col("units").cast("decimal(18,0)") * F.col("unit_cogs").cast("decimal(18,2)")).alias("cost"))
    a = a.select("category", F.col("revenue").cast("double").alias("revenue"), F.col("cost").cast("double").alias("cost"))
    w = Window.partitionBy()   # one row per category
    return a.select("category", "revenue", (F.col("revenue") / F.sum("revenue").over(w)).alias("share"),
                    F.try_divide(F.col("revenue") - F.col("cost"), F.col("revenue")).alias("margin"))


def seasonality(daily: DataFrame, orders: DataFrame) -> DataFrame:
    rev = daily.groupBy(F.year("date").alias("year"), F.month("date").alias("month_no")).agg(
        F.sum("revenue").alias("revenue"))
    cnt = orders.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month_no")).agg(
        F.count(F.lit(1)).alias("orders"))
    j = rev.join(cnt, ["year", "month_no"], "full_outer")
    return j.groupBy("month_no").agg(F.avg("revenue").alias("avg_revenue"), F.avg("orders").alias("avg_orders"))


def rfm_scores(orders: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """(customer_id, R, F, M, monetary): quintiles of recency, frequency and money over purchasing
    customers (delivered orders), ties by id.  Money is summed as exact decimals.
    ``delivered`` may pass the delivered orders pre-filtered at the scan."""
    as_of = orders.agg(F.max("order_date").alias("d")).select("d").scalar()
    d = delivered if delivered is not None else orders.filter(F.col("order_status") == "delivered")
    per = d.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max("order_date").alias("last"), F.count(F.lit(1)).alias("freq"),
        F.sum(F.col("order_total").cast("decimal(18,2)")).alias("monetary"))
    # the per-customer table feeds two rankings and the count: materialize it once
    per = materialize(per.withColumn("_neg_recency", -F.datediff(F.lit(as_of), F.col("last"))))
    n = per.count()
    # independent rankings of the same per-customer table, joined by key
    def score(order_col: str, name: str) -> DataFrame:
        r = global_prefix(per.select("customer_id", order_col), [order_col, "customer_id"], rank_out="_r")
        return r.select("customer_id", ntile_from_rank(F.col("_r"), F.lit(n), RFM_BUCKETS).alias(name))
    money = global_prefix(per.select("customer_id", "monetary"), ["monetary", "customer_id"], rank_out="_r")
    money = money.select("customer_id", "monetary", ntile_from_rank(F.col("_r"), F.lit(n), RFM_BUCKETS).alias("M"))
    scores = score("_neg_recency", "R").join(score("freq", "F"), "customer_id").join(money, "customer_id")
    return scores.select("customer_id", "R", "F", "M", "monetary")


def rfm_segments(customers: DataFrame, orders: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """Customers, mean monetary quintile, customers of the highest one and money of each segment."""
    c = customers.select("customer_id").join(rfm_scores(orders, delivered), "customer_id", "left")
    seg = (F.when(F.col("R").isNull(), "Never Purchased")
            .when((F.col("R") >= 4) & (F.col("F") >= 4), "Champions")
            .when((F.col("R") <= 2) & (F.col("F") >= 3), "At Risk")
            .when((F.col("R") <= 2) & (F.col("F") <= 2), "Lost")
            .otherwise("Active"))
    return c.groupBy(seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg("M").alias("avg_m"), F.count(F.when(F.col("M") == RFM_BUCKETS, 1)).alias("n_top_m"),
        F.sum("monetary").cast("double").alias("monetary"))


def cohort_retention(orders: DataFrame) -> DataFrame:
    """One pass over the orders: a customer has at most one row per calendar month before
    the window; a cohort's size is its count at offset 0."""
    act = (orders.filter(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
                 .select("customer_id", F.trunc("order_date", "month").alias("month")).distinct())
    j = act.withColumn("cohort", F.min("month").over(Window.partitionBy("customer_id")))
    j = j.withColumn("month_offset", F.months_between("month", "cohort").cast("int"))
    a = j.groupBy("cohort", "month_offset").agg(F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return a.withColumn("cohort_size", size).withColumn("rate", F.col("customers") / F.col("cohort_size"))


def one_and_done(orders: DataFrame) -> DataFrame:
    per = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_customers"),
                   F.count(F.when(F.col("n") == 1, 1)).alias("n_one_order"),
                   (F.count(F.when(F.col("n") == 1, 1)) / F.count(F.lit(1))).alias("share"))


def promo_order_share(items: DataFrame) -> DataFrame:
    per = items.groupBy("order_id").agg(F.max(F.col("promo_id").isNotNull().cast("int")).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("n_orders"), F.sum("p").alias("n_promo_orders"),
                   F.avg("p").alias("share"))


def promo_aov(items: DataFrame, dims: DataFrame) -> DataFrame:
    # a line's value and flag before the join, so that no other column is shuffled
    lines = items.select("order_id", "product_id", line_value(items).alias("value"), F.col("promo_id").isNotNull().cast("int").alias("promo"))
    j = lines.join(dims.select("product_id", "category"), "product_id")
    per = j.groupBy("order_id", "category").agg(F.sum("value").alias("value"), F.max("promo").alias("promo"))
    a = per.groupBy("category", "promo").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_orders"))
    return a.select("category", "promo", (F.col("value").cast("double") / F.col("n_orders")).alias("aov"), "n_orders")


def promo_vs_full_price(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines are summed per (order, promo flag) first: at most two rows per
    order reach the join with orders."""
    per = items.groupBy("order_id", F.col("promo_id").isNotNull().cast("int").alias("promo")).agg(
        F.sum(line_value(items)).alias("rev"))
    j = per.join(orders.select("order_id", "order_date"), "order_id")
    x = j.select(F.month("order_date").alias("month_no"), "promo", "rev")
    p = x.groupBy("month_no").pivot("promo", [1, 0]).agg(F.sum("rev"))
    return p.select("month_no", F.col("1").cast("double").alias("promo_rev"), F.col("0").cast("double").alias("full_rev"))


def channel_mix(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines are summed per order before the join with orders."""
    per = items.groupBy("order_id").agg(F.sum(line_value(items)).alias("v"))
    j = per.join(orders.select("order_id", "order_date", "payment_method"), "order_id")
    a = j.groupBy(F.year("order_date").alias("year"), F.col("payment_method").alias("channel")).agg(
        F.sum("v").cast("double").alias("revenue"))
    return a.withColumn("share", F.col("revenue") / F.sum("revenue").over(Window.partitionBy("year")))


def channel_ltv(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    per_order = items.groupBy("order_id").agg(F.sum(line_value(items)).alias("v"))
    per_cust = (orders.filter(F.col("customer_id").isNotNull()).select("order_id", "customer_id").join(per_order, "order_id")
                      .groupBy("customer_id").agg(F.sum("v").alias("ltv")))
    c = customers.select("customer_id", F.col("acquisition_channel").alias("channel")).join(
        per_cust, "customer_id", "left")
    a = c.groupBy("channel").agg(F.count(F.lit(1)).alias("n_customers"), F.sum("ltv").alias("ltv"))
    return a.select("channel", "n_customers", (F.coalesce(F.col("ltv").cast("double"), F.lit(0.0)) / F.col("n_customers")).alias("avg_ltv"))


def traffic_trend(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("date", "traffic_source").agg(F.count(F.lit(1)).alias("visits"),
                                                         F.avg("bounce_rate").alias("avg_bounce_rate"))


LEGS = {"order_to_ship": ("order_date", "ship_date"), "ship_to_delivery": ("ship_date", "delivery_date"),
        "total": ("order_date", "delivery_date")}


def lead_time(shipments: DataFrame, geography: DataFrame, legs: dict | None = None) -> DataFrame:
    """Exact median / p90 of each leg's days per region, from (region, leg, days) counts:
    days are whole and in a bounded range, so no group holds raw rows.

    ``legs``: name -> (start column, end column); by default those of ``LEGS`` whose
    columns the table has.  A missing or negative span is no lead time: it is left out
    of the figures and counted in ``n_excluded``."""
    legs = legs or {k: v for k, v in LEGS.items() if set(v) <= set(shipments.columns)}
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("leg"), F.datediff(b, a).alias("days")) for k, (a, b) in legs.items()]))
    x = shipments.select("zip", spans.alias("s")).select("zip", "s.leg", "s.days")
    per = x.groupBy("zip", "leg", "days").agg(F.count(F.lit(1)).alias("w"))       # before the join with the regions
    hist = materialize(per.join(geography, "zip").groupBy("region", "leg", "days").agg(F.sum("w").alias("w")))
    out = hist.filter(F.col("days").isNull() | (F.col("days") < 0)).groupBy("region", "leg").agg(F.sum("w").alias("n_excluded"))
    hist, key = hist.filter("days >= 0"), ["region", "leg"]
    base = hist.groupBy(*key).agg(F.sum("w").alias("n"), (F.sum(F.col("days") * F.col("w")) / F.sum("w")).alias("avg_days"))
    p50 = exact_quantile_from_counts(hist, "days", "w", 0.5, key, "p50_days")
    p90 = exact_quantile_from_counts(hist, "days", "w", 0.9, key, "p90_days")
    return base.join(p50, key).join(p90, key).join(out, key, "full_outer").fillna(0, ["n", "n_excluded"])


def stockout_rate(inv: DataFrame) -> DataFrame:
    """Both rates from one pass: per month first, then all months and the last one."""
    per = inv.groupBy("month").agg(F.sum("stockout_flag").alias("s"), F.count("stockout_flag").alias("n"))
    a = per.agg((F.sum("s") / F.sum("n")).alias("overall"), F.max_by(F.col("s") / F.col("n"), "month").alias("latest"))
    return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("scope"), F.col(k).alias("rate")) for k in ("overall", "latest")])))


def sellthrough_vs_stockout(inv: DataFrame) -> DataFrame:
    c = inv.agg(F.corr("sell_through", "stockout_days").alias("c")).select("c").scalar()
    bucket = F.least(F.floor(F.col("sell_through") / SELL_THROUGH_STEP), F.lit(4)).cast("int")
    return inv.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("stockout_days").alias("avg_stockout_days")).withColumn("corr", c)


def fill_rate(inv: DataFrame) -> DataFrame:
    return inv.groupBy("month").agg(F.try_divide(F.sum("filled"), F.sum("sold")).alias("fill_rate"))


def _counts_by(items: DataFrame, returns: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    d = dims.select("product_id", *keys)
    lines = (items.groupBy("product_id").agg(F.count(F.lit(1)).alias("c")).join(d, "product_id")
                  .groupBy(*keys).agg(F.sum("c").alias("n_lines")))
    rets = (returns.groupBy("product_id").agg(F.count(F.lit(1)).alias("c")).join(d, "product_id")
                   .groupBy(*keys).agg(F.sum("c").alias("n_returns")))
    j = lines.join(rets, keys, "full_outer")
    return j.withColumn("rate", F.try_divide(F.col("n_returns").cast("double"), F.col("n_lines").cast("double")))


def return_hotspot(items: DataFrame, returns: DataFrame, dims: DataFrame) -> DataFrame:
    r = _counts_by(items, returns, dims, ["category", "size"])
    return r.groupBy("category").pivot("size", SIZES).agg(F.first("rate"))


def top_return_products(items: DataFrame, returns: DataFrame, k=TOP_RETURN_K, min_lines=TOP_RETURN_MIN_LINES):
    lines = items.filter(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.count(F.lit(1)).alias("n_lines"))
    rets = returns.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_returns"))
    j = lines.filter(F.col("n_lines") >= min_lines).join(rets, "product_id", "left").fillna(0, ["n_returns"])
    j = j.withColumn("rate", F.col("n_returns") / F.col("n_lines"))
    return j.orderBy(F.col("rate").desc(), F.col("product_id").asc()).limit(k)


def refund_total(returns: DataFrame) -> DataFrame:
    return returns.groupBy(F.year("return_date").alias("year")).agg(
        F.round(F.sum("refund_amount"), 2).cast("double").alias("refund"))


def region_orders(orders: DataFrame, customers: DataFrame, geography: DataFrame) -> DataFrame:
    """Orders (one row each) are counted per customer before the joins."""
    per = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count("order_id").alias("n"))
    zips = per.join(customers.select("customer_id", "zip"), "customer_id").groupBy("zip").agg(F.sum("n").alias("n"))
    return zips.join(geography, "zip").groupBy("region").agg(F.sum("n").alias("n_orders"))


def abc_class(items: DataFrame) -> DataFrame:
    """Products by revenue share, largest first: running share <= 80% -> A,
    <= 95% -> B, else C.  Money is exact decimal, so the running sum is exact."""
    rev = materialize(items.groupBy("product_id").agg(
        F.sum(F.col("extended_price").cast("decimal(18,2)")).alias("revenue")))
    total = rev.agg(F.sum("revenue").alias("t")).select("t").scalar()
    r = global_prefix(rev.withColumn("_neg", -F.col("revenue")), ["_neg", "product_id"], "revenue",
                      rank_out="rank", cum_out="cum")
    share = F.col("cum").cast("double") / total.cast("double")
    cls = F.when(share <= ABC_A, "A").when(share <= ABC_B, "B").otherwise("C")
    return r.select("product_id", F.col("revenue").cast("double").alias("revenue"), "rank",
                    share.alias("cum_share"), cls.alias("abc_class"))


def reorder_trigger(daily_units: DataFrame, received: DataFrame, item: str = "product_id", threshold=REORDER_THRESHOLD) -> DataFrame:
    """First day in each (item, month) when running units / received >= threshold.
    The window runs over at most 31 pre-aggregated daily rows per group."""
    w = Window.partitionBy(item, "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    x = daily_units.join(received, item).withColumn("running", F.sum("units").over(w))
    hit = x.filter(F.col("running") / F.col("received") >= threshold)
    return hit.groupBy(item, "month").agg(F.min("day").alias("trigger_date"))
