"""Keys about how tables are kept: co-located buckets, a panel by deltas, file statistics, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendora.operators.panel_store import PanelStore
from vendora.plans import common as cm
from vendora.plans.registry import register, sql_flag
from vendora.session import scratch_path
from vendora.sources import bindings as b
from vendora.sources import bucketed as bk
from vendora.sources import file_stats as fs
from vendora.sources import quarantine as qt

# ------------------------------------------------------------ buckets


def by_order(spark, sf):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = (spark.sparkContext.applicationId, sf, n)
    if key not in _BUCKETED:
        _BUCKETED[key] = bk.bucketed_orders(spark, sf, n)
    return _BUCKETED[key]


_BUCKETED: dict = {}


@register("bucketed_region_revenue", rounding={"revenue": 2}, sql=f"""
SELECT region, revenue, {sql_flag('revenue', 'region')}
FROM (SELECT g.region, sum(CAST(i.extended_price AS DECIMAL(18,2)))::DOUBLE AS revenue
      FROM fx_geography g JOIN fx_orders_zip o ON g.zip = o.zip JOIN fx_order_items i ON o.order_id = i.order_id
      WHERE o.order_status = 'delivered' GROUP BY g.region) a""")
def q_region(spark, sf):
    """Revenue by region off the co-located tables."""
    return bk.region_revenue(*by_order(spark, sf), b.geography(b.Sources(spark, sf)))


@register("bucketed_channel_mix", rounding={"revenue": 2, "share": 9}, sql="""
SELECT *, revenue / sum(revenue) OVER (PARTITION BY year) AS share
FROM (SELECT CAST(year(o.order_date) AS INTEGER) AS year, o.payment_method AS channel, sum(CAST(i.extended_price AS DECIMAL(18,2)))::DOUBLE AS revenue
      FROM fx_order_items i JOIN fx_orders_zip o USING (order_id) GROUP BY 1, 2) a""")
def q_channel(spark, sf):
    """Channel shares by year off the co-located tables."""
    return bk.channel_mix(*by_order(spark, sf))


# ------------------------------------------------------------ a panel by deltas

CUT = "2021-01-01"           # days from here on come in the second batch


def sales_lines(spark, sf):
    """Lines as panel rows, with the mark of those that came back."""
    s = b.Sources(spark, sf)
    li = s.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", b.line_revenue().alias("revenue"))
    o = s.table("orders").select("o_orderkey", "o_custkey", b.shifted_date("o_orderdate").alias("date"))
    c = s.table("customer").select("c_custkey", "c_nationkey")
    p = s.table("part").select("p_partkey", "p_type", b.money("p_retailprice").alias("price"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(b.geography(s), F.col("c_nationkey") == F.col("zip"))
    j = j.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.concat_ws("|", "region", "p_type").alias("series_id"), "date", "revenue", (F.col("l_quantity").cast("decimal(18,2)") * F.col("price")).alias("cogs"),
                    (F.col("l_returnflag") == "R").alias("returned"))


def corrected_store(spark, sf) -> PanelStore:
    """Two loads, a late correction that takes the returned lines out, a fold in between, and every batch sent again."""
    lines = sales_lines(spark, sf).select("series_id", "date", "revenue", "cogs", "returned")
    store = PanelStore(spark, scratch_path(spark, "sales-panel"), ["series_id"], ["revenue", "cogs"])
    early, late = lines.filter(F.col("date") < CUT), lines.filter(F.col("date") >= CUT)
    store.commit(1, early)
    store.commit(2, late)
    store.fold(1)
    store.commit(1, early)
    store.commit(3, removed=lines.filter("returned"))
    store.commit(2, late)
    store.fold(3)
    store.commit(3, removed=lines.filter("returned"))
    return store


@register("delta_panel", rounding={"revenue": 4, "cogs": 4}, extra_ctes=[], sql="""
SELECT g.region || '|' || p.p_type AS series_id, CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 252 MONTH AS DATE) AS date, count(*) AS n,
       sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS revenue,
       sum(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2))) AS cogs
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN fx_geography g ON c.c_nationkey = g.zip
WHERE l.l_returnflag <> 'R' GROUP BY 1, 2""")
def q_delta(spark, sf):
    """The panel without returned lines, kept by deltas; SQL rescans."""
    return corrected_store(spark, sf).panel()


# ------------------------------------------------------------ file statistics

PROFILED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@register("file_profile", sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST(min({c}) AS DATE) AS min_date, CAST(max({c}) AS DATE) AS max_date FROM {t}" for t, c in PROFILED.items()))
def q_profile(spark, sf):
    """Rows and date ranges of the raw tables out of the footers."""
    return fs.profile(fs.stats_session(spark), {t: (f"{sf}/{t}.parquet", c) for t, c in PROFILED.items()})


# ------------------------------------------------------------ quarantine

HEADER = " Date ,REVENUE,Cogs "


def noisy_sales(spark, sf) -> str:
    """The sales file with the faults that such files have, by the day of the month."""
    s = cm.sales_daily(spark, sf)
    day = F.dayofmonth("date")
    d, r, c = F.date_format("date", "yyyy-MM-dd"), F.col("revenue").cast("decimal(18,2)").cast("string"), F.col("cogs").cast("decimal(18,2)").cast("string")
    line = (F.when(day == 3, F.concat_ws(",", d, F.lit("n/a"), c)).when(day == 5, F.concat_ws(",", F.lit("2019-13-45"), r, c))
            .when(day == 7, F.concat_ws(",", d, r)).when(day == 9, F.concat_ws(",", d, r, c, F.lit("extra")))
            .when(day == 11, F.concat_ws(",", d, F.concat(F.lit("-"), r), F.lit(""))).otherwise(F.concat_ws(",", d, r, c)))
    path = scratch_path(spark, "noisy-sales")
    # each file has its header, as exports do
    rows = s.select(line.alias("value")).repartition(3)
    rows.mapInPandas(_with_header, "value string").write.text(path)
    return path


def _with_header(batches):
    import pandas as pd
    yield pd.DataFrame({"value": [HEADER]})
    yield from batches


@register("quarantine_account", sql="""
SELECT CASE day(date) WHEN 3 THEN 'bad_revenue' WHEN 5 THEN 'bad_date' WHEN 7 THEN 'malformed' WHEN 9 THEN 'malformed' WHEN 11 THEN 'range_revenue' ELSE 'loaded' END AS reason, count(*) AS n
FROM fx_sales GROUP BY 1
UNION ALL SELECT 'missing_cogs', count(*) FROM fx_sales WHERE day(date) = 11
UNION ALL SELECT 'rejected', count(*) FROM fx_sales WHERE day(date) IN (3, 5, 7, 9, 11)""")
def q_account(spark, sf):
    """What became of each line of a file with faults."""
    return qt.account(qt.read_checked(spark, noisy_sales(spark, sf), qt.SALES))


@register("quarantine_load", rounding={"revenue": 2, "cogs": 2}, sql="SELECT date, revenue, cogs FROM fx_sales WHERE day(date) NOT IN (3, 5, 7, 9, 11)")
def q_load(spark, sf):
    """The good lines of that file; the others are written beside them."""
    return qt.load_with_quarantine(spark, noisy_sales(spark, sf), qt.SALES, scratch_path(spark, "rejects"))
