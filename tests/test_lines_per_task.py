"""The exchanges of order lines are as wide as the lines ask for, whatever the session's partitions."""

import datetime as dt
import decimal

from vendora.sources import bindings as b

D = decimal.Decimal


def test_sales_panel_task_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(b, "LINES_PER_TASK", 50, raising=False)
    money, rate = "decimal(18,2)", "decimal(4,2)"

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string")
    put("nation", [(k, "N", k % 2) for k in range(4)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(k, k % 4) for k in range(10)] + [(3, 3)], "c_custkey long, c_nationkey int")
    put("part", [(k, D(k + 1), "AB"[k % 2]) for k in range(5)] + [(None, D(9), "A")], f"p_partkey long, p_retailprice {money}, p_type string")
    orders = [(k, k % 10, dt.date(1995, 1, 1 + k % 20)) for k in range(200)] + [(None, 1, dt.date(1995, 1, 1)), (7, 2, dt.date(1995, 1, 3))]
    put("orders", orders, "o_orderkey long, o_custkey long, o_orderdate date")
    # product 0 has most of the lines
    lines = [(None if k % 97 == 0 else k % 200, 0 if k % 4 else k % 5, D(k % 7), D(k), D("0.05")) for k in range(1000)]
    put("lineitem", lines, f"l_orderkey long, l_partkey long, l_quantity {money}, l_extendedprice {money}, l_discount {rate}")
    want = {}
    for ok, pk, q, price, disc in lines:
        for o, c, day in orders:
            if ok is None or o != ok:
                continue
            for zip_ in [c % 4] * (2 if c == 3 else 1):
                key = (f"{['ASIA', 'EUROPE'][zip_ % 2]}|{'AB'[pk % 2]}", dt.date(day.year + 21, day.month, day.day))
                r, g = want.get(key, (0, 0))
                want[key] = r + price * (1 - disc), g + q * (pk + 1)
    got = b.sales_panel(b.Sources(spark, str(tmp_path)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {(r.series_id, r.date): (r.revenue, r.cogs) for r in got.collect()} == want
    # 1000 lines, 50 a task: both sides of the orders join, and the sums by day, region and product
    assert plan.count(", 20), REPARTITION_BY_NUM") >= 3
