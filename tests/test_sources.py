"""CSV loaders: header noise and bad values."""

import os
import tempfile

from vendora.sources import csv_io as io


def test_sales_header_noise_and_coercion(spark):
    d = tempfile.mkdtemp(prefix="vendora-test-")
    p = os.path.join(d, "sales.csv")
    with open(p, "w") as f:
        f.write(" Date ,REVENUE,Cogs \n2020-01-01,100.5,abc\n2020-01-02,,1e3\nbad,5,5\n")
    rows = sorted(io.load_sales(spark, p).collect(), key=lambda r: (r.date is None, r.date))
    assert [tuple(r) for r in rows][:2] == [(__import__("datetime").date(2020, 1, 1), 100.5, 0.0),
                                            (__import__("datetime").date(2020, 1, 2), 0.0, 1000.0)]
    assert rows[2].date is None and rows[2].revenue == 5.0


def test_typed_scan_keeps_empty_codes_null(spark):
    d = tempfile.mkdtemp(prefix="vendora-test-")
    p = os.path.join(d, "items.csv")
    with open(p, "w") as f:
        f.write("order_id,product_id,line_number,quantity,unit_price,promo_id,promo_id_2\n"
                "1,2,1,3,9.5,,\n1,3,2,1,4.0,PROMO7,STACK5\n")
    rows = io.read_typed(spark, p, io.ORDER_ITEMS_SCHEMA).orderBy("line_number").collect()
    assert rows[0].promo_id is None and rows[0].promo_id_2 is None
    assert rows[1].promo_id == "PROMO7"


def test_export_contract_flags_failures(spark):
    df = spark.createDataFrame([("2023-01-01", 1.0, -2.0), ("2023-01-02", float("nan"), 3.0)],
                               "date string, revenue double, cogs double")
    sub = io.export_forecast(df.selectExpr("to_date(date) AS date", "revenue", "cogs"))
    got = {r.check: r.failures for r in io.export_contract(sub, 3).collect()}
    assert got == {"row_count": 1, "revenue_not_null": 1, "cogs_not_null": 0,
                   "revenue_non_negative": 0, "cogs_non_negative": 1}


def test_sales_keep_fractions_of_a_cent_and_large_values(spark):
    d = tempfile.mkdtemp(prefix="vendora-test-")
    p = os.path.join(d, "sales.csv")
    with open(p, "w") as f:
        f.write("date,revenue,cogs\n2020-01-01,100.567,1e17\n")
    assert tuple(io.load_sales(spark, p).first())[1:] == (100.567, 1e17)


def test_export_raises_and_writes_nothing_on_a_broken_contract(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="vendora-test-")
    df = spark.createDataFrame([("2023-01-01", -1.0, 2.0)], "date string, revenue double, cogs double").selectExpr("to_date(date) AS date", "revenue", "cogs")
    with pytest.raises(AssertionError, match="revenue_non_negative"):
        io.export_forecast(df, os.path.join(d, "out"), horizon=1)
    assert not os.path.exists(os.path.join(d, "out"))
