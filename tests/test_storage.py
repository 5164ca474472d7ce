"""Bucketed tables, the delta-maintained panel, file statistics and quarantine."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vendora.operators.panel_store import BATCH, PanelStore
from vendora.session import scratch_path
from vendora.sources import bindings as b
from vendora.sources import bucketed as bk
from vendora.sources import file_stats as fs
from vendora.sources import quarantine as qt


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- buckets ----------------------------------------------------------------------------------------

def test_no_exchange_above_the_scans(spark):
    orders, items = bk.bucketed_orders(spark, SF_SMALL, 4)
    for df in (bk.order_values(orders, items), items.groupBy("order_id").agg(F.sum("value")), orders.hint("merge").join(items, "order_id")):
        df.collect()
        assert "Exchange" not in plan_of(df) and "Scan parquet" in plan_of(df)
    s = b.Sources(spark, SF_SMALL)
    assert "Exchange" in plan_of(bk.order_values(b.orders_with_zip(s), b.order_items(s).withColumn("value", F.lit(1))))
    got = {(r.order_id, r.value) for r in bk.order_values(orders, items).select("order_id", "value").collect()}
    from vendora.operators.relational import line_value
    lines = b.order_items(s)
    want = lines.groupBy("order_id").agg(F.sum(line_value(lines)).alias("value")).join(b.orders_with_zip(s), "order_id").select("order_id", "value")
    assert got == {(r.order_id, r.value) for r in want.collect()}


def test_bucketed_edges(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k long, v int")
    t = bk.write_bucketed(df, "bucket_edges", "k", 3, scratch_path(spark, "edges"))
    assert sorted((r.k or 0, r.v) for r in t.collect()) == [(0, 1), (1, 2), (1, 3)]
    assert t.hint("merge").join(t.select("k").distinct(), "k").count() == 2
    empty = bk.write_bucketed(df.limit(0), "bucket_empty", "k", 3, scratch_path(spark, "edges"))
    assert empty.collect() == []


# --- panel by deltas --------------------------------------------------------------------------------

SCHEMA = "series_id string, date date, revenue decimal(18,2), cogs decimal(18,2)"


def rows_of(rng, n):
    return [(rng.choice(["a", "b", None]), rng.choice([None, *[dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(120)) for _ in range(5)]]),
             Decimal(rng.randrange(1, 900)) / 100, rng.choice([None, Decimal(rng.randrange(900)) / 100])) for _ in range(n)]


def panel_of(store):
    return {(r.series_id, r.date): (r.n, r.revenue, r.cogs) for r in store.panel().collect()}


def rescan(lines):
    out = defaultdict(lambda: [0, Decimal(0), Decimal(0)])
    for s, d, r, c in lines:
        e = out[s, d]
        e[0], e[1], e[2] = e[0] + 1, e[1] + (r or 0), e[2] + (c or 0)
    return {k: tuple(v) for k, v in out.items()}


def test_store_equals_a_rescan(spark):
    """Loads, corrections, replays and folds in a random order."""
    rng = random.Random(5)
    store = PanelStore(spark, scratch_path(spark, "store"), ["series_id"], ["revenue", "cogs"])
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert panel_of(store) == {}
    live, sent = [], {}
    for batch in range(1, 7):
        added = rows_of(rng, 40)
        removed = rng.sample(live, min(len(live), 25))
        for r in removed:
            live.remove(r)
        live += added
        sent[batch] = (frame(added), frame(removed))
        assert store.commit(batch, *sent[batch])
        again = rng.randrange(1, batch + 1)
        assert not store.commit(again, *sent[again])
        if batch in (2, 5):
            store.fold(batch)
            assert not store.commit(1, *sent[1])
        assert panel_of(store) == rescan(live)
    upto, base = store.folded()
    assert upto == 5 and set(store.open_batches()) == {6}
    # only what is live is named, and the ledger is as long as the calendar
    assert len(base) <= 6 and store.dead_attempts()
    part = {(r.series_id, r.date) for r in store.panel("2020-02", "2020-03").collect()}
    assert part == {k for k in rescan(live) if k[1] and "2020-02" <= k[1].strftime("%Y-%m") <= "2020-03"}


def test_batch_sent_twice_at_once(spark):
    """Two senders pass the check and write; one attempt is read."""
    store = PanelStore(spark, scratch_path(spark, "store"), ["series_id"], ["revenue", "cogs"])
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), Decimal("5.00"), None)], SCHEMA)
    store.commit(1, df)
    second = store._write(store.summed(df), "batch-1")
    spark.createDataFrame([(1, second)], BATCH).write.mode("append").parquet(store._at("ledger", "batches"))
    store._write(store.summed(df), "batch-2")                 # broke off before the ledger
    assert panel_of(store) == {("a", dt.date(2020, 1, 1)): (1, Decimal("5"), Decimal("0"))}
    with pytest.raises(ValueError):
        store.fold(2)


def test_store_edges(spark):
    store = PanelStore(spark, scratch_path(spark, "store"), ["series_id"], ["revenue", "cogs"])
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), Decimal("5.00"), None)], SCHEMA)
    assert store.commit(1, df.limit(0)) and panel_of(store) == {}
    assert store.commit(2, df) and store.commit(3, removed=df.withColumn("extra", F.lit(1)))
    assert panel_of(store) == {}
    store.fold(3)
    assert panel_of(store) == {} and store.folded() == (3, {})
    with pytest.raises(ValueError):
        store.commit(4)


# --- file statistics --------------------------------------------------------------------------------

def test_profile_reads_no_column(spark):
    s = fs.stats_session(spark)
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        plan = plan_of(fs.footer_ends(s, f"{SF_SMALL}/{t}.parquet", c)[0])
        assert f"PushedAggregation: [COUNT(*), MIN({c}), MAX({c})]" in plan and f"ReadSchema: struct<{c}" not in plan
    p = fs.profile(s, {"orders": (f"{SF_SMALL}/orders.parquet", "o_orderdate"), "lineitem": (f"{SF_SMALL}/lineitem.parquet", "l_shipdate")})
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "false"
    got = {r["table"]: (r.rows, r.min_date, r.max_date) for r in p.collect()}
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").agg(F.count("*"), F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    assert got["orders"] == tuple(o)


def test_profile_of_all_kinds(spark):
    s = fs.stats_session(spark)
    rows = [(1, dt.datetime(1969, 12, 31, 23, 0), dt.date(1969, 12, 31)), (2, dt.datetime(2020, 5, 6, 7, 8, 9), dt.date(2020, 5, 6)), (3, None, None)]
    df = spark.createDataFrame(rows, "i long, t timestamp_ntz, d date")
    for kind in ("INT96", "TIMESTAMP_MICROS", "TIMESTAMP_MILLIS"):
        before = spark.conf.get("spark.sql.parquet.outputTimestampType")
        spark.conf.set("spark.sql.parquet.outputTimestampType", kind)
        path = scratch_path(spark, "stats")
        df.select("i", F.col("t").cast("timestamp").alias("t"), "d").write.parquet(path)
        spark.conf.set("spark.sql.parquet.outputTimestampType", before)
        for c in ("t", "d"):
            assert tuple(fs.date_profile(s, path, c).first()) == (3, dt.date(1969, 12, 31), dt.date(2020, 5, 6))
    path = scratch_path(spark, "stats")
    df.limit(0).write.parquet(path)
    assert tuple(fs.date_profile(s, path, "t").first()) == (0, None, None)


# --- quarantine -------------------------------------------------------------------------------------

LINES = ['Date, Revenue ,COGS,note', "2020-01-01,5.5,1,x", "2020-01-02,abc,1,x", ",3,1,x", "2020-02-30,-1,,x", "2020-01-03,1", "2020-01-04,1,2,x,more", "",
         '2020-01-05,"7",2,"a, b"', "2020-01-06,NaN,2,x", "2020-01-07,1e3, 4 ,"]


def test_quarantine(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("\n".join(LINES),)], "value string").coalesce(1).write.text(path)
    checked = qt.read_checked(spark, path, qt.SALES)
    reasons = sorted(sorted(r.reasons) for r in checked.collect())
    assert reasons == sorted([[], ["bad_revenue"], ["missing_date"], ["bad_date", "missing_cogs", "range_revenue"], ["malformed"], ["malformed"], [], ["bad_revenue"], []])
    good, bad = qt.split(checked, qt.SALES)
    assert good.count() + bad.count() == len(LINES) - 2          # less the header and the blank line
    assert sorted((str(r.date), r.revenue, r.cogs) for r in good.collect()) == [("2020-01-01", 5.5, 1.0), ("2020-01-05", 7.0, 2.0), ("2020-01-07", 1000.0, 4.0)]
    assert {r.line for r in bad.filter("array_contains(reasons, 'malformed')").collect()} == {"2020-01-03,1", "2020-01-04,1,2,x,more"}
    out = scratch_path(spark, "rejects")
    assert qt.load_with_quarantine(spark, path, qt.SALES, out).count() == 3
    assert {(r.reason, r["count"]) for r in spark.read.parquet(out).groupBy("reason").count().collect()} == {("bad_revenue", 2), ("missing_date", 1), ("malformed", 2), ("bad_date", 1)}
    counts = {r.reason: r.n for r in qt.account(checked).collect()}
    assert counts["loaded"] == 3 and counts["rejected"] == 6
    with pytest.raises(ValueError):
        qt.read_checked(spark, path, qt.PROMOTIONS)


def test_quarantine_of_an_empty_file(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("date,revenue,cogs",)], "value string").coalesce(1).write.text(path)
    assert qt.account(qt.read_checked(spark, path, qt.SALES)).collect() == []
