"""Metrics and diagnostics against numpy on small inline tables."""

import numpy as np
import pytest

from vendora.operators import diagnostics as dg
from vendora.operators.relational import exact_quantile_from_counts, global_prefix, ntile_from_rank
from pyspark.sql import functions as F

Y = [10.0, 12.0, 9.0, 15.0, 30.0, 11.0, 10.0, 30.0, 8.0, 14.0]
P = [11.0, 12.5, 8.0, 14.0, 20.0, 11.0, 12.0, 25.0, 9.0, 13.0]


def frame(spark, y=Y, p=P):
    return spark.createDataFrame([("A", i, a, b) for i, (a, b) in enumerate(zip(y, p))],
                                 "fold string, date int, actual double, pred double")


def test_fold_metrics_known_values(spark):
    m = dg.fold_metrics(frame(spark), ["fold"], {"rev": ("actual", "pred")}).first()
    y, p = np.array(Y), np.array(P)
    e = y - p
    assert m.rev_mae == pytest.approx(np.mean(np.abs(e)))
    assert m.rev_rmse == pytest.approx(np.sqrt(np.mean(e ** 2)))
    assert m.rev_r2 == pytest.approx(1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2))


def test_r2_null_on_constant_actuals(spark):
    m = dg.fold_metrics(frame(spark, [5.0] * 10), ["fold"], {"rev": ("actual", "pred")}).first()
    assert m.rev_r2 is None


def test_spike_threshold_with_ties(spark):
    s = dg.spike_decomposition(frame(spark), ["fold"], "actual", "pred").first()
    y, p = np.array(Y), np.array(P)
    thr = np.percentile(y, 90)
    spike = y >= thr
    assert s.threshold == pytest.approx(thr)
    assert s.n_spike == spike.sum() == 2          # both 30s are in
    err = np.abs(y - p)
    assert s.mae_spike == pytest.approx(err[spike].mean())
    assert s.pct_from_spikes == pytest.approx(err[spike].sum() / err.sum() * 100)


def test_residual_moments_are_biased(spark):
    r = frame(spark).withColumn("residual", F.col("actual") - F.col("pred"))
    st = dg.residual_stats(r).first()
    e = np.array(Y) - np.array(P)
    m2, m3, m4 = [np.mean((e - e.mean()) ** k) for k in (2, 3, 4)]
    assert st.std == pytest.approx(np.std(e))
    assert st.skew == pytest.approx(m3 / m2 ** 1.5)
    assert st.kurtosis == pytest.approx(m4 / m2 ** 2 - 3)
    assert st.median == pytest.approx(np.median(e))


def test_histogram_last_bin_closed(spark):
    r = frame(spark).withColumn("residual", F.col("actual"))
    h = {row.bin: row.n for row in dg.residual_histogram(r, bins=4).collect()}
    counts, _ = np.histogram(np.array(Y), bins=4)
    assert [h.get(i, 0) for i in range(4)] == list(counts)


def test_global_prefix_matches_a_sort(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 50, 3000).astype(float)     # many ties
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(vals)], "id long, v double")
    got = global_prefix(df, ["v", "id"], "v").orderBy("rank").collect()
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    assert [r.id for r in got] == order
    assert [r.cum for r in got] == pytest.approx(np.cumsum(vals[order]).tolist())


def test_global_prefix_splits_a_hot_value_and_keeps_nulls(spark):
    # a third of the rows share one first-column value; some first values are null
    rng = np.random.default_rng(11)
    n = 3000
    vals = [None if i % 97 == 0 else (5.0 if i % 3 == 0 else float(rng.integers(0, 400))) for i in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = global_prefix(df, ["v", "id"]).orderBy("rank").collect()
    order = sorted(range(n), key=lambda i: (vals[i] is not None, vals[i] or 0.0, i))
    assert [r.id for r in got] == order
    assert [r.rank for r in got] == list(range(1, n + 1))
    # the hot value is spread over several window partitions


def test_lag_diff_matches_plain_window(spark):
    from pyspark.sql import Window
    from vendora.operators.relational import lag_diff
    rows = [(i, (0 if i % 3 == 0 else i % 7), None if i % 53 == 0 else f"2020-01-{1 + (i * 7) % 28:02d}")
            for i in range(400)]
    df = (spark.createDataFrame(rows, "order_id long, customer_id long, d string")
               .select("order_id", "customer_id", F.to_date("d").alias("order_date")))
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    want = {r.order_id: r.g for r in df.select("order_id", F.datediff("order_date", F.lag("order_date").over(w))
                                               .alias("g")).collect()}
    got = {r.order_id: r.g for r in lag_diff(df, ["customer_id"], "order_date", "order_id", out="g").collect()}
    assert got == want


def test_ntile_formula_matches_sql_ntile(spark):
    for n in (1, 4, 5, 7, 23, 100):
        df = spark.range(1, n + 1).select(F.col("id").alias("r"))
        got = [x.t for x in df.select(ntile_from_rank(F.col("r"), F.lit(n), 5).alias("t")).orderBy("r").collect()]
        want = [x.t for x in spark.sql(f"SELECT ntile(5) OVER (ORDER BY id) AS t FROM range(1, {n + 1})").collect()]
        assert got == want


def test_exact_quantile_from_counts(spark):
    vals = [1, 1, 2, 5, 5, 5, 9, 12]
    hist = spark.createDataFrame([(v, vals.count(v)) for v in set(vals)], "g int, w long")
    for q in (0.1, 0.5, 0.9):
        got = exact_quantile_from_counts(hist, "g", "w", q).first()[0]
        assert got == pytest.approx(np.quantile(vals, q))


def test_qq_points_against_normal_quantiles(spark):
    from statistics import NormalDist
    r = frame(spark).withColumn("residual", F.col("actual") - F.col("pred"))
    pts = dg.qq_points(r).orderBy("rank").collect()
    n = len(pts)
    for row in pts:
        i = row["rank"]
        m = 0.5 ** (1 / n) if i == n else (1 - 0.5 ** (1 / n) if i == 1 else (i - 0.3175) / (n + 0.365))
        assert row.theoretical == pytest.approx(NormalDist().inv_cdf(m), abs=1e-8)


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6), st.just(3)), min_size=1, max_size=300))
def test_global_prefix_property(spark, vals):
    """Row numbers and running sums equal a full sort for any mix of hot ties and nulls."""
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)],
                               "id long, v double")
    got = global_prefix(df, ["v", "id"], "id").orderBy("rank").collect()
    order = sorted(range(len(vals)), key=lambda i: (vals[i] is not None, vals[i] or 0, i))
    assert [r.id for r in got] == order
    assert [r.cum for r in got] == np.cumsum(order).tolist()


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=200))
def test_lag_diff_property(spark, rows):
    """Skew-safe lag equals the plain per-customer window (customer 0 is often hot)."""
    from pyspark.sql import Window
    from vendora.operators.relational import lag_diff
    df = (spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(rows)], "order_id long, customer_id long, d int")
               .select("order_id", "customer_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))
                       .alias("order_date")))
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    want = {r.order_id: r.g for r in df.select("order_id", F.datediff("order_date", F.lag("order_date").over(w))
                                               .alias("g")).collect()}
    got = {r.order_id: r.g for r in lag_diff(df, ["customer_id"], "order_date", "order_id", out="g").collect()}
    assert got == want


def test_global_prefix_splits_a_hot_value_on_a_string_id(spark):
    """A value that most rows share is cut by the next column, whatever its type."""
    from vendora.operators import relational as rel
    rows = [(f"id{i:05d}", 7.0 if i % 10 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, v double")
    ranged = df.repartitionByRange(8, "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 1000
    got = rel.global_prefix(df, ["v", "id"], "v").orderBy("rank").collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r.id for r in got] == [r[0] for r in order]
    assert [r.cum for r in got] == pytest.approx(np.cumsum([r[1] for r in order]).tolist())


def test_lag_diff_null_group_has_no_difference(spark):
    from vendora.operators.relational import lag_diff
    df = spark.createDataFrame([(1, None, "2020-01-01"), (2, None, "2020-01-05"), (3, 7, "2020-01-01"), (4, 7, "2020-01-04")], "o long, c long, d string")
    got = {r.o: r.g for r in lag_diff(df.withColumn("d", F.to_date("d")), ["c"], "d", "o", out="g").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_dashboards_leave_out_null_keys(spark):
    from vendora.operators import dashboards as db
    o = spark.createDataFrame([(1, None, "2020-01-01"), (2, None, "2020-02-01"), (3, 7, "2020-01-01"), (4, 7, "2020-03-01"), (5, 8, "2020-03-02")],
                              "order_id long, customer_id long, d string").withColumn("order_date", F.to_date("d"))
    got = {(str(r.cohort), r.month_offset): (r.customers, r.cohort_size) for r in db.cohort_retention(o).collect()}
    assert got == {("2020-01-01", 0): (1, 1), ("2020-01-01", 2): (1, 1), ("2020-03-01", 0): (1, 1)}
    one = db.one_and_done(o).first()
    assert (one.n_customers, one.n_one_order) == (2, 1)
    items = spark.createDataFrame([(1, None), (1, 5), (2, 5)], "order_id long, product_id long")
    assert [r.product_id for r in db.top_return_products(items, items.limit(0), 3, 1).collect()] == [5]


def test_lead_time_legs(spark):
    """Two legs and their total; missing and negative spans are counted, not used."""
    from vendora.operators import dashboards as db
    rows = [(1, "2020-01-01", "2020-01-03", "2020-01-08"), (1, "2020-01-01", "2020-01-05", None), (1, "2020-01-09", "2020-01-05", "2020-01-10")]
    s = spark.createDataFrame(rows, "zip int, a string, b string, c string").select(
        "zip", F.to_date("a").alias("order_date"), F.to_date("b").alias("ship_date"), F.to_date("c").alias("delivery_date"))
    geo = spark.createDataFrame([(1, "East")], "zip int, region string")
    got = {r.leg: (r.n, r.avg_days, r.p50_days, r.n_excluded) for r in db.lead_time(s, geo).collect()}
    assert got == {"order_to_ship": (2, 3.0, 3.0, 1), "ship_to_delivery": (2, 5.0, 5.0, 1), "total": (2, 4.0, 4.0, 1)}


def test_residual_histogram_has_every_bin(spark):
    r = spark.createDataFrame([(0.0,), (1.0,), (60.0,)], "residual double")
    got = dg.residual_histogram(r).orderBy("bin").collect()
    assert [x.bin for x in got] == list(range(60)) and sum(x.n for x in got) == 3 and got[30].n == 0


def test_line_value_is_exact(spark):
    from vendora.operators.relational import line_value
    items = spark.createDataFrame([(3, 0.1)] * 1000, "quantity int, unit_price double")
    assert str(items.agg(F.sum(line_value(items)).alias("v")).first().v) == "300.0000"
