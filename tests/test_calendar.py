"""Hand-computed calendar features on edge dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vendora.operators import calendar_ops as co


def feats(spark, days):
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")
    return {r["date"].isoformat(): r for r in co.feature_matrix(df).collect()}


def test_leap_day_and_weekday(spark):
    r = feats(spark, ["2016-02-29", "2022-01-01"])
    assert r["2016-02-29"]["dayofweek"] == 0          # a Monday
    assert r["2016-02-29"]["dim"] == 29 and r["2016-02-29"]["is_last1"] == 1
    assert r["2016-02-29"]["dayofyear"] == 60
    assert r["2022-01-01"]["dayofweek"] == 5 and r["2022-01-01"]["is_weekend"] == 1
    assert r["2022-01-01"]["hol_new_year"] == 1 and r["2022-01-01"]["is_first1"] == 1


def test_month_edges(spark):
    r = feats(spark, ["2022-01-31", "2020-12-31", "2021-01-02"])
    assert (r["2022-01-31"]["days_to_eom"], r["2022-01-31"]["is_last1"]) == (0, 1)
    assert r["2021-01-02"]["days_from_som"] == 1
    assert (r["2021-01-02"]["is_first1"], r["2021-01-02"]["is_first2"], r["2021-01-02"]["is_first3"]) == (0, 1, 1)
    assert r["2020-12-31"]["t_days"] == 365 and r["2020-12-31"]["regime_post2019"] == 1


def test_black_friday_is_last_friday_of_november(spark):
    r = feats(spark, ["2018-11-23", "2018-11-30", "2022-11-25"])
    assert r["2018-11-30"]["hol_black_friday"] == 1
    assert r["2018-11-23"]["hol_black_friday"] == 0
    assert r["2022-11-25"]["hol_black_friday"] == 1


def test_lunar_new_year_window(spark):
    r = feats(spark, ["2021-12-18", "2021-12-17", "2012-07-04", "2022-02-01", "2022-02-05"])
    assert r["2021-12-18"]["tet_days_diff"] == -45
    assert r["2021-12-17"]["tet_days_diff"] == 999
    assert r["2012-07-04"]["tet_days_diff"] == 999
    assert r["2022-02-01"]["tet_on"] == 1 and r["2022-02-01"]["tet_in_7"] == 1
    assert r["2022-02-05"]["tet_after_7"] == 1 and r["2022-02-05"]["tet_days_diff"] == 4


def test_campaign_edges_and_new_year_crossing(spark):
    r = feats(spark, ["2020-11-18", "2021-01-02", "2021-01-03", "2020-11-17"])
    assert (r["2020-11-18"]["promo_year_end"], r["2020-11-18"]["promo_year_end_since"]) == (1, 0.0)
    assert r["2020-11-18"]["promo_year_end_until"] == 45.0
    # the year-end window runs into January, end day included
    assert (r["2021-01-02"]["promo_year_end"], r["2021-01-02"]["promo_year_end_until"]) == (1, 0.0)
    assert r["2021-01-02"]["promo_year_end_disc"] == 20.0
    assert r["2021-01-03"]["promo_year_end"] == 0 and r["2021-01-03"]["promo_year_end_since"] == -1.0
    assert r["2020-11-17"]["promo_year_end"] == 0


def test_odd_year_campaigns(spark):
    r = feats(spark, ["2021-07-30", "2022-07-30", "2021-01-30", "2022-01-30"])
    assert r["2021-07-30"]["promo_urban_blowout"] == 1
    assert r["2021-07-30"]["promo_urban_blowout_disc"] == 0.0     # no discount given -> 0
    assert r["2022-07-30"]["promo_urban_blowout"] == 0
    assert (r["2021-01-30"]["promo_rural_special"], r["2021-01-30"]["promo_rural_special_disc"]) == (1, 15.0)
    assert r["2022-01-30"]["promo_rural_special"] == 0


def test_feature_matrix_has_81_features(spark):
    from vendora.functions.calendar import feature_names
    df = co.feature_matrix(spark.createDataFrame([(dt.date(2020, 5, 1),)], "date date"))
    assert len(feature_names()) == 81
    assert df.columns == ["date"] + feature_names()


def test_densify_fills_gaps_and_sums_duplicates(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 1), 2.0), ("a", dt.date(2020, 1, 4), 5.0),
            ("b", dt.date(2020, 1, 2), 7.0)]
    df = spark.createDataFrame(rows, "s string, date date, v double")
    out = co.densify(df, ["s"], "date", ["v"]).orderBy("s", "date").collect()
    assert len(out) == 8          # 2 series x 4 days of the global span
    assert [r.v for r in out if r.s == "a"] == [3.0, 0.0, 0.0, 5.0]


def test_span_guard(spark):
    with pytest.raises(Exception):
        co.date_spine(spark, "1000-01-01", "2999-01-01").count()


def test_feature_tables_of_the_callers_own(spark):
    """Later movable dates, other holidays and other campaigns than the fixed ones."""
    import datetime as dt

    from pyspark.sql import functions as F

    from vendora.functions import calendar as cal
    from vendora.operators import calendar_ops as co
    days = spark.createDataFrame([(dt.date(2031, 1, 23),), (dt.date(2031, 6, 1),)], "date date")
    camps = [c for c in cal.campaigns()][:1]
    got = co.feature_matrix(days, lunar_new_year=["2031-01-23"],
                            holidays=[(6, 1, "midyear")], campaigns=camps)
    assert set(got.columns) == {"date", *cal.feature_names([(6, 1, "midyear")], camps)}
    r = {x.date.month: x for x in got.collect()}
    assert r[1].tet_on == 1 and r[6].hol_midyear == 1 and r[1].hol_midyear == 0
    plain = co.feature_matrix(days).filter(F.col("date") == dt.date(2031, 1, 23)).first()
    assert plain.tet_days_diff == cal.LNY_NONE
