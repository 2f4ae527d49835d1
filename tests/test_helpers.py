import datetime as dt

import pytest

from gridpv.operators import clean, series
from gridpv.operators.series import CHUNK

T0 = dt.datetime(2024, 3, 1)


def test_merge_on_time_is_a_left_join(spark):
    left = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=1), 2.0), ("b", T0, 3.0)],
                                 "k string, date timestamp_ntz, w double")
    right = spark.createDataFrame([("a", T0 + dt.timedelta(hours=1), 10.0), ("c", T0, 99.0)],
                                  "k string, date timestamp_ntz, g double")
    got = sorted((r["k"], r["date"], r["w"], r["g"]) for r in series.merge_on_time(left, right, ["k"], "date").drop(CHUNK).collect())
    assert got == [("a", T0, 1.0, None), ("a", T0 + dt.timedelta(hours=1), 2.0, 10.0), ("b", T0, 3.0, None)]


def test_merge_on_time_rejects_repeats(spark):
    left = spark.createDataFrame([("a", T0, 1.0)], "k string, date timestamp_ntz, w double")
    right = spark.createDataFrame([("a", T0, 1.0), ("a", T0, 2.0)], "k string, date timestamp_ntz, g double")
    with pytest.raises(Exception, match="repeated"):
        series.merge_on_time(left, right, ["k"], "date").collect()


def test_trailing_spans(spark):
    rows = [("a", T0 - dt.timedelta(days=d), float(d)) for d in (0, 1, 5, 8, 40, 100)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    counts = {span: series.trailing(df, ["k"], "ts", span).count() for span in ("1d", "7d", "1m", "3m", "all")}
    assert counts == {"1d": 2, "7d": 3, "1m": 4, "3m": 5, "all": 6}


def test_national_and_unknown_ids_and_append(spark):
    gen = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "gsp_id int, generation_mw double")
    assert sorted(r["gsp_id"] for r in clean.exclude_national(gen).collect()) == [1, 2]
    assert clean.exclude_national(gen, include_national=True).count() == 3
    locs = spark.createDataFrame([(1,), (5,)], "gsp_id int")
    assert sorted(r["gsp_id"] for r in clean.unknown_ids(gen, locs).collect()) == [0, 2]
    empty = gen.limit(0)
    assert clean.append([gen, empty, gen.select("gsp_id")]).count() == 6


def test_first_per_key_uses_the_order(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 5, "only")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in clean.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"x": "early", "y": "only"}


def test_describe_schema_and_utc_conversion(spark):
    from pyspark.sql import functions as F

    from gridpv.functions.columns import coerce_int, norm_key, parse_ts, to_utc_ntz
    from gridpv.operators.quality import describe_schema

    df = spark.createDataFrame([("2024-07-01 12:00:00", " a\tb ", "12.7"), ("bad", "x", "n/a")],
                               "s string, name string, id string")
    n, cols = describe_schema(df)
    assert n == 2 and cols == [("s", "string"), ("name", "string"), ("id", "string")]
    out = df.select(parse_ts("s").alias("t"), norm_key("name").alias("k"), coerce_int("id").alias("i")).collect()
    assert out[0]["t"] == dt.datetime(2024, 7, 1, 12, 0) and out[1]["t"] is None
    assert out[0]["k"] == "A\tB" and out[0]["i"] == 12 and out[1]["i"] is None
    # Summer time in London is UTC+1: 12:00 local is 11:00 UTC; naive values are taken as UTC.
    conv = df.select(to_utc_ntz(parse_ts("s"), "Europe/London").alias("u"), to_utc_ntz(parse_ts("s")).alias("n")).first()
    assert conv["u"] == dt.datetime(2024, 7, 1, 11, 0) and conv["n"] == dt.datetime(2024, 7, 1, 12, 0)


def test_quality_report_tables(spark):
    from gridpv.plans.quality import quality_report

    rows = [("a", T0 + dt.timedelta(minutes=30 * i), None if i in (2, 3) else float(i)) for i in range(10) if i != 5]
    df = spark.createDataFrame(rows, "k string, datetime_gmt timestamp_ntz, generation_mw double")
    rep = quality_report(df, ["k"])
    assert set(rep) == {"null_profile", "nulls_by_month", "rows_by_month", "completeness", "missing_slots",
                        "incomplete_rows"}
    comp = rep["completeness"].first()
    assert (comp["n_rows"], comp["expected_rows"], comp["n_missing"], comp["complete"]) == (9, 10, 2, False)
    assert [r["datetime_gmt"] for r in rep["missing_slots"].collect()] == [T0 + dt.timedelta(minutes=150)]
    assert rep["incomplete_rows"].count() == 2
    prof = {r["column_name"]: r["n_missing"] for r in rep["null_profile"].collect()}
    assert prof == {"k": 0, "datetime_gmt": 0, "generation_mw": 2}
