"""Rows that must not get lost or invented, and inputs of other shapes."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridpv.functions.columns import to_utc_ntz
from gridpv.operators import capacity, clean, model, report, series
from gridpv.operators.joins import small_side
from gridpv.plans import generation
from gridpv.plans.modelling import train_and_score
from gridpv.session import checkpoint_dir
from gridpv.sources.files import select_generation

T0 = dt.datetime(2024, 6, 1)


def test_split_keeps_rows_with_missing_keys_and_works_without_keys(spark):
    rows = [(None if i % 2 else "a", T0 + dt.timedelta(minutes=i), i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, date timestamp_ntz, i int")
    got = model.split(df, ["k"], tiebreak=["i"])
    assert sorted(r["i"] for r in got.collect()) == list(range(40))
    assert {(r["k"], r["split"]): r["n"] for r in got.groupBy("k", "split").agg(F.count("*").alias("n")).collect()} == {
        ("a", "test"): 4, ("a", "train"): 16, (None, "test"): 4, (None, "train"): 16}
    alone = model.split(df, [], tiebreak=["i"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in alone} == {"test": 8, "train": 32}


def test_split_ranks_only_the_boundary_bucket(spark):
    rows = [("a", T0 + dt.timedelta(minutes=i // 3), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, date timestamp_ntz, i int")
    for bits in (4, 12):
        got = model.split(df, ["k"], tiebreak=["i"], bucket_bits=bits)
        assert got.filter("split = 'test'").count() == 600
        ranked = {r["i"] for r in got.filter("split = 'test'").collect()}
        h = F.md5(F.concat_ws("|", "k", F.unix_micros(F.col("date").cast("timestamp")).cast("string"), F.lit("101")))
        first = df.withColumn("h", h).orderBy("h", "date", "i").limit(600)
        assert ranked == {r["i"] for r in first.collect()}


@pytest.mark.parametrize("method", ["interpolate", "zero", "none"])
def test_rows_without_key_go_with_every_method(spark, method):
    g = spark.createDataFrame([(1, T0, 1.0), (None, T0, 2.0), (1, None, 3.0)], "gsp_id int, datetime_gmt timestamp_ntz, generation_mw double")
    c = spark.createDataFrame([(1, dt.date(2024, 6, 1), 2024, 6, 5.0)], "gsp_id int, install_month date, year int, month int, cumul_capacity_mwp double")
    rows = generation.generation_with_capacity(g, c, method=method).collect()
    assert [(r["gsp_id"], r["generation_mw"], r["capacity_mwp"]) for r in rows] == [(1, 1.0, 5.0)]


@pytest.mark.parametrize("minutes", [15, 30, 60])
@pytest.mark.parametrize("shift", [0, 10])
def test_weather_of_any_step_takes_the_mean_of_its_hour(spark, minutes, shift):
    g = [("a", T0 + dt.timedelta(minutes=30 * i), float(10 * (i // 2 + 1))) for i in range(6)]
    gen = spark.createDataFrame(g, "k string, datetime_gmt timestamp_ntz, generation_mw double").withColumn("capacity_mwp", F.lit(7.0))
    w = [("a", T0 + dt.timedelta(minutes=shift + minutes * i), float(i)) for i in range(180 // minutes)]
    wx = spark.createDataFrame(w, "k string, date timestamp_ntz, sun double")
    rows = generation.modelling_table(wx, gen, ["k"]).collect()
    assert len(rows) == len(w)
    for r in rows:
        hour = min(int((r["date"] - T0).total_seconds()) // 3600, 2)
        assert (r["generation_mw"], r["capacity_mwp"]) == (10.0 * (hour + 1), 7.0)


def test_instants_are_utc_in_any_session(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP'2024-06-01 12:00:00Z' AS t, TIMESTAMP_NTZ'2024-06-01 12:00:00' AS n")
        row = df.select(to_utc_ntz("t").alias("t"), to_utc_ntz("n").alias("n"), to_utc_ntz("n", "Europe/Paris").alias("p")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (row["t"], row["n"], row["p"]) == (dt.datetime(2024, 6, 1, 12), dt.datetime(2024, 6, 1, 12), dt.datetime(2024, 6, 1, 10))


def test_series_operators_without_keys(spark):
    rows = [(T0 + dt.timedelta(hours=i), None if i in (2, 3) else float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    got = [r["v"] for r in series.interpolate_time(df, [], "t", "v").orderBy("t").collect()]
    assert got == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert series.nth_from_end(df, [], "t", 2).first()["v"] == 4.0


def test_two_values_for_one_month_need_an_order(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "x", 9.0, 1), (dt.date(2024, 1, 1), "x", 3.0, 2)], "install_month date, GSPs string, cumul_capacity_mwp double, o int")
    assert capacity.month_values(df, order=["o"]).first()["cumul_capacity_mwp"] == 9.0
    with pytest.raises(PySparkException):
        capacity.month_values(df).collect()


def test_missing_features_and_text_keys_are_trained_on(spark):
    rows = [(k, T0 + dt.timedelta(hours=i), None if i % 5 == 0 else float(i % 24), None, float(i % 24) * (2 if k == "b" else 1)) for k in "ab" for i in range(120)]
    df = spark.createDataFrame(rows, "k string, date timestamp_ntz, x double, gone double, generation_mw double")
    scored, metrics = train_and_score(df, ["k"], preset="boosted_default", select=False)
    assert scored.count() == 240 and scored.filter("pred_generation_mw IS NULL").count() == 0
    assert all(r["r2"] > 0.5 and r["rmse"] >= 0 for r in metrics.collect())


@pytest.mark.parametrize("name", ["trailing", "last_period", "scale", "attach", "select"])
def test_rows_are_not_shuffled_for_a_small_side(spark, tmp_path, name):
    rows = [(i % 3, T0 + dt.timedelta(hours=i), float(i), "train") for i in range(60)]
    spark.createDataFrame(rows, "gsp_id int, datetime_gmt timestamp_ntz, generation_mw double, split string").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    loc = spark.createDataFrame([(0, "n"), (1, "s")], "gsp_id int, region_name string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        out = {
            "trailing": lambda: series.trailing(g, ["gsp_id"], "datetime_gmt", "1d"),
            "last_period": lambda: report.last_period(g, ["gsp_id"], "datetime_gmt", "day"),
            "scale": lambda: model.scale(g, ["generation_mw"], ["gsp_id"]),
            "attach": lambda: clean.attach_location(g, loc),
            "select": lambda: select_generation(g, "2024-01-01", "2025-01-01", gsp_ids=loc.select("gsp_id")),
        }[name]()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert out.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_small_side_beyond_its_bound_stays_a_table(spark):
    df = spark.range(50)
    assert small_side(df, 10) is df
    assert small_side(df, 50).count() == 50


def test_limits_raise(spark):
    with pytest.raises(ValueError):
        model.estimator("forest_default", maxDepth=31)
    assert checkpoint_dir(spark)
