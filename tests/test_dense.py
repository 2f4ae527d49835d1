"""Dense irregular series: many rows of one key within an hour."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridpv.operators import series


def _dense(spark, n=4000):
    """One key with n rows in an hour (a third of them at one instant), a sparse key, and rows without key or time."""
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 5, 1, 10)
    rows = []
    for i in range(n):
        us = 1_000_000 if i % 3 == 0 else int(rnd.random() ** 4 * 3_600_000_000)
        rows.append(("a", t0 + dt.timedelta(microseconds=us), i, rnd.random() if rnd.random() < 0.2 else None))
    rows += [("b", t0 + dt.timedelta(hours=h), n + h, float(h) if h % 3 == 0 else None) for h in range(50)]
    rows += [(None, t0, n + 60, 1.0), ("b", None, n + 61, 1.0)]
    return spark.createDataFrame(rows, "gsp_id string, ts timestamp_ntz, id int, v double")


def test_chunks_are_bounded_and_ordered(spark):
    df = _dense(spark)
    x = series.bounded_chunks(df, ["gsp_id"], "ts", rows=100, slices=8)
    assert x.count() == df.count() and x.columns == [*df.columns, series.CHUNK]
    sizes = x.dropna(subset=["gsp_id", "ts"]).groupBy("gsp_id", series.CHUNK).agg(
        F.count("*").alias("n"), F.countDistinct("ts").alias("times"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    assert all(r["n"] <= 100 or r["times"] == 1 for r in sizes) and len(sizes) > 30
    for key in "ab":
        held = sorted((r[series.CHUNK], r["lo"], r["hi"]) for r in sizes if r["gsp_id"] == key)
        assert all(a[2] < b[1] for a, b in zip(held, held[1:]))


def test_a_million_rows_of_one_hour_are_dealt(spark):
    t = F.timestamp_add("SECOND", (F.col("id") % 3600).cast("int"), F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    df = spark.range(1_000_000).select(F.lit("a").alias("gsp_id"), t.alias("ts"), "id")
    x = series.bounded_chunks(df, ["gsp_id"], "ts", rows=20_000)
    top = x.groupBy("gsp_id", series.CHUNK).count().agg(F.max("count"), F.count("*")).first()
    assert top[0] <= 20_000 and top[1] >= 50


def test_fills_equal_those_of_whole_buckets(spark):
    df = _dense(spark)
    for how in ("time_interpolate", "linear_interpolate", "forward_fill", "forward_back_fill"):
        limit = 5 if how.endswith("interpolate") else None
        plain, bounded = (
            series.fill_series(df, ["gsp_id"], "ts", **{how: ["v"]}, limit=limit, tiebreak=["id"], max_chunk_rows=m) for m in (None, 150)
        )
        assert series.CHUNK not in bounded.columns
        assert sorted(map(str, plain.drop(series.CHUNK).select(*df.columns).collect())) == sorted(map(str, bounded.select(*df.columns).collect()))


def test_nth_from_end_of_a_dense_hour(spark, monkeypatch):
    monkeypatch.setattr(series, "PART_ROWS", 64)
    df = _dense(spark)
    rows = df.where("gsp_id = 'a'").collect()
    order = sorted(rows, key=lambda r: (r["ts"], r["id"]))
    for n in (1, 50, 700):
        got = {r["gsp_id"]: r["id"] for r in series.nth_from_end(df, ["gsp_id"], "ts", n, tiebreak=["id"]).collect()}
        assert got["a"] == order[-n]["id"]
    assert "b" not in got
