import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpv.operators import capacity as cap
from gridpv.operators import clean
from gridpv.plans import capacity as capplan
from gridpv.sources import manifest as mf
from gridpv.sources import requests as rq
from gridpv.sources import weather

D = dt.date


def _capacity(spark):
    rows = [
        (D(2020, 1, 1), "Alpha", 1.0, 3),
        (D(2020, 2, 1), "Alpha", 2.0, 4),
        (D(2020, 2, 1), " alpha ", 2.5, 1),   # differs in case and spaces
        (D(2020, 1, 1), "Beta", 5.0, None),   # missing value: dropped
        (D(2020, 2, 1), "Beta", 6.0, 2),
        (D(2020, 1, 1), "unkown", 7.0, 1),    # dropped
        (D(2020, 2, 1), "Gamma", None, 1),    # only missing capacity
        (D(2021, 3, 1), "Alpha", 4.0, 1),     # a month gap, GSP absent from Beta's last month
    ]
    return spark.createDataFrame(rows, "install_month date, GSPs string, cumul_capacity_mwp double, system_count long")


def _locations(spark):
    rows = [
        ("1", "ALPHA", 50.0, -1.0, "North", 11, 1),
        ("1", "alpha", 99.0, 99.0, "Other", 99, 2),   # duplicate name: the first row wins
        ("2.0", "  beta\t", 51.0, -2.0, "South", 12, 3),
        ("n/a", "gamma", 52.0, -3.0, "East", 13, 4),   # non-numeric id: dropped
        ("7", "unkown", 53.0, -4.0, "West", 14, 5),
        ("8", "delta", 53.0, -4.0, "West", 14, 6),     # unknown to the generation source
    ]
    return spark.createDataFrame(rows, "gsp_id string, gsp_name string, gsp_lat double, gsp_lon double, "
                                       "region_name string, pes_id int, row_ord long")


def test_merge_locations_rules(spark):
    known = spark.createDataFrame([(1,), (2,), (7,)], "gsp_id int")
    m = capplan.capacity_with_locations(_capacity(spark), _locations(spark), known, release="r1")
    got = sorted((r["GSPs"], str(r["install_month"]), r["gsp_id"], r["gsp_lat"]) for r in m.collect())
    assert got == [
        (" alpha ", "2020-02-01", 1, 50.0),
        ("Alpha", "2020-01-01", 1, 50.0),
        ("Alpha", "2020-02-01", 1, 50.0),
        ("Alpha", "2021-03-01", 1, 50.0),
        ("Beta", "2020-02-01", 2, 51.0),
    ]
    assert m.columns[0] == "release"
    locs = clean.gsp_locations(m).orderBy("GSPs").collect()
    assert [r["GSP_region"] for r in locs] == [" alpha  | North", "Alpha | North", "Beta | South"]


def test_pivot_unpivot_and_latest(spark):
    known = spark.createDataFrame([(1,), (2,)], "gsp_id int")
    m = capplan.capacity_with_locations(_capacity(spark), _locations(spark), known)
    wide = cap.wide_capacity(m)
    assert sorted(wide.columns) == sorted(["install_month", " alpha ", "Alpha", "Beta"])
    assert wide.count() == 3
    long = cap.long_capacity(wide)
    assert long.count() == 5
    lm = capplan.location_map(m).collect()
    latest = {r["GSPs"]: r["latest_capacity_mwp"] for r in lm}
    assert latest == {" alpha ": None, "Alpha": 4.0, "Beta": None}


def test_annual_increase_with_empty_year(spark):
    rows = [(D(2018, 6, 1), "A", 1.0), (D(2018, 12, 1), "A", 2.0), (D(2018, 3, 1), "B", 5.0),
            (D(2020, 1, 1), "A", 4.0)]
    cells = spark.createDataFrame(rows, "install_month date, GSPs string, cumul_capacity_mwp double")
    got = [(r["year"], r["annual_increase_mwp"], r["total_capacity_mwp"])
           for r in cap.annual(cells, start="2009-01-01").orderBy("year").collect()]
    assert got == [(2018, 0.0, 7.0), (2019, -7.0, 0.0), (2020, 4.0, 4.0)]


def test_top_gsps_and_national(spark):
    rows = [(D(2020, 1, 1), g, v) for g, v in [("A", 3.0), ("B", 9.0), ("C", 9.0), ("D", 1.0)]]
    rows += [(D(2019, 1, 1), "E", 100.0)]
    cells = spark.createDataFrame(rows, "install_month date, GSPs string, cumul_capacity_mwp double")
    top = [r["GSPs"] for r in cap.top_gsps(cells, n=3).collect()]
    assert top == ["B", "C", "A"]
    nat = cap.national_capacity(cells).collect()[0]
    assert nat["gsp_count"] == 5 and nat["total_solar_capacity_gwp"] == 0
    skip = cap.national_capacity(cells.withColumn("cumul_capacity_mwp", F.col("cumul_capacity_mwp") * 1000),
                                 skip_first=True).collect()[0]
    assert skip["total_solar_capacity_gwp"] == 19


def _manifest(spark, rows):
    return spark.createDataFrame(rows, "release_ord int, release string, file_ord int, filename string, url string")


def test_manifest_release_order_wins_over_tier(spark):
    man = _manifest(spark, [
        (1, "r1", 1, "x_capacity_by_region_gsp.csv.gz", "u1"),                    # tier 3 in release 1
        (2, "r2", 1, "y.csv.gz", "u2"),
        (2, "r2", 2, "z_capacity_by_20250101_GSP_and_month.csv.gz", "u3"),      # tier 1 in release 2
    ])
    got = mf.choose_release(man, "gsp", True, False, "20250101").collect()
    assert [(r["release"], r["tier"]) for r in got] == [("r1", 3)]
    assert mf.choose_release(man, "llsoa", True, False).count() == 0


def test_manifest_tier_one_second_in_file_order(spark):
    man = _manifest(spark, [
        (1, "r1", 1, "a_capacity_by_20250101_GSP.csv.gz", "u1"),               # tier 2
        (1, "r1", 2, "b_capacity_by_20250101_GSP_and_month.csv.gz", "u2"),      # tier 1
    ])
    got = mf.choose_release(man, "gsp", True, False, "20250101").collect()
    assert [(r["filename"], r["tier"]) for r in got] == [("b_capacity_by_20250101_GSP_and_month.csv.gz", 1)]


def test_validate_periods(spark):
    rows = [(1, D(2024, 3, 10), D(2024, 3, 1)), (2, D(2024, 3, 1), D(2024, 3, 20)),
            (3, D(2023, 1, 31), D(2023, 2, 28)), (5, D(2024, 1, 31), D(2024, 2, 28)), (4, D(2024, 1, 1), D(2024, 2, 1))]
    df = spark.createDataFrame(rows, "request_id int, start_date date, end_date date")
    got = {r["request_id"]: r["status"] for r in rq.validate_periods(df).collect()}
    assert got == {1: rq.END_BEFORE_START, 2: rq.SPAN_TOO_SHORT.format(m=1), 3: "ok", 4: "ok",
                   5: rq.SPAN_TOO_SHORT.format(m=1)}  # leap year: 31 Jan + 1 month = 29 Feb
    with pytest.raises(ValueError):
        rq.validate_period(D(2024, 3, 10), D(2024, 3, 1))
    with pytest.raises(ValueError):
        rq.validate_period(D(2024, 3, 1), D(2024, 3, 20))
    s, e = rq.validate_period(D(2023, 1, 31), D(2023, 2, 28))
    assert e == dt.datetime(2023, 2, 28, 23, 30)


def test_resolve_labels(spark):
    locs = spark.createDataFrame([("A", "1", "A | N"), ("B", "x", "B | S")], "GSPs string, gsp_id string, GSP_region string")
    req = spark.createDataFrame([(1, "A | N"), (2, None), (3, "Z | Q"), (4, "B | S")], "request_id int, gsp_region string")
    got = {r["request_id"]: (r["gsp_id"], r["status"]) for r in rq.resolve_labels(req, locs).collect()}
    assert got[1] == (1, "ok")
    assert got[2] == (None, rq.NO_LABEL)
    assert got[3] == (None, "GSP_region 'Z | Q' not found.")
    assert got[4] == (None, "gsp_id for 'B | S' is not convertible to int: x")


def test_explode_weather_cuts_arrays_and_steps(spark):
    rows = [(1, 0, 3 * 3600, 3600, [1.0, 2.0, 3.0, 4.0, 5.0]),   # array longer than the grid
            (2, 0, 3600, 1800, [7.0, 8.0])]                       # interval other than 3600
    df = spark.createDataFrame(rows, "gsp_id int, time long, time_end long, interval int, shortwave_radiation array<float>")
    out = weather.explode_weather(df, ["gsp_id"], ["shortwave_radiation"]).orderBy("gsp_id", "date").collect()
    assert [(r["gsp_id"], r["date"].minute + 60 * r["date"].hour, r["shortwave_radiation"]) for r in out] == [
        (1, 0, 1.0), (1, 60, 2.0), (1, 120, 3.0), (2, 0, 7.0), (2, 30, 8.0)]


def test_weather_requests_first_row_with_location(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, None, None), (1, t + dt.timedelta(hours=1), 50.5, None), (1, t + dt.timedelta(days=2), 51.0, -1.0),
            (1, t + dt.timedelta(days=3), 52.0, -2.0)]
    df = spark.createDataFrame(rows, "gsp_id int, datetime_gmt timestamp_ntz, gsp_lat double, gsp_lon double")
    r = weather.weather_requests(df, ["gsp_id"]).collect()[0]
    assert (r["latitude"], r["longitude"], r["start_date"], r["end_date"]) == (51.0, -1.0, "2024-01-01", "2024-01-04")
