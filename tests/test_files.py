import gzip
import os
import tempfile

from gridpv.sources.files import read_capacity, read_generation, read_locations, write_table
from gridpv.sources.testdata import r2_sparse


def test_read_capacity_gzip_csv(spark):
    d = tempfile.mkdtemp(prefix="gridpv-cap-")
    p = os.path.join(d, "cap.csv.gz")
    with gzip.open(p, "wt") as f:
        f.write("install_month,GSPs,dc_capacity_MWp,cumul_capacity_mwp,system_count\n")
        f.write("2020-01-01,Alpha,1.5,1.0,3\n2020-02-01,Alpha,x,2.0,4\n2020-03-01,Beta,2.0,,5\n2020-04-01,Beta,2.5,3.0,6\n")
    df = read_capacity(spark, p, release="r7")
    assert df.columns == ["release", "install_month", "GSPs", "dc_capacity_mwp", "cumul_capacity_mwp", "system_count"]
    rows = sorted((str(r["install_month"]), r["GSPs"], r["system_count"]) for r in df.collect())
    assert rows == [("2020-01-01", "Alpha", 3), ("2020-04-01", "Beta", 6)]
    assert dict(df.dtypes)["system_count"] == "bigint"


def test_read_locations_keeps_text_ids_and_order(spark):
    d = tempfile.mkdtemp(prefix="gridpv-loc-")
    p = os.path.join(d, "gsp_info.csv")
    with open(p, "w") as f:
        f.write("gsp_id,gsp_name,gsp_lat,gsp_lon,region_name,pes_id\n1,A,50.0,-1.0,N,11\nn/a,B,51.0,-2.0,S,12\n")
    rows = read_locations(spark, p).orderBy("row_ord").collect()
    assert [r["gsp_id"] for r in rows] == ["1", "n/a"] and rows[0]["gsp_lat"] == 50.0


def test_write_and_read_generation_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="gridpv-gen-")
    g = r2_sparse(spark, "/root/testdata/sf0.001").select("gsp_id", "datetime_gmt", "generation_mw")
    from pyspark.sql import functions as F

    out = os.path.join(d, "generation")
    write_table(g.withColumn("gsp_id", F.col("gsp_id").cast("int")).withColumn("month", F.month("datetime_gmt")),
                out, partition_by=["month"])
    back = read_generation(spark, out, "2024-01-05 00:00:00", "2024-01-10 23:30:00", gsp_ids=[1, 2, 3])
    exp = g.filter("datetime_gmt BETWEEN '2024-01-05 00:00:00' AND '2024-01-10 23:30:00' AND gsp_id IN (1, 2, 3)")
    assert back.count() == exp.count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "datetime_gmt" in plan.split("PushedFilters")[1][:300]


def test_weather_payload_roundtrip_and_explode(spark):
    from gridpv.sources.files import read_weather_payload
    from gridpv.sources.testdata import r7_payload
    from gridpv.sources.weather import explode_weather

    d = tempfile.mkdtemp(prefix="gridpv-wx-")
    p = r7_payload(spark, "/root/testdata/sf0.001").withColumnRenamed("event_type", "gsp_name")
    from pyspark.sql import functions as F

    p = p.withColumn("gsp_id", F.hash("gsp_name")).drop("gsp_name")
    write_table(p, os.path.join(d, "payload"))
    back = read_weather_payload(spark, os.path.join(d, "payload"))
    rows = explode_weather(back, ["gsp_id"])
    assert rows.count() == 24 * p.count()
    assert set(rows.columns) >= {"gsp_id", "date", "year", "month", "day", "hour", "shortwave_radiation"}


def test_series_table_needs_no_exchange_of_its_rows(spark, tmp_path):
    """A table written by (key, chunk) is filled, numbered and interpolated without a shuffle of the rows."""
    from gridpv.operators import series
    from gridpv.sources import testdata as td
    from gridpv.sources.files import write_series

    rows = td.r1_halfhourly(spark, "/root/testdata/sf0.001").persist()
    keys, ts = ["event_type"], "datetime_gmt"
    spark.sql("DROP TABLE IF EXISTS generation_by_chunk")
    write_series(rows, "generation_by_chunk", keys, ts, series.HALF_HOUR_US, buckets=8, path=str(tmp_path / "t"))
    table = spark.table("generation_by_chunk")
    assert len(table.inputFiles()) <= 8
    stored = series.interpolate_time(table, keys, ts, "generation_mw", limit=2)
    plain = series.interpolate_time(rows, keys, ts, "generation_mw", limit=2)
    assert sorted(map(str, stored.select(*rows.columns).collect())) == sorted(map(str, plain.select(*rows.columns).collect()))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    # the one exchange is that of the chunk summary, by key alone
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(event_type" in plan
    line = next(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "_chunk" not in line
    spark.sql("DROP TABLE generation_by_chunk")
    rows.unpersist()
