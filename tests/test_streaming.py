import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from gridpv.operators import series
from gridpv.schemas import GENERATION_SCHEMA
from gridpv.streaming.hourly import hourly_stream, write_hourly

T0 = dt.datetime(2024, 6, 1)


def _rows(hours, start=0):
    out = []
    for h in range(start, start + hours):
        for m, v in ((0, float(h)), (30, float(h) + 1.0)):
            out.append((1, T0 + dt.timedelta(hours=h, minutes=m), v))
            out.append((2, T0 + dt.timedelta(hours=h, minutes=m), None if h % 3 == 0 else 2.0 * v))
    return out


def test_streaming_hourly_matches_batch_for_closed_hours(spark):
    base = tempfile.mkdtemp(prefix="gridpv-stream-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    spark.createDataFrame(_rows(6), GENERATION_SCHEMA).write.parquet(os.path.join(src, "b1"))
    q = write_hourly(hourly_stream(spark, src + "/*"), out, os.path.join(base, "state"))
    q.awaitTermination()
    spark.createDataFrame(_rows(6, start=6), GENERATION_SCHEMA).write.parquet(os.path.join(src, "b2"))
    q = write_hourly(hourly_stream(spark, src + "/*"), out, os.path.join(base, "state"))
    q.awaitTermination()

    got = {(r["gsp_id"], r["datetime_gmt"]): r["generation_mw"] for r in spark.read.parquet(out).collect()}
    batch = series.to_hourly(spark.createDataFrame(_rows(12), GENERATION_SCHEMA), ["gsp_id"], "datetime_gmt",
                             ["generation_mw"])
    exp = {(r["gsp_id"], r["datetime_gmt"]): r["generation_mw"] for r in batch.collect()}
    # Hours closed by the watermark (max event time - 2 h) are written exactly once, with batch values.
    closed = {k: v for k, v in exp.items() if k[1] + dt.timedelta(hours=1) <= T0 + dt.timedelta(hours=11, minutes=30) - dt.timedelta(hours=2)}
    assert closed and all(k in got for k in closed)
    assert all(got[k] == closed[k] for k in closed)
    assert set(got) <= set(exp)
