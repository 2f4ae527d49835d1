"""A key holding a third of all rows is spread over its day chunks, and results stay exact."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from gridpv.operators import series
from gridpv.operators.series import CHUNK, DAY_US, HOUR_US, with_chunk
from tests.reference_rules import fill_two_sided

T0 = dt.datetime(2024, 1, 1)


def _rows():
    rnd = random.Random(11)
    rows = []
    # hot key: 20 days of half-hours; ten cold keys share the same number of rows
    for i in range(20 * 48):
        rows.append(("hot", "x", T0 + dt.timedelta(minutes=30 * i), None if rnd.random() < 0.4 else float(i)))
    for k in range(10):
        for i in range(2 * 48):
            rows.append((f"c{k}", "y", T0 + dt.timedelta(minutes=30 * i), None if rnd.random() < 0.4 else float(i)))
    return rows


def test_hot_key_is_split_by_chunk_and_exact(spark):
    df = spark.createDataFrame(_rows(), "k string, k2 string, ts timestamp_ntz, v double")
    out = series.interpolate_time(df, ["k", "k2"], "ts", "v", limit=12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Every window ordered by time (row level) is partitioned by the keys and the chunk;
    # only the per-chunk summary windows are partitioned by the keys alone.
    specs = re.findall(r"\n\s*[:+\- ]*Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    row_level = [(p, o) for p, o in specs if "ts#" in o]
    assert row_level
    assert all("_chunk" in p and "k#" in p and "k2#" in p for p, _ in row_level), row_level

    sizes = with_chunk(df, "ts", DAY_US).groupBy("k", CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= 48  # no (key, chunk) partition holds more than a day of half-hours

    got = {}
    for r in out.orderBy("k", "ts").collect():
        got.setdefault(r["k"], []).append(r["v"])
    rows = _rows()
    for k in got:
        vals = [v for kk, _, _, v in rows if kk == k]
        xs = [(t - T0).total_seconds() for kk, _, t, _ in rows if kk == k]
        exp = fill_two_sided(vals, xs, 12)
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(got[k], exp)), k


def test_k3_capacity_join_keeps_the_row_partitioning(spark):
    """Without broadcast, K3 joins the month capacity on (key, chunk): the gridded
    rows are not shuffled again (the month test is a residual predicate)."""
    from __spark_entry__ import queries

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = queries()["k3_generation_with_capacity"](spark, "/root/testdata/sf0.001") \
            ._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert re.search(r"SortMergeJoin \[gsp_id#\d+, _chunk#\d+L?\], \[gsp_id#\d+, _chunk#\d+L?\], LeftOuter", plan)


def test_chunk_for_step_sizes():
    from gridpv.operators.series import HALF_HOUR_US, chunk_for_step

    assert chunk_for_step(HALF_HOUR_US) == 128 * HOUR_US
    assert chunk_for_step(HOUR_US) == 256 * HOUR_US
    assert chunk_for_step(DAY_US) == 256 * DAY_US
    assert chunk_for_step(60 * 1_000_000) == 5 * HOUR_US
