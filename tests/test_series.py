import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridpv.operators import series
from gridpv.operators.series import CHUNK, HALF_HOUR_US, HOUR_US
from tests.reference_rules import ffill, fill_two_sided

T0 = dt.datetime(2024, 1, 1)
SMALL_CHUNK = 2 * HOUR_US  # four half-hours per chunk: forces carries across chunks


def _series_df(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def _collect(df, col="v"):
    out = {}
    for r in df.orderBy("k", "ts").collect():
        out.setdefault(r["k"], []).append(r[col])
    return out


def _random_series(seed, n_keys=3, irregular=False):
    rnd = random.Random(seed)
    rows, truth = [], {}
    for k in range(n_keys):
        n = rnd.randint(1, 120)
        t = T0
        vals, times = [], []
        for i in range(n):
            t = t + dt.timedelta(minutes=rnd.choice([30, 30, 60, 90]) if irregular else 30)
            v = None if rnd.random() < rnd.choice([0.2, 0.5, 0.9]) else round(rnd.uniform(0, 100), 3)
            vals.append(v)
            times.append(t)
            rows.append((f"k{k}", t, v))
        truth[f"k{k}"] = (vals, [(x - T0).total_seconds() for x in times])
    return rows, truth


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) < 1e-9 * max(1.0, abs(a))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limit", [None, 2, 12])
def test_time_interpolation_matches_rule(spark, seed, limit):
    rows, truth = _random_series(seed, irregular=True)
    df = _series_df(spark, rows)
    got = _collect(series.interpolate_time(df, ["k"], "ts", "v", limit=limit, chunk_us=SMALL_CHUNK))
    for k, (vals, xs) in truth.items():
        exp = fill_two_sided(vals, xs, limit)
        assert all(_close(a, b) for a, b in zip(got[k], exp)), (k, got[k], exp)


@pytest.mark.parametrize("seed", range(4))
def test_linear_interpolation_by_position(spark, seed):
    rows, truth = _random_series(100 + seed, irregular=True)
    df = _series_df(spark, rows)
    got = _collect(series.interpolate_linear(df, ["k"], "ts", "v", chunk_us=SMALL_CHUNK))
    for k, (vals, _) in truth.items():
        exp = fill_two_sided(vals, list(range(len(vals))), None)
        assert all(_close(a, b) for a, b in zip(got[k], exp)), (k, got[k], exp)


def test_ffill_and_bfill(spark):
    rows, truth = _random_series(7)
    df = _series_df(spark, rows)
    got = _collect(series.ffill(df, ["k"], "ts", "v", chunk_us=SMALL_CHUNK))
    got2 = _collect(series.ffill_bfill(df, ["k"], "ts", "v", chunk_us=SMALL_CHUNK))
    for k, (vals, _) in truth.items():
        assert got[k] == ffill(vals)
        back = list(reversed(ffill(list(reversed(vals)))))
        assert got2[k] == [a if a is not None else b for a, b in zip(ffill(vals), back)]


def test_gap_of_30_with_limit_12_leaves_6(spark):
    vals = [1.0] + [None] * 30 + [32.0]
    rows = [("a", T0 + dt.timedelta(minutes=30 * i), v) for i, v in enumerate(vals)]
    got = _collect(series.interpolate_time(_series_df(spark, rows), ["k"], "ts", "v", limit=12,
                                           chunk_us=SMALL_CHUNK))["a"]
    assert sum(v is None for v in got) == 6
    assert got[:13] == pytest.approx([1.0 + i for i in range(13)]) and got[13:19] == [None] * 6
    assert got[-13:] == pytest.approx([20.0 + i for i in range(13)])


def test_edge_gaps_of_15_with_limit_12(spark):
    vals = [None] * 15 + [5.0, 6.0] + [None] * 15
    rows = [("a", T0 + dt.timedelta(minutes=30 * i), v) for i, v in enumerate(vals)]
    got = _collect(series.interpolate_time(_series_df(spark, rows), ["k"], "ts", "v", limit=12,
                                           chunk_us=SMALL_CHUNK))["a"]
    assert got[:3] == [None] * 3 and got[3:15] == [5.0] * 12
    assert got[17:29] == [6.0] * 12 and got[29:] == [None] * 3


def test_all_missing_stays_missing(spark):
    rows = [("a", T0 + dt.timedelta(minutes=30 * i), None) for i in range(10)]
    got = _collect(series.interpolate_time(_series_df(spark, rows), ["k"], "ts", "v", limit=12))["a"]
    assert got == [None] * 10


def test_time_grid_row_count_and_alignment(spark):
    rows = [("a", T0 + dt.timedelta(minutes=17), 1.0), ("a", T0 + dt.timedelta(hours=30, minutes=17), 2.0),
            ("b", T0, 3.0)]
    g = series.time_grid(_series_df(spark, rows), ["k"], "ts", HALF_HOUR_US, chunk_us=SMALL_CHUNK)
    a = sorted(r["ts"] for r in g.filter("k = 'a'").collect())
    assert len(a) == 30 * 2 + 1
    assert a[0] == T0 + dt.timedelta(minutes=17) and a[-1] == T0 + dt.timedelta(hours=30, minutes=17)
    assert all((y - x) == dt.timedelta(minutes=30) for x, y in zip(a, a[1:]))
    assert g.filter("k = 'b'").count() == 1


def test_regularize_drops_off_grid_and_fills_slots(spark):
    rows = [("a", T0, 1.0), ("a", T0 + dt.timedelta(minutes=45), 9.0), ("a", T0 + dt.timedelta(hours=2), 2.0)]
    r = series.regularize(_series_df(spark, rows), ["k"], "ts", HALF_HOUR_US)
    got = [(x["ts"], x["v"]) for x in r.orderBy("ts").collect()]
    assert [v for _, v in got] == [1.0, None, None, None, 2.0]
    assert series.missing_slots(r.drop(CHUNK).filter(F.col("v").isNotNull()), ["k"], "ts").count() == 3
    assert series.missing_slots(r.drop(CHUNK), ["k"], "ts").count() == 0


def test_regularize_duplicate_timestamp_fails(spark):
    rows = [("a", T0, 1.0), ("a", T0, 2.0), ("a", T0 + dt.timedelta(hours=1), 2.0)]
    with pytest.raises(Exception, match="duplicate"):
        series.regularize(_series_df(spark, rows), ["k"], "ts", HALF_HOUR_US).collect()


def test_nth_from_end_across_chunks(spark):
    rows = [("a", T0 + dt.timedelta(minutes=30 * i), float(i)) for i in range(100)]
    rows += [("b", T0 + dt.timedelta(minutes=30 * i), float(i)) for i in range(10)]
    out = series.nth_from_end(_series_df(spark, rows), ["k"], "ts", 50, chunk_us=SMALL_CHUNK).collect()
    assert [(r["k"], r["v"]) for r in out] == [("a", 50.0)]


def test_unsorted_input_and_hourly_mean(spark):
    rows = [("a", T0 + dt.timedelta(minutes=30), 3.0), ("a", T0, 1.0), ("a", T0 + dt.timedelta(hours=1), None)]
    h = series.to_hourly(_series_df(spark, rows), ["k"], "ts", ["v"]).orderBy("ts").collect()
    assert [r["v"] for r in h] == [2.0, None]
