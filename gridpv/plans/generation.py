"""Generation pipelines: clean series, complete grid, capacity, weather (K2-K5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.operators import report, series
from gridpv.operators.joins import small_side
from gridpv.operators.series import CHUNK, HALF_HOUR_US


def clean_daily_generation(gen: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                           value: str = "generation_mw", limit: int = 12,
                           step_us: int = HALF_HOUR_US) -> DataFrame:
    """Daily generation per key from a half-hourly series with short gaps filled.

    Complete ``step`` grid per key (G6+D4), bounded two-sided time
    interpolation (G1), hour means (F1), daily sums with empty days as 0 (F2).
    """
    keys = list(keys)
    chunk = series.chunk_for_step(step_us)
    grid = series.regularize(gen.select(*keys, ts, value), keys, ts, step_us, chunk_us=chunk)
    filled = series.interpolate_time(grid, keys, ts, value, limit=limit, chunk_us=chunk)
    hourly = series.to_hourly(filled, keys, ts, [value]).drop(CHUNK)
    daily = report.resample(hourly, keys, ts, "day", sums=[value], out_ts="date")
    from gridpv.functions.columns import round_to

    return daily.select(*keys, "date", round_to(value, 6).alias(value))


def clean_generation(gen: DataFrame, locations: DataFrame, keys: Sequence[str] = ("gsp_id",),
                     ts: str = "datetime_gmt", limit: int = 12, tiebreak: Sequence[str] = ()) -> DataFrame:
    """K2: bounded two-sided time interpolation (G1) per key, then the location
    columns of each id (D2)."""
    filled = series.interpolate_time(gen, list(keys), ts, "generation_mw", limit=limit, tiebreak=tiebreak)
    from gridpv.operators.clean import attach_location

    return attach_location(filled.drop(CHUNK), locations, list(keys)[0])


def align_capacity(gen: DataFrame, capacity: DataFrame, keys: Sequence[str], on_duplicate: str = "error",
                   value: str = "cumul_capacity_mwp") -> DataFrame:
    """D3: generation left join monthly capacity on ``keys + (year, month)`` as
    ``capacity_mwp``.  Two capacity rows for one month of a key fail the job
    (``on_duplicate="error"``) or the later one wins (``"last"``)."""
    keys = list(keys)
    c = capacity.groupBy(*keys, "year", "month").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(value, "install_month").alias("capacity_mwp")
    )
    if on_duplicate == "error":
        c = c.withColumn("capacity_mwp", F.when(F.col("_n") > 1, F.raise_error(
            F.lit("several capacity rows for one month"))).otherwise(F.col("capacity_mwp")))
    return gen.join(small_side(c.drop("_n")), keys + ["year", "month"], "left")


def carried_capacity(gen_months: DataFrame, capacity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D3 + G3 at month grain: capacity of each (key, year, month) that has
    generation rows, carried forward from the last earlier such month with a
    value.

    Capacity is constant within a month, so carrying it forward over the
    generation rows equals carrying it over the months that hold rows.  The
    table has one row per key and month (small), so the window over a key's
    months stays cheap even for a key with a large share of the rows.
    """
    from pyspark.sql import Window

    keys = list(keys)
    m = align_capacity(gen_months, capacity, keys)
    w = Window.partitionBy(*keys).orderBy("year", "month").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(*keys, "year", "month", F.last("capacity_mwp", ignorenulls=True).over(w).alias("capacity_mwp"))


def generation_with_capacity(gen: DataFrame, capacity: DataFrame, keys: Sequence[str] = ("gsp_id",),
                             ts: str = "datetime_gmt", step_us: int = HALF_HOUR_US,
                             method: str = "interpolate", location_cols: Sequence[str] = ()) -> DataFrame:
    """K3: generation and monthly capacity on a complete ``step`` grid per key.

    UTC calendar parts (B8, B9); capacity by month (D3) carried forward over the
    generation rows (G3, done at month grain by :func:`carried_capacity`); grid
    min..max per key (G6, D4; rows off the grid are dropped); remaining gaps of
    generation and capacity filled linearly by position (G2,
    ``method="interpolate"``) or with 0 (B14, ``"zero"``) or left (``"none"``);
    location columns carried forward (G5); calendar parts recomputed.
    ``capacity`` has ``keys, install_month, year, month, cumul_capacity_mwp``.

    One shuffle of the generation rows by ``(keys, chunk)`` (chunks of ~256
    grid steps); the month
    capacity table joins in by broadcast when small (AQE decides at run time).
    """
    from gridpv.functions.columns import floor_div, to_utc_ntz, with_calendar

    keys = list(keys)
    chunk_us = series.chunk_for_step(step_us)
    # Rows without a key or a time have no place in a series: they go with every method.
    g = gen.withColumn(ts, to_utc_ntz(ts)).dropna(subset=[*keys, ts])
    months = g.select(*keys, F.year(ts).alias("year"), F.month(ts).alias("month")).distinct()
    cap = carried_capacity(months, capacity, keys)
    # Each (key, month) is repeated for the chunks the month overlaps (a handful),
    # so it can meet the rows on (keys, chunk), the partitioning they already have.
    n_h = chunk_us // series.HOUR_US
    first = F.make_date("year", "month", F.lit(1))
    h0 = F.unix_date(first).cast("long") * 24
    h1 = F.unix_date(F.add_months(first, 1)).cast("long") * 24 - 1
    cap = cap.select(*keys, (F.col("year") * 12 + F.col("month")).alias("_ym"), "capacity_mwp",
                     F.explode(F.sequence(floor_div(h0, n_h), floor_div(h1, n_h))).alias(CHUNK))

    loc = [c for c in location_cols if c in g.columns and c not in keys]
    data = g.select(*keys, ts, "generation_mw", *loc, F.lit(True).alias("_is_data"))
    r = series.regularize(data, keys, ts, step_us, chunk_us=chunk_us)
    # Equi-join on (keys, chunk) only; the month test stays a residual predicate
    # (one expression over both sides), so the rows are not shuffled again.
    rr, cc = r.alias("_r"), cap.alias("_c")
    cond = [F.col(f"_r.{k}") == F.col(f"_c.{k}") for k in keys + [CHUNK]]
    ym = F.year(F.col(f"_r.{ts}")) * 12 + F.month(F.col(f"_r.{ts}"))
    cond.append((ym - F.col("_c._ym")) == 0)
    r = rr.join(cc, cond, "left").select(
        *[F.col(f"_r.{c}") for c in r.columns if c != "_is_data"],
        F.when(F.col("_r._is_data"), F.col("_c.capacity_mwp")).alias("capacity_mwp"),
    )
    if method == "interpolate":
        r = series.fill_series(r, keys, ts, linear_interpolate=["generation_mw", "capacity_mwp"], forward_fill=loc)
    else:
        if loc:
            r = series.ffill(r, keys, ts, loc)
        if method == "zero":
            r = r.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("generation_mw", "capacity_mwp")})
    return with_calendar(r, ts)


def modelling_table(weather: DataFrame, gen_cap: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                    date: str = "date") -> DataFrame:
    """K5: weather rows (of any step) with the mean of generation and capacity of their hour (F1,
    D5), remaining gaps filled linearly by position (G2)."""
    keys = list(keys)
    hourly = series.to_hourly(gen_cap, keys, ts, ["generation_mw", "capacity_mwp"], out_ts=date)
    chunk = series.chunk_for_step(series.HOUR_US)
    x = series.merge_on_hour(weather.drop(CHUNK) if CHUNK in weather.columns else weather,
                             hourly.drop(CHUNK), keys, date, chunk_us=chunk)
    x = series.interpolate_linear(x, keys, date, ["generation_mw", "capacity_mwp"])
    return x.drop(CHUNK)
