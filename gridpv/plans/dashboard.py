"""Dashboard tables on a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.functions.columns import month_string, with_error
from gridpv.operators import report, series


def last_month_daily(scored: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt") -> DataFrame:
    """K6: each key's last calendar month (C11), daily profile (F2), ``YYYY-MM`` label."""
    x = report.last_period(scored, keys, ts, "month")
    d = report.daily_profile(x, keys, ts)
    return d.withColumn("period", month_string("date"))


def last_day_hourly(scored: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt") -> DataFrame:
    """K7: each key's last day (C12), hourly profile."""
    x = report.last_period(scored, keys, ts, "day")
    return report.hourly_profile(x, keys, ts)


def kpi_row(scored: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt", n: int = 50,
            tiebreak: Sequence[str] = ()) -> DataFrame:
    """K8: totals and variance (F6) with the capacity of the n-th row from the end."""
    keys = list(keys)
    k = report.kpis(scored, keys)
    c = series.nth_from_end(scored.select(*keys, ts, *tiebreak, "capacity_mwp"), keys, ts, n, tiebreak)
    return k.join(c.select(*keys, F.col("capacity_mwp").alias("last_capacity_mwp")), keys, "left")


def error_heatmap(scored: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                  time_bin_us: int = series.DAY_US, diff_bin: float = 10.0) -> DataFrame:
    """difference = predicted - actual (B13), binned by time and difference."""
    return report.error_heatmap(with_error(scored), keys, ts, "difference", time_bin_us, diff_bin)
