"""Dashboard aggregates.

pandas ``resample`` emits every period between a series' first and last one;
sums over an empty period are 0 and means are missing.  Here: aggregate, then
left-join onto a per-key calendar generated by :func:`time_grid`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.operators.joins import small_side
from gridpv.functions.columns import trunc_ntz
from gridpv.operators.series import CHUNK, DAY_US, HOUR_US, time_grid


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    unit: str,
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    out_ts: str | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Per key and ``unit`` (``hour|day``) period: sums (0 when empty) and means.

    Every period between the key's first and last period is present.
    """
    keys = list(keys)
    out_ts = out_ts or ts
    names = names or {}
    step = {"hour": HOUR_US, "day": DAY_US}[unit]
    period = trunc_ntz(F.col(ts), unit).alias(out_ts)
    agg = df.groupBy(*keys, period).agg(
        *[F.sum(c).alias(names.get(c, c)) for c in sums],
        *[F.avg(c).alias(names.get(c, c)) for c in means],
    )
    cal = time_grid(agg, keys, out_ts, step_us=step).drop(CHUNK)
    out = cal.join(agg, keys + [out_ts], "left")
    return out.select(
        *keys,
        out_ts,
        *[F.coalesce(F.col(names.get(c, c)), F.lit(0.0)).alias(names.get(c, c)) for c in sums],
        *[F.col(names.get(c, c)) for c in means],
    )


def daily_profile(df: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                  actual: str = "generation_mw", pred: str | None = "pred_generation_mw",
                  irradiance: str | None = "global_tilted_irradiance_instant") -> DataFrame:
    """daily sum of actual and predicted generation, mean irradiance."""
    sums = [actual] + ([pred] if pred else [])
    means = [irradiance] if irradiance else []
    return resample(df, keys, ts, "day", sums, means, out_ts="date",
                    names={actual: "actual_generation_mw"})


def hourly_profile(df: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                   actual: str = "generation_mw", pred: str | None = "pred_generation_mw",
                   irradiance: str | None = "global_tilted_irradiance_instant") -> DataFrame:
    """hourly sum of actual and predicted generation, mean irradiance."""
    sums = [actual] + ([pred] if pred else [])
    means = [irradiance] if irradiance else []
    return resample(df, keys, ts, "hour", sums, means, out_ts="hour",
                    names={actual: "actual_generation_mw"})


def last_period(df: DataFrame, keys: Sequence[str], ts: str, unit: str) -> DataFrame:
    """C11 (``month``) / C12 (``day``): the rows in each key's last period.

    The per-key maximum is an aggregate (partial, skew-safe) of one row per key, joined back as a
    small side; the earliest period of all keys bounds the scan.
    C12's fallback to the previous day cannot trigger: the last day always holds
    the row that defined it.
    """
    keys = list(keys)
    last = small_side(df.groupBy(*keys).agg(trunc_ntz(F.max(ts), unit).alias("_last_p")))
    bound = last.select(F.min("_last_p")).scalar()
    rows = df.filter(F.col(ts) >= bound)
    joined = rows.join(last, keys) if keys else rows.crossJoin(last)  # one row without keys
    return (
        joined
        .filter(trunc_ntz(F.col(ts), unit) == F.col("_last_p"))
        .drop("_last_p")
    )


def kpis(df: DataFrame, keys: Sequence[str], actual: str = "generation_mw",
         pred: str = "pred_generation_mw") -> DataFrame:
    """totals and variance % = (pred - act) / act * 100, NULL when act = 0."""
    keys = list(keys)
    a = F.coalesce(F.sum(actual), F.lit(0.0))
    p = F.coalesce(F.sum(pred), F.lit(0.0))
    agg = df.groupBy(*keys).agg(a.alias("total_generation_mw"), p.alias("total_predicted_generation_mw"))
    act = F.col("total_generation_mw")
    var = (F.col("total_predicted_generation_mw") - act) / F.nullif(act, F.lit(0.0)) * F.lit(100.0)
    return agg.withColumn("percent_variance", var)


def error_heatmap(df: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                  diff: str = "difference", time_bin_us: int = DAY_US, diff_bin: float = 10.0) -> DataFrame:
    """2-D bins of time x difference, value = sum of difference, row count."""
    keys = list(keys)
    from gridpv.functions.columns import EPOCH, epoch_us, floor_div

    tb = F.timestamp_add("MICROSECOND", floor_div(epoch_us(F.col(ts)), time_bin_us) * F.lit(time_bin_us), EPOCH())
    db = F.floor(F.col(diff) / F.lit(diff_bin)) * F.lit(diff_bin)
    return (
        df.filter(F.col(diff).isNotNull())
        .groupBy(*keys, tb.alias("time_bin"), db.alias("difference_bin"))
        .agg(F.sum(diff).alias("sum_difference"), F.count(F.lit(1)).alias("n"))
    )


def since(df: DataFrame, ts: str, start: str) -> DataFrame:
    """Rows on or after ``start``."""
    return df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))

