"""Weather payloads to rows and weather request specs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.functions.columns import day_string, with_calendar
from gridpv.schemas import WEATHER_VARIABLES


def explode_weather(payload: DataFrame, keys: Sequence[str], variables: Sequence[str] = WEATHER_VARIABLES,
                    ts: str = "date") -> DataFrame:
    """One row per grid time ``time + k*interval < time_end``; each array is cut
    to the grid length (positions past an array's end are NULL); float values
    become double; calendar parts added (B9)."""
    from gridpv.functions.columns import quote

    keys = list(keys)
    # Grid length: ceil((time_end - time) / interval); one SQL text per column
    # keeps the plan-building calls few.
    n = "CAST((time_end - time + CAST(`interval` AS BIGINT) - 1) div CAST(`interval` AS BIGINT) AS INT)"
    x = payload.select(
        *keys, "time", "interval", *variables,
        F.expr(f"explode(CASE WHEN {n} > 0 THEN sequence(0, {n} - 1) END)").alias("_k"),
    )
    t = "timestampadd(SECOND, time + CAST(_k AS BIGINT) * CAST(`interval` AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    out = x.select(
        *keys,
        F.expr(t).alias(ts),
        *[F.expr(f"CAST(try_element_at({quote(v)}, _k + 1) AS DOUBLE)").alias(v) for v in variables],
    )
    return with_calendar(out, ts)


def weather_requests(gen: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt",
                     lat: str = "gsp_lat", lon: str = "gsp_lon") -> DataFrame:
    """Per key, lat/lon of the first row (in time) where both are present, and the
    first and last day as ``YYYY-MM-DD``.  One aggregate, partial map-side."""
    keys = list(keys)
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    agg = gen.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(lat).alias("latitude"), F.col(lon).alias("longitude")),
                 F.when(both, F.col(ts))).alias("_ll"),
        F.min(ts).alias("_lo"),
        F.max(ts).alias("_hi"),
    )
    return agg.select(
        *keys, "_ll.latitude", "_ll.longitude",
        day_string("_lo").alias("start_date"), day_string("_hi").alias("end_date"),
    )
