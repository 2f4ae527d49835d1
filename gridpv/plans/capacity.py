"""Capacity pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.functions.columns import parse_ts, with_calendar
from gridpv.operators import capacity as cap
from gridpv.operators import clean


def capacity_with_locations(capacity: DataFrame, locations: DataFrame, known: DataFrame,
                            release: str | None = None) -> DataFrame:
    """K1: cleaned capacity rows with the location of their GSP (complete rows,
    known numeric ids, ``'unkown'`` removed)."""
    c = clean.clean_capacity(capacity, release)
    loc = clean.keep_known(locations, known)
    return clean.merge_locations(c, loc)


def capacity_calendar(merged: DataFrame, gsp_ids: Sequence[int] | None = None) -> DataFrame:
    """K4: capacity rows of the chosen GSPs (all when ``None``) with calendar parts."""
    x = merged if gsp_ids is None else merged.filter(F.col("gsp_id").isin(list(gsp_ids)))
    x = x.select("gsp_id", parse_ts("install_month").alias("install_month"), "cumul_capacity_mwp", "GSPs",
                 "gsp_lat", "gsp_lon", "region_name", "pes_id")
    return with_calendar(x, "install_month")


def location_map(merged: DataFrame, before: str | None = None) -> DataFrame:
    """K9: one row per GSP with location, label and latest installed capacity."""
    cells = cap.month_values(merged)
    if before is not None:
        cells = cells.filter(F.col(cap.M) < F.lit(before).cast("date"))
    locs = clean.gsp_locations(merged)
    return cap.latest_capacity(cells, locs)
