"""Capacity and location cleaning, merge, dedupe, id filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpv.operators.joins import small_side
from gridpv.functions.columns import coerce_int, gsp_label, norm_key

LOCATION_FIELDS = ["gsp_id", "gsp_lat", "gsp_lon", "region_name", "pes_id"]


def clean_capacity(df: DataFrame, release: str | None = None) -> DataFrame:
    """B1-B3 + C1: release column first, ``dc_capacity_MWp`` renamed, ``system_count``
    as nullable long, rows with any missing value dropped."""
    if release is not None:
        df = df.select(F.lit(release).alias("release"), *[F.col(c) for c in df.columns])
    if "dc_capacity_MWp" in df.columns:
        df = df.withColumnRenamed("dc_capacity_MWp", "dc_capacity_mwp")
    if "system_count" in df.columns:
        df = df.withColumn("system_count", F.col("system_count").cast("long"))
    return drop_incomplete(df)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (NaN counts as missing)."""
    from gridpv.schemas import clean_nans

    return clean_nans(df).na.drop("any")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  cols: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key in ``order``.

    An aggregate (``min_by`` on a struct), so it pre-aggregates map-side and a
    hot key never lands in one task; ``order`` must be unique within a key.
    """
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    ordv = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ordv).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def keep_known(locations: DataFrame, known: DataFrame, col: str = "gsp_id") -> DataFrame:
    """B4 + C6: numeric ids only (bad text dropped, truncated to int), and only ids
    the generation source knows (left semi join)."""
    x = locations.withColumn(col, coerce_int(col)).filter(F.col(col).isNotNull())
    return x.join(known.select(F.col(col).cast("int").alias(col)), col, "left_semi")


def unknown_ids(requests: DataFrame, locations: DataFrame, col: str = "gsp_id") -> DataFrame:
    """Requested ids absent from the locations (left anti join)."""
    return requests.join(locations.select(col).distinct(), col, "left_anti")


def exclude_national(df: DataFrame, col: str = "gsp_id", include_national: bool = False) -> DataFrame:
    """Id 0 is the national total; kept only when asked."""
    return df.filter(F.col(col) >= F.lit(0 if include_national else 1))


def merge_locations(capacity: DataFrame, locations: DataFrame, left_col: str = "GSPs",
                    right_col: str = "gsp_name", order: Sequence[str] = ("row_ord",)) -> DataFrame:
    """Capacity x location on a normalised name.

    The location side is deduplicated on the key (first row in ``order``),
    left-joined, then rows with any missing value and the ``'unkown'`` name are
    dropped.  The dedupe leaves at most one row per name, so the join side is
    bounded by the number of locations.
    """
    loc = locations.withColumn("_gsp_key", norm_key(right_col))
    loc = first_per_key(loc, ["_gsp_key"], list(order), cols=LOCATION_FIELDS)
    merged = capacity.withColumn("_gsp_key", norm_key(left_col)).join(loc, "_gsp_key", "left")
    merged = drop_incomplete(merged)
    merged = merged.filter(F.col(left_col) != F.lit("unkown"))
    return merged.drop("_gsp_key")


def gsp_locations(merged: DataFrame, gsp_col: str = "GSPs", order: str = "install_month") -> DataFrame:
    """E2 + B6: one row per GSP name with its location and ``GSP_region`` label."""
    first = first_per_key(merged, [gsp_col], [order], cols=LOCATION_FIELDS)
    return first.withColumn("GSP_region", gsp_label(gsp_col, "region_name"))


def attach_location(gen: DataFrame, locations: DataFrame, col: str = "gsp_id") -> DataFrame:
    """Generation left join location columns on the id."""
    loc = locations.drop(*[c for c in ("row_ord",) if c in locations.columns])
    return gen.join(small_side(loc), col, "left")


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values, missing removed."""
    return df.select(*cols).na.drop("any").distinct()


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """Append by column name (empty frames add nothing)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
