"""Explicit schemas of the sources and the missing-value rule (§1.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hourly weather variables requested by the reference, in its order.
WEATHER_VARIABLES = [
    "shortwave_radiation",
    "direct_radiation",
    "diffuse_radiation",
    "direct_normal_irradiance",
    "global_tilted_irradiance",
    "shortwave_radiation_instant",
    "direct_radiation_instant",
    "diffuse_radiation_instant",
    "direct_normal_irradiance_instant",
    "global_tilted_irradiance_instant",
]

# Location columns carried forward onto new grid rows (K3).
LOCATION_COLUMNS = ["gsp_id", "GSPs", "gsp_lat", "gsp_lon", "region_name", "pes_id", "GSP_region"]

GENERATION_SCHEMA = T.StructType(
    [
        T.StructField("gsp_id", T.IntegerType()),
        T.StructField("datetime_gmt", T.TimestampNTZType()),
        T.StructField("generation_mw", T.DoubleType()),
    ]
)


def weather_payload_schema(variables: list[str] = WEATHER_VARIABLES) -> T.StructType:
    fields = [
        T.StructField("gsp_id", T.IntegerType()),
        T.StructField("time", T.LongType()),
        T.StructField("time_end", T.LongType()),
        T.StructField("interval", T.IntegerType()),
    ]
    fields += [T.StructField(v, T.ArrayType(T.FloatType())) for v in variables]
    return T.StructType(fields)


def nan_to_null(c: Column) -> Column:
    """pandas marks missing as NaN; the engine uses NULL everywhere."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clean_nans(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every floating column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
