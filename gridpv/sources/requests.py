"""Request validation and label lookup, as columns over request tables.

The reference validates one request and raises; here every request gets a
``status`` (``'ok'`` or the reference's error text).  :func:`validate_period`
keeps the single-call, raising form.
"""

from __future__ import annotations

import datetime as _dt

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Error texts of the reference's validation and lookup.
END_BEFORE_START = "End date must not be before start date."
SPAN_TOO_SHORT = "End date must be at least {m} month(s) after start date."
NO_LABEL = "No GSP_region provided."
NOT_FOUND = "GSP_region '{label}' not found."
NOT_INT = "gsp_id for '{label}' is not convertible to int: {gsp_id}"


def validate_periods(requests: DataFrame, start: str = "start_date", end: str = "end_date",
                     min_months: int = 1) -> DataFrame:
    """``start_dt`` = start 00:00, ``end_dt`` = end 23:30 (UTC), and ``status``."""
    s = F.col(start).cast("date").cast("timestamp_ntz")
    e = F.timestamp_add("MINUTE", F.lit(23 * 60 + 30), F.col(end).cast("date").cast("timestamp_ntz"))
    x = requests.withColumns({"start_dt": s, "end_dt": e})
    status = (
        F.when(F.col("end_dt") < F.col("start_dt"), F.lit(END_BEFORE_START))
        .when(F.col("end_dt") < F.timestamp_add("MONTH", F.lit(min_months), F.col("start_dt")),
              F.lit(SPAN_TOO_SHORT.format(m=min_months)))
        .otherwise(F.lit("ok"))
    )
    return x.withColumn("status", status)


def validate_period(start: _dt.date, end: _dt.date, min_months: int = 1) -> tuple[_dt.datetime, _dt.datetime]:
    """C3, single call: the bounds, or ``ValueError`` with the reference's text."""
    first = pd.Timestamp(start).normalize()
    last = pd.Timestamp(end).normalize() + pd.Timedelta(hours=23, minutes=30)
    if last < first:
        raise ValueError(END_BEFORE_START)
    if last < first + pd.DateOffset(months=min_months):
        raise ValueError(SPAN_TOO_SHORT.format(m=min_months))
    return first.to_pydatetime(), last.to_pydatetime()


def resolve_labels(requests: DataFrame, locations: DataFrame, label: str = "gsp_region",
                   order: str = "GSPs") -> DataFrame:
    """``gsp_id`` (int) of the first location whose ``GSP_region`` equals the
    request's label, with ``status``.  The location list is one row per GSP."""
    loc = locations.groupBy(F.col("GSP_region").alias("_label")).agg(
        F.min_by(F.col("gsp_id").cast("string"), F.col(order)).alias("_raw_id")
    )
    x = requests.join(loc, F.col(label) == F.col("_label"), "left")
    as_int = F.col("_raw_id").try_cast("double")
    ok_int = as_int.isNotNull() & (as_int == F.floor(as_int))
    status = (
        F.when(F.col(label).isNull(), F.lit(NO_LABEL))
        .when(F.col("_label").isNull(), F.format_string(NOT_FOUND.replace("{label}", "%s"), F.col(label)))
        .when(~ok_int, F.format_string(NOT_INT.replace("{label}", "%s").replace("{gsp_id}", "%s"),
                                       F.col(label), F.col("_raw_id")))
        .otherwise(F.lit("ok"))
    )
    return x.select(
        *requests.columns,
        F.when(status == "ok", as_int.cast("int")).alias("gsp_id"),
        status.alias("status"),
    )
