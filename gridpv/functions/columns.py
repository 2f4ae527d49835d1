"""Scalar column builders: key normalisation, coercion, time handling, calendar parts.

Timestamps are ``TIMESTAMP_NTZ`` meaning UTC, so nothing here depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "EPOCH",
    "quote",
    "epoch_us_sql",
    "col_of",
    "norm_key",
    "coerce_int",
    "gsp_label",
    "parse_ts",
    "to_utc_ntz",
    "epoch_us",
    "from_epoch_seconds",
    "floor_div",
    "trunc_ntz",
    "with_calendar",
    "day_string",
    "month_string",
    "with_error",
    "round_to",
]

def EPOCH() -> Column:
    """1970-01-01 00:00:00 as TIMESTAMP_NTZ."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: str | Column) -> Column:
    """Text form, every leading/trailing whitespace removed, upper case.

    ``trim`` only strips spaces; Python's ``strip()`` strips all whitespace.
    """
    return F.upper(F.regexp_replace(col_of(c).cast("string"), r"^\s+|\s+$", ""))


def coerce_int(c: str | Column) -> Column:
    """Text to number (bad text becomes NULL), then truncation to int."""
    return col_of(c).cast("string").try_cast("double").cast("int")


def gsp_label(name: str | Column, region: str | Column) -> Column:
    """``"{GSPs} | {region_name}"``."""
    return F.concat(col_of(name).cast("string"), F.lit(" | "), col_of(region).cast("string"))


def parse_ts(c: str | Column) -> Column:
    """Text to TIMESTAMP_NTZ; NULL where the text does not parse (the reference then keeps the
    whole column as text; a distributed column has one type, so bad values become NULL)."""
    return col_of(c).cast("string").try_cast("timestamp_ntz")


def to_utc_ntz(c: str | Column, from_tz: str | None = None) -> Column:
    """Naive values are taken as UTC; values of a named zone are converted.

    An instant (TIMESTAMP) is converted from its epoch, whatever the session's zone; ``from_tz``
    does not apply to it.  The branch is chosen by the column's type when the plan is made.
    """
    c = col_of(c)
    naive = c.cast("timestamp_ntz")
    if from_tz is not None:
        naive = F.convert_timezone(F.lit(from_tz), F.lit("UTC"), naive)
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(c.cast("timestamp")), EPOCH())
    return F.when(F.typeof(c) == "timestamp", instant).otherwise(naive)


def quote(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


# Session time zone names that mean UTC (no offset, no daylight saving).
UTC_ZONES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "UCT", "Etc/UCT", "Universal",
             "Etc/Universal", "Zulu", "Etc/Zulu", "GMT0", "Etc/GMT0", "Etc/GMT+0", "Etc/GMT-0"}


def _session_is_utc() -> bool:
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    return s is not None and s.conf.get("spark.sql.session.timeZone") in UTC_ZONES


def epoch_us_sql(name: str) -> str:
    """SQL text of :func:`epoch_us` for a named column.

    In a UTC session the NTZ -> TIMESTAMP cast adds no offset and
    ``unix_micros`` is exact (and ~3x cheaper than the part arithmetic, whose
    fractional seconds need decimal maths).  The cast's zone is fixed when the
    expression is analysed, i.e. when it is used in a DataFrame step.
    """
    t = f"CAST({quote(name)} AS TIMESTAMP_NTZ)"
    if _session_is_utc():
        return f"unix_micros(CAST({t} AS TIMESTAMP))"
    return (f"(unix_date(CAST({t} AS DATE)) * 86400000000L + hour({t}) * 3600000000L"
            f" + minute({t}) * 60000000L + CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT))")


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (bigint).

    Built from the date and the time-of-day parts, which do not involve the
    session time zone (``timestamp_diff`` would cast NTZ to the session zone,
    and a zone with daylight saving would shift the arithmetic).  For a named
    column the expression is one SQL snippet (one call into the JVM instead of
    about twenty).
    """
    if isinstance(ts, str):
        return F.expr(epoch_us_sql(ts))
    t = ts.cast("timestamp_ntz")
    if _session_is_utc():
        return F.unix_micros(t.cast("timestamp"))
    days = F.unix_date(t.cast("date")).cast("long")
    sec = F.extract(F.lit("SECOND"), t)  # decimal(8,6): seconds with fraction
    return (
        days * F.lit(86_400_000_000)
        + F.hour(t).cast("long") * F.lit(3_600_000_000)
        + F.minute(t).cast("long") * F.lit(60_000_000)
        + (sec * F.lit(1_000_000)).cast("long")
    )


def from_epoch_seconds(c: str | Column) -> Column:
    """Epoch seconds to a UTC TIMESTAMP_NTZ."""
    return F.timestamp_add("SECOND", col_of(c).cast("long"), EPOCH())


def floor_div(a: Column, b: int) -> Column:
    """Floor division of a bigint by a positive constant.

    ``a - pmod(a, b)`` is an exact multiple of ``b``, so the integral division is exact.
    """
    b = int(b)
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def trunc_ntz(ts: str | Column, unit: str) -> Column:
    """Truncate a TIMESTAMP_NTZ to ``second|minute|hour|day|month|year``, staying NTZ."""
    ts = col_of(ts)
    if unit in ("month", "year"):
        return F.trunc(ts, unit).cast("timestamp_ntz")
    step = _US[unit]
    return F.timestamp_add("MICROSECOND", floor_div(epoch_us(ts), step) * F.lit(step), EPOCH())


def with_calendar(df: DataFrame, ts: str = "datetime_gmt", prefix: str = "") -> DataFrame:
    """``year, month, day, hour`` from a timestamp (ints)."""
    t = F.col(ts)
    return df.withColumns(
        {
            f"{prefix}year": F.year(t),
            f"{prefix}month": F.month(t),
            f"{prefix}day": F.dayofmonth(t),
            f"{prefix}hour": F.hour(t),
        }
    )


def day_string(ts: str | Column) -> Column:
    """Day as ``YYYY-MM-DD``."""
    return F.date_format(col_of(ts), "yyyy-MM-dd")


def month_string(ts: str | Column) -> Column:
    """Month as ``YYYY-MM``."""
    return F.date_format(col_of(ts), "yyyy-MM")


def with_error(df: DataFrame, actual: str = "generation_mw", pred: str = "pred_generation_mw",
               out: str = "difference") -> DataFrame:
    """``difference = predicted - actual``."""
    return df.withColumn(out, F.col(pred) - F.col(actual))


def round_to(c: str | Column, places: int = 6) -> Column:
    """Round to ``places`` decimals as ``round(x * 10^p) / 10^p``.

    The scaled value is rounded half away from zero and divided back, the same
    IEEE steps in every engine, so ties (e.g. x.xxxxxx5 from halving) come out
    the same everywhere; ``round(x, p)`` resolves such ties from the decimal
    text in one engine and from the binary value in another.
    """
    scale = float(10 ** places)
    return F.round(col_of(c) * F.lit(scale)) / F.lit(scale)
