"""The data-quality report of a keyed series, as named lazy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridpv.operators import quality, series
from gridpv.operators.series import HALF_HOUR_US


def quality_report(df: DataFrame, keys: Sequence[str], ts: str = "datetime_gmt", value: str = "generation_mw",
                   step_us: int = HALF_HOUR_US, first_n: int = 20, period: tuple[str, str] | None = None
                   ) -> dict[str, DataFrame]:
    """Missing values per column (F10) and per month (F11), rows per month (F12),
    completeness per key (F13), grid slots without a row (D7, optionally within
    ``period``) and the first ``first_n`` incomplete rows (C13).  Nothing runs until
    a table is used."""
    keys = list(keys)
    lo, hi = period if period else (None, None)
    return {
        "null_profile": quality.null_profile(df),
        "nulls_by_month": quality.nulls_by_month(df, value, ts),
        "rows_by_month": quality.rows_by_month(df, ts),
        "completeness": quality.completeness(df, keys, ts, step_us, [value]),
        "missing_slots": series.missing_slots(df, keys, ts, step_us, lo, hi),
        "incomplete_rows": quality.incomplete_rows(df, first_n, [*keys, ts]),
    }
