"""Column expression builders. All JVM-side, no Python UDFs."""

from gridpv.functions.columns import (  # noqa: F401
    EPOCH,
    coerce_int,
    col_of,
    day_string,
    epoch_us,
    floor_div,
    from_epoch_seconds,
    gsp_label,
    month_string,
    norm_key,
    parse_ts,
    round_to,
    to_utc_ntz,
    trunc_ntz,
    with_calendar,
    with_error,
)
