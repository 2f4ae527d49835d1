"""Time-series operators keyed by a list of columns.

Skew: one key may hold a large share of all rows, so no operator here puts a
whole key into one window partition.  Rows are partitioned by ``(keys,
chunk)``, where ``chunk`` is a fixed-width time bucket (one day by default).
Each chunk is windowed on its own; a small per-chunk summary (one row per key
and chunk) is windowed per key to carry row offsets and the nearest present
rows across chunk borders, then joined back.  Results equal a window over the
whole key (row distances count rows, not time, across chunks too).

"Next present value" is computed with a descending window and
``last(ignorenulls)`` over unbounded-preceding frames, never with a frame to
unbounded following (that frame is quadratic per partition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpv.functions.columns import EPOCH, epoch_us, epoch_us_sql, floor_div, quote, trunc_ntz
from gridpv.operators.joins import small_side

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HALF_HOUR_US = 30 * MINUTE_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

CHUNK = "_chunk"
DEFAULT_CHUNK_US = DAY_US
#: Rows of a dense chunk that one task numbers when only its last few are wanted.
PART_ROWS = 65_536

_U = Window.unboundedPreceding
_C = Window.currentRow


def chunk_for_step(step_us: int, rows: int = 256) -> int:
    """A chunk width holding about ``rows`` steps of a regular series, in whole
    hours (at least one).  The chunk summary then has ~1/rows of the rows, and no
    chunk holds more than ~rows rows of one key.  Results do not depend on it."""
    return max(1, -(-int(step_us) * rows // HOUR_US)) * HOUR_US


def with_chunk(df: DataFrame, ts: str, chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Add the time bucket used to split keys into bounded partitions.

    Widths are whole hours, so an hour never straddles two chunks (the hourly
    mean groups by the chunk to keep the partitioning).
    """
    if chunk_us <= 0 or chunk_us % HOUR_US:
        raise ValueError("chunk width must be a positive number of whole hours")
    if CHUNK in df.columns:
        return df
    # Hours since the epoch from the date and the hour: integer-only and free of
    # the session time zone.  (h - pmod(h, n)) is a multiple of n, so `div` is
    # exact floor division.
    t = f"CAST({quote(ts)} AS TIMESTAMP_NTZ)"
    h = f"(unix_date(CAST({t} AS DATE)) * 24L + hour({t}))"
    n = chunk_us // HOUR_US
    return df.withColumn(CHUNK, F.expr(f"({h} - pmod({h}, {n}L)) div {n}L"))


def bounded_chunks(df: DataFrame, keys: Sequence[str], ts: str, rows: int = 100_000,
                   chunk_us: int = DEFAULT_CHUNK_US, slices: int = 256) -> DataFrame:
    """``df`` with chunks of at most about ``rows`` rows of a key, for dense irregular series.

    Time buckets are counted; those with more rows are cut at approximate quantiles of their times, again
    and again until none is too large.  Only rows of one instant stay together.  Chunks ascend with time
    within a key, which is all that ordered passes need, so results do not depend on the cuts; the cuts are
    kept in a checkpoint, so that every use of the rows sees the same ones.  An hour may be
    split: drop the chunk column before hourly means.
    """
    from gridpv.session import checkpoint_dir

    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    x = with_chunk(df, ts, chunk_us)
    group = [*keys, CHUNK]
    t = epoch_us_sql(ts)
    shares = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    while True:
        counted = x.dropna(subset=group).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.expr(f"min({t}) AS _lo"), F.expr(f"max({t}) AS _hi"))
        large = counted.filter((F.col("_n") > rows) & (F.col("_lo") < F.col("_hi"))).select(*group).checkpoint()
        n = large.count()
        if not n:
            return x
        side = F.broadcast if n <= 4096 else (lambda d: d)
        cuts = x.join(side(large), group).groupBy(*group).agg(F.expr(f"array_distinct(percentile_approx({t}, array({shares}), 10000)) AS _cuts"))
        cuts = cuts.checkpoint()
        # the instant of a cut is a slice of its own, so that every round takes something apart
        nth = f"coalesce(size(filter(_cuts, c -> c < {t})) + size(filter(_cuts, c -> c <= {t})), 0)"
        x = x.join(side(cuts), group, "left").withColumn(CHUNK, F.expr(f"{CHUNK} * {2 * slices}L + {nth}")).select(*x.columns)


def _order_cols(ts: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(ts)] + [F.col(c) for c in tiebreak]


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    specs: Mapping[str, tuple[str, Mapping[str, str]]],
    tiebreak: Sequence[str] = (),
    chunk_us: int = DEFAULT_CHUNK_US,
) -> DataFrame:
    """Row index and nearest present rows, per key, in ``(ts, *tiebreak)`` order.

    Adds ``_rn`` (1-based row number within the key), ``_cnt`` (rows in the
    key) and, for every ``name -> (present, fields)`` of ``specs`` (SQL text),
    two struct columns ``{name}_prev`` / ``{name}_next``: the nearest row at or
    before / at or after the current one where ``present`` holds, with fields
    ``rl`` (its ``_rn``) and ``fields`` evaluated on that row.  NULL when none
    exists.  Expressions are SQL text so that building the plan takes few calls
    into the JVM.
    """
    keys = list(keys)
    x = with_chunk(df, ts, chunk_us)
    part = ", ".join(quote(c) for c in keys + [CHUNK])
    kpart = ", ".join(quote(c) for c in keys) or "1"  # no keys: the table is one series
    order = [ts, *tiebreak]
    asc = ", ".join(f"{quote(o)} ASC NULLS FIRST" for o in order)
    desc = ", ".join(f"{quote(o)} DESC NULLS LAST" for o in order)
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    w_fwd = f"(PARTITION BY {part} ORDER BY {asc} {run})"
    w_bwd = f"(PARTITION BY {part} ORDER BY {desc} {run})"
    w_k = f"(PARTITION BY {kpart} ORDER BY {quote(CHUNK)} ASC {before})"
    w_kd = f"(PARTITION BY {kpart} ORDER BY {quote(CHUNK)} DESC {before})"

    # Rows without a key or a time have no place in a series (pandas drops
    # missing group keys).  Filtering here also keeps both uses of ``x`` (rows
    # and chunk summary) identical, so they share one shuffle.
    notnull = " AND ".join(f"{quote(c)} IS NOT NULL" for c in keys + [CHUNK])
    x = x.filter(F.expr(notnull)).select(
        "*", F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY {asc})").alias("_rl"))

    def struct(rl: str, src: str | None, fields: Mapping[str, str]) -> str:
        vals = [f"'{k}', {v if src is None else f'{src}.{k}'}" for k, v in fields.items()]
        return f"named_struct('rl', {rl}, {', '.join(vals)})" if vals else f"named_struct('rl', {rl})"

    def glob(c: str, fields: Mapping[str, str]) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN {struct(f'{c}.rl + _off', c, fields)} END"

    x = x.select("*", *[F.expr(f"CASE WHEN {present} THEN {struct('_rl', None, fields)} END").alias(f"_{n}_pay")
                        for n, (present, fields) in specs.items()])
    x = x.select(
        "*",
        *[F.expr(f"last(_{n}_pay, true) OVER {w_fwd}").alias(f"_{n}_pl") for n in specs],
        *[F.expr(f"last(_{n}_pay, true) OVER {w_bwd}").alias(f"_{n}_nl") for n in specs],
    )

    # One row per (key, chunk): row count, first and last present payloads.
    # rl is the first struct field and unique, so max/min pick last/first.
    aggs = [F.expr("count(1)").alias("_n")]
    for n in specs:
        aggs += [F.expr(f"max(_{n}_pay)").alias(f"_{n}_max"), F.expr(f"min(_{n}_pay)").alias(f"_{n}_min")]
    s = x.groupBy(*keys, CHUNK).agg(*aggs)
    s = s.select(
        *keys, CHUNK, *[f"_{n}_{m}" for n in specs for m in ("max", "min")],
        F.expr(f"coalesce(sum(_n) OVER {w_k}, 0L)").alias("_off"),
        F.expr(f"sum(_n) OVER (PARTITION BY {kpart})").alias("_cnt"),
    )
    s = s.select(
        *keys, CHUNK, "_off", "_cnt",
        *[F.expr(f"last({glob(f'_{n}_max', f)}, true) OVER {w_k}").alias(f"_{n}_pc") for n, (_, f) in specs.items()],
        *[F.expr(f"last({glob(f'_{n}_min', f)}, true) OVER {w_kd}").alias(f"_{n}_nc") for n, (_, f) in specs.items()],
    )

    out = x.join(s, keys + [CHUNK], "inner")
    internal = {"_rl", "_off"} | {f"_{n}_{d}" for n in specs for d in ("pay", "pl", "nl", "pc", "nc")}
    keep = [c for c in x.columns if c not in internal] + ["_cnt"]
    res = [F.expr("_rl + _off").alias("_rn")]
    for n, (_, f) in specs.items():
        res.append(F.expr(f"coalesce({glob(f'_{n}_pl', f)}, _{n}_pc)").alias(f"{n}_prev"))
        res.append(F.expr(f"coalesce({glob(f'_{n}_nl', f)}, _{n}_nc)").alias(f"{n}_next"))
    return out.select(*keep, *res)


def row_index(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = (),
              chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Skew-safe ``row_number()`` per key (``_rn``) and key size (``_cnt``)."""
    return neighbours(df, keys, ts, {}, tiebreak, chunk_us)


def fill_series(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    time_interpolate: Sequence[str] = (),
    linear_interpolate: Sequence[str] = (),
    forward_fill: Sequence[str] = (),
    forward_back_fill: Sequence[str] = (),
    limit: int | None = None,
    tiebreak: Sequence[str] = (),
    chunk_us: int = DEFAULT_CHUNK_US,
    keep_index: bool = False,
    max_chunk_rows: int | None = None,
) -> DataFrame:
    """All per-key gap fills of one table in a single ordered pass.

    * ``time_interpolate`` (G1): two-sided, x = time; with ``limit`` a missing
      row is filled only if it lies within ``limit`` rows of the previous or
      of the next present row, and then on the line through both of them.
    * ``linear_interpolate`` (G2): x = row position, edges copy the nearest
      value; ``limit`` applies the same way when given.
    * ``forward_fill`` (G3), ``forward_back_fill`` (G4).

    ``max_chunk_rows`` bounds the rows of a key in one window (:func:`bounded_chunks`), for series whose time
    buckets may be dense; the chunk column is then left out of the result.
    """
    if max_chunk_rows:
        df = bounded_chunks(df.drop(CHUNK), keys, ts, max_chunk_rows, chunk_us)
    specs: dict[str, tuple[str, dict[str, str]]] = {}
    for c in list(time_interpolate):
        specs[c] = (f"{quote(c)} IS NOT NULL", {"v": quote(c), "t": epoch_us_sql(ts)})
    for c in list(linear_interpolate) + list(forward_fill) + list(forward_back_fill):
        specs.setdefault(c, (f"{quote(c)} IS NOT NULL", {"v": quote(c)}))
    x = neighbours(df, keys, ts, specs, tiebreak, chunk_us)
    new = {}
    for c in time_interpolate:
        new[c] = _fill_two_sided_sql(c, limit, x_i=epoch_us_sql(ts), field="t")
    for c in linear_interpolate:
        new[c] = _fill_two_sided_sql(c, limit, x_i="_rn", field="rl")
    for c in forward_fill:
        new[c] = f"coalesce({quote(c)}, {quote(c + '_prev')}.v)"
    for c in forward_back_fill:
        new[c] = f"coalesce({quote(c)}, {quote(c + '_prev')}.v, {quote(c + '_next')}.v)"
    drop = {f"{c}_{d}" for c in specs for d in ("prev", "next")}
    if max_chunk_rows:
        drop.add(CHUNK)
    if not keep_index:
        drop |= {"_rn", "_cnt"}
    return x.select(*[F.expr(new[c]).alias(c) if c in new else F.col(c) for c in x.columns if c not in drop])


def _fill_two_sided_sql(c: str, limit: int | None, *, x_i: str, field: str) -> str:
    """The fill of column ``c`` from its ``_prev``/``_next`` neighbours (SQL text):
    ``v_p + (v_q - v_p) * (x_i - x_p) / (x_q - x_p)`` inside the limit, the single
    neighbour at an edge, NULL otherwise."""
    v, p, q = quote(c), quote(c + "_prev"), quote(c + "_next")
    if limit is None:
        ok = f"({p} IS NOT NULL OR {q} IS NOT NULL)"
    else:
        ok = f"(({p} IS NOT NULL AND _rn - {p}.rl <= {int(limit)}) OR ({q} IS NOT NULL AND {q}.rl - _rn <= {int(limit)}))"
    line = f"{p}.v + try_divide(({q}.v - {p}.v) * ({x_i} - {p}.{field}), {q}.{field} - {p}.{field})"
    return (f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN NOT {ok} THEN NULL "
            f"WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN {line} "
            f"WHEN {p} IS NOT NULL THEN {p}.v ELSE {q}.v END")


def interpolate_time(df: DataFrame, keys: Sequence[str], ts: str, cols: str | Sequence[str],
                     limit: int | None = 12, tiebreak: Sequence[str] = (),
                     chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """G1: bounded two-sided time interpolation per key."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return fill_series(df, keys, ts, time_interpolate=cols, limit=limit, tiebreak=tiebreak,
                       chunk_us=chunk_us)


def interpolate_linear(df: DataFrame, keys: Sequence[str], ts: str, cols: str | Sequence[str],
                       limit: int | None = None, tiebreak: Sequence[str] = (),
                       chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Linear interpolation by row position, edges held constant."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return fill_series(df, keys, ts, linear_interpolate=cols, limit=limit, tiebreak=tiebreak,
                       chunk_us=chunk_us)


def ffill(df: DataFrame, keys: Sequence[str], ts: str, cols: str | Sequence[str],
          tiebreak: Sequence[str] = (), chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Forward fill per key."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return fill_series(df, keys, ts, forward_fill=cols, tiebreak=tiebreak, chunk_us=chunk_us)


def ffill_bfill(df: DataFrame, keys: Sequence[str], ts: str, cols: str | Sequence[str],
                tiebreak: Sequence[str] = (), chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Forward fill, then back fill what is still missing."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return fill_series(df, keys, ts, forward_back_fill=cols, tiebreak=tiebreak, chunk_us=chunk_us)


# --------------------------------------------------------------------------- grids


def _ceil_div(a: Column, b: int) -> Column:
    return -floor_div(-a, b)


def time_grid(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_us: int = HALF_HOUR_US,
    lo: str | None = None,
    hi: str | None = None,
    chunk_us: int = DEFAULT_CHUNK_US,
) -> DataFrame:
    """Per key, every ``min + k*step`` up to ``max`` (or between ``lo`` and ``hi``).

    Built in two levels so no key's grid is materialised in one array: one row
    per (key, chunk) is generated from the key's extent, spread by
    ``(keys, chunk)``, and each chunk then expands only its own slots.
    Returns ``keys, ts, _chunk``.
    """
    keys = list(keys)
    if lo is None or hi is None:
        ext = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    else:
        ext = df.select(*keys).distinct().withColumns(
            {"_lo": F.lit(lo).cast("timestamp_ntz"), "_hi": F.lit(hi).cast("timestamp_ntz")}
        )
    ext = ext.filter(F.col("_lo").isNotNull()).select(
        *keys, epoch_us("_lo").alias("_lo"), epoch_us("_hi").alias("_hi")
    )
    c = F.col(CHUNK)
    chunks = ext.select(
        *keys, "_lo", "_hi",
        F.explode(F.sequence(floor_div(F.col("_lo"), chunk_us), floor_div(F.col("_hi"), chunk_us))).alias(CHUNK),
    ).repartition(*keys, CHUNK)
    start = c * F.lit(chunk_us)
    k0 = F.greatest(F.lit(0).cast("long"), _ceil_div(start - F.col("_lo"), step_us))
    k1 = floor_div(F.least(F.col("_hi"), start + F.lit(chunk_us - 1)) - F.col("_lo"), step_us)
    slots = chunks.select(*keys, CHUNK, "_lo", F.explode(F.when(k0 <= k1, F.sequence(k0, k1))).alias("_k"))
    return slots.select(
        *keys,
        F.timestamp_add("MICROSECOND", F.col("_lo") + F.col("_k") * F.lit(step_us), EPOCH()).alias(ts),
        CHUNK,
    )


def regularize(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_us: int = HALF_HOUR_US,
    *,
    keep_off_grid: bool = False,
    on_duplicate: str = "error",
    chunk_us: int = DEFAULT_CHUNK_US,
) -> DataFrame:
    """D4 (+G6): put each key's rows on its complete ``step`` grid (pandas ``reindex``).

    Grid slots without a row get NULL payload; rows off the grid are dropped
    (kept, flagged ``_on_grid = false``, with ``keep_off_grid``).  Two rows at
    one timestamp of a key fail the job (``on_duplicate="error"``, as
    ``reindex`` does) or keep the larger payload (``"max"``).

    The rows are shuffled once by ``(keys, chunk)``; the grid is generated in
    that partitioning (see :func:`time_grid`), so the aggregation by timestamp
    and any later per-chunk window reuse it.
    """
    keys = list(keys)
    data = with_chunk(df, ts, chunk_us)
    payload = [c for c in data.columns if c not in keys and c not in (ts, CHUNK)]
    # Only the rows are shuffled by (keys, chunk); the grid is generated already
    # partitioned that way (from one row per key and chunk), and the union keeps
    # the common partitioning, so the aggregation below needs no further shuffle.
    strict = on_duplicate == "error"
    # One row per slot at most when duplicates fail, so the maximum of each column is that row's
    # value and fixed-width columns aggregate by hash; "max" compares whole rows instead.
    held = [F.col(c) for c in payload] if strict else [F.struct(*payload).alias("_d")]
    d = data.repartition(*keys, CHUNK).select(*keys, ts, CHUNK, F.lit(False).alias("_g"), *held)
    names = [c for c in d.columns if c not in keys and c not in (ts, CHUNK, "_g")]
    grid = time_grid(data, keys, ts, step_us, chunk_us=chunk_us)
    g = grid.select(*keys, ts, CHUNK, F.lit(True).alias("_g"),
                    *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in names])
    r = d.unionByName(g).groupBy(*keys, CHUNK, ts).agg(
        F.max("_g").alias("_on_grid"), F.count(F.when(~F.col("_g"), 1)).alias("_n"), *[F.max(c).alias(c) for c in names])
    if not keep_off_grid:
        r = r.filter("_on_grid")
    if strict:
        r = r.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate timestamps within a key")).cast("boolean"))
                     .otherwise(F.lit(True)))
        cols = [*keys, ts, CHUNK, *payload]
    else:
        cols = [*keys, ts, CHUNK] + [F.col("_d")[c].alias(c) for c in payload]
    if keep_off_grid:
        cols.append("_on_grid")
    return r.select(*cols)


def merge_on_time(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str,
                  chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Left join of two keyed time tables on ``(keys, ts)`` through one shuffle.

    Both sides are unioned and co-partitioned by ``(keys, chunk)``, then grouped by
    timestamp, so the result already has the partitioning the ordered operators
    of this module need (a sort-merge join would shuffle by ``(keys, ts)`` and
    the next window again by ``(keys, chunk)``).  Each side must hold at most
    one row per key and timestamp; a repeat fails the job, since a join would
    multiply rows.
    """
    keys = list(keys)
    lx, rx = with_chunk(left, ts, chunk_us), with_chunk(right, ts, chunk_us)
    fixed = set(keys) | {ts, CHUNK}
    lcols = [c for c in lx.columns if c not in fixed]
    rcols = [c for c in rx.columns if c not in fixed and c not in lcols]
    none = lambda x, cols: [F.lit(None).cast(x.schema[c].dataType).alias(c) for c in cols]
    lpart = lx.select(*keys, ts, CHUNK, F.lit(True).alias("_is_left"), *lcols, *none(rx, rcols))
    rpart = rx.select(*keys, ts, CHUNK, F.lit(False).alias("_is_left"), *none(lx, lcols), *rcols)
    u = lpart.unionByName(rpart).repartition(*keys, CHUNK)
    # One row a side at most (checked), so the maximum of each column is that row's value.
    g = u.groupBy(*keys, CHUNK, ts).agg(
        F.count(F.when(F.col("_is_left"), 1)).alias("_nl"), F.count(F.when(~F.col("_is_left"), 1)).alias("_nr"),
        *[F.max(c).alias(c) for c in lcols + rcols])
    dup = (F.col("_nl") > 1) | (F.col("_nr") > 1)
    fail = F.raise_error(F.lit("repeated timestamp within a key")).cast("boolean")
    return g.filter(F.col("_nl") > 0).filter(F.when(dup, fail).otherwise(F.lit(True))).select(*keys, ts, CHUNK, *lcols, *rcols)


def merge_on_hour(left: DataFrame, hourly: DataFrame, keys: Sequence[str], ts: str,
                  chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Each row of ``left`` with the row of ``hourly`` (at full hours, one per key and hour) of its
    hour, whatever the step of ``left``.

    Both sides are unioned, co-partitioned by ``(keys, chunk)`` and grouped by hour; the rows of
    an hour (as many as its steps) are listed and expanded again.  A repeated hour fails the job.
    """
    keys = list(keys)
    lx, rx = with_chunk(left, ts, chunk_us), with_chunk(hourly, ts, chunk_us)
    fixed = set(keys) | {ts, CHUNK}
    lcols = [c for c in lx.columns if c not in fixed]
    rcols = [c for c in rx.columns if c not in fixed and c not in lcols]
    row = F.struct(ts, *lcols)
    lpart = lx.select(*keys, CHUNK, trunc_ntz(ts, "hour").alias("_hour"), row.alias("_l"),
                      *[F.lit(None).cast(rx.schema[c].dataType).alias(c) for c in rcols])
    rpart = rx.select(*keys, CHUNK, F.col(ts).alias("_hour"), F.lit(None).cast(lpart.schema["_l"].dataType).alias("_l"), *rcols)
    u = lpart.unionByName(rpart).repartition(*keys, CHUNK)
    g = u.groupBy(*keys, CHUNK, "_hour").agg(
        F.collect_list("_l").alias("_ls"), F.count(F.when(F.col("_l").isNull(), 1)).alias("_nr"),
        *[F.max(c).alias(c) for c in rcols])
    fail = F.raise_error(F.lit("repeated hour within a key")).cast("boolean")
    g = g.filter(F.when(F.col("_nr") > 1, fail).otherwise(F.lit(True)))
    g = g.select(*keys, CHUNK, F.explode("_ls").alias("_l"), *rcols)
    return g.select(*keys, F.col("_l")[ts].alias(ts), CHUNK, *[F.col("_l")[c].alias(c) for c in lcols], *rcols)


def missing_slots(df: DataFrame, keys: Sequence[str], ts: str, step_us: int = HALF_HOUR_US,
                  lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Grid timestamps with no row (grid minus present)."""
    keys = list(keys)
    grid = time_grid(df, keys, ts, step_us, lo, hi).drop(CHUNK)
    present = df.select(*keys, ts).filter(F.col(ts).isNotNull())
    return grid.join(present, keys + [ts], "left_anti")


# --------------------------------------------------------------------------- resampling


def to_hourly(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
              out_ts: str | None = None) -> DataFrame:
    """hour means of ``cols`` per key (missing values skipped, as ``mean``).

    When the input still carries the day chunk, it joins the grouping so the
    aggregate reuses the existing ``(keys, chunk)`` partitioning.
    """
    keys = list(keys)
    out_ts = out_ts or ts
    hour = trunc_ntz(F.col(ts), "hour")
    group = keys + ([CHUNK] if CHUNK in df.columns else [])
    return (
        df.groupBy(*group, hour.alias(out_ts))
        .agg(*[F.avg(c).alias(c) for c in cols])
    )


def nth_from_end(df: DataFrame, keys: Sequence[str], ts: str, n: int = 50,
                 tiebreak: Sequence[str] = (), chunk_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """The n-th row from the end of each key (``iloc[-n]``), skew-safe.

    Rows are counted per (key, chunk); only the chunk that holds the n-th row is numbered.  A dense chunk is
    dealt by hash into parts of about ``PART_ROWS`` rows first, of which the last ``n`` each go on.
    """
    from pyspark.sql import Window

    keys = list(keys)
    x = with_chunk(df, ts, chunk_us).dropna(subset=[*keys, CHUNK])
    later = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    place = counts.filter((F.col("_later") < n) & (F.col("_later") + F.col("_n") >= n))
    place = place.withColumn("_parts", F.ceil(F.col("_n") / PART_ROWS).cast("long")).drop("_n")
    order = [F.col(c).desc_nulls_last() for c in [ts, *tiebreak]]
    own = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    part = Window.partitionBy(*keys, CHUNK, "_part").orderBy(*order)
    x = x.join(place, [*keys, CHUNK]).withColumn("_part", F.pmod(F.xxhash64(ts, *tiebreak), F.col("_parts")))
    x = x.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= F.lit(n) - F.col("_later"))
    x = x.withColumn("_r", F.row_number().over(own))
    return x.filter(F.col("_r") == F.lit(n) - F.col("_later")).select(*[c for c in df.columns if c != CHUNK])


def trailing(df: DataFrame, keys: Sequence[str], ts: str, span: str) -> DataFrame:
    """C14: rows within ``span`` (``1d|7d|1m|3m|all``) back from each key's last timestamp."""
    keys = list(keys)
    if span == "all":
        return df
    last = small_side(df.groupBy(*keys).agg(F.max(ts).alias("_last")))
    spans = {
        "1d": F.timestamp_add("DAY", F.lit(-1), F.col("_last")),
        "7d": F.timestamp_add("DAY", F.lit(-7), F.col("_last")),
        "1m": F.timestamp_add("MONTH", F.lit(-1), F.col("_last")),
        "3m": F.timestamp_add("MONTH", F.lit(-3), F.col("_last")),
    }
    # the earliest cut-off of all keys bounds the scan before the join
    bound = last.select(F.min(spans[span])).scalar()
    rows = df.filter(F.col(ts) >= bound)
    joined = rows.join(last, keys) if keys else rows.crossJoin(last)  # one row without keys
    return joined.filter(F.col(ts) >= spans[span]).drop("_last")
