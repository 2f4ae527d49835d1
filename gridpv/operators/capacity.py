"""Capacity views: pivot/unpivot, latest snapshot, growth, annual totals.

The reference keeps a wide month x GSP table; here the long form
``(install_month, GSPs, value)`` is the working shape and the wide form is
produced only on request (I1), with an explicit pivot value list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpv.operators.report import since

M, G, V = "install_month", "GSPs", "cumul_capacity_mwp"


def _present(df: DataFrame, value: str = V) -> DataFrame:
    from gridpv.schemas import nan_to_null

    return df.withColumn(value, nan_to_null(F.col(value))).filter(F.col(value).isNotNull())


def month_values(merged: DataFrame, time_col: str = M, gsp_col: str = G, value: str = V,
                 order: Sequence[str] = ()) -> DataFrame:
    """Long form of the pivot cells: per (month, GSP) the first non-missing value in
    ``order``.  Without an order a month and GSP with two values fails the job, since
    there is no first one."""
    p = _present(merged, value)
    if order:
        ordv = F.struct(*[F.col(o) for o in order])
        return p.groupBy(time_col, gsp_col).agg(F.min_by(value, ordv).alias(value))
    cells = p.groupBy(time_col, gsp_col).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("_n"))
    fail = F.raise_error(F.lit("several capacity values for one month and GSP; name an order"))
    return cells.select(time_col, gsp_col, F.when(F.col("_n") > 1, fail.cast("double")).otherwise(F.col(value)).alias(value))


def pivot_values(merged: DataFrame, gsp_col: str = G, value: str = V) -> list[str]:
    """Names of the GSPs that have any value (the pivot columns). Driver-side list
    of names only, bounded by the number of GSPs."""
    rows = _present(merged, value).select(gsp_col).distinct().collect()
    return sorted(r[0] for r in rows)


def wide_capacity(merged: DataFrame, time_col: str = M, gsp_col: str = G, value: str = V,
                  order: Sequence[str] = (), values: list[str] | None = None) -> DataFrame:
    """Month x GSP table of the first non-missing value (see
    :func:`month_values`); GSPs without any value have no column; rows are months."""
    cells = month_values(merged, time_col, gsp_col, value, order)
    vals = values if values is not None else pivot_values(merged, gsp_col, value)
    return cells.groupBy(time_col).pivot(gsp_col, vals).agg(F.first(value))


def long_capacity(wide: DataFrame, cols: Sequence[str] | None = None, time_col: str = M,
                  gsp_col: str = G, value: str = V, dropna: bool = True) -> DataFrame:
    """Unpivot GSP columns back to ``(month, GSP, value)``."""
    cols = list(cols) if cols is not None else [c for c in wide.columns if c != time_col]
    out = wide.unpivot([time_col], cols, gsp_col, value)
    return out.filter(F.col(value).isNotNull()) if dropna else out


def latest_capacity(cells: DataFrame, gsp_locations: DataFrame, time_col: str = M, gsp_col: str = G,
                    value: str = V, out: str = "latest_capacity_mwp") -> DataFrame:
    """G9 + D6: each GSP's value in the table's last month (missing if it has none
    then), joined onto the location list."""
    last = cells.select(F.max(time_col)).scalar()
    snap = cells.filter(F.col(time_col) == last).select(gsp_col, F.col(value).alias(out))
    return gsp_locations.join(snap, gsp_col, "left")


def national_capacity(cells: DataFrame, time_col: str = M, gsp_col: str = G, value: str = V,
                      skip_first: bool = False) -> DataFrame:
    """F8 + F9: GSP count and GWp total of the last month (``/1000``, truncated).

    One aggregate; the last month (and the first GSP name for ``skip_first``)
    enter as scalar subqueries.  ``skip_first`` reproduces the reference's
    figure, which leaves out the alphabetically first GSP column.
    """
    last = cells.select(F.max(time_col)).scalar()
    in_total = F.col(time_col) == last
    if skip_first:
        in_total = in_total & (F.col(gsp_col) != cells.select(F.min(gsp_col)).scalar())
    agg = cells.agg(
        F.countDistinct(gsp_col).alias("gsp_count"),
        F.coalesce(F.sum(F.when(in_total, F.col(value))), F.lit(0.0)).alias("_t"),
    )
    return agg.select("gsp_count", (F.col("_t") / 1000).cast("long").alias("total_solar_capacity_gwp"))


def top_gsps(cells: DataFrame, n: int = 50, start: str | None = None, time_col: str = M,
             gsp_col: str = G, value: str = V) -> DataFrame:
    """H3: the ``n`` GSPs with the largest value in the last month (since ``start``);
    ties by name.  ``orderBy().limit()`` is a per-partition top-k plus one merge."""
    x = cells if start is None else since(cells, time_col, start)
    snap = x.filter(F.col(time_col) == x.select(F.max(time_col)).scalar())
    return snap.orderBy(F.col(value).desc_nulls_last(), F.col(gsp_col)).limit(n).select(gsp_col, value)


def growth_top(cells: DataFrame, n: int = 50, start: str = "2010-01-01", time_col: str = M,
               gsp_col: str = G, value: str = V) -> DataFrame:
    """Monthly values since ``start`` of the top-``n`` GSPs (long form)."""
    x = since(cells, time_col, start)
    top = top_gsps(cells, n, start, time_col, gsp_col, value).select(gsp_col)
    return x.join(top, gsp_col, "left_semi").select(time_col, gsp_col, value)


def annual(cells: DataFrame, start: str = "2009-01-01", time_col: str = M, gsp_col: str = G,
           value: str = V) -> DataFrame:
    """F4 + F5 + G7 (K11): per year, the sum over GSPs of each GSP's last value in
    that year, and the increase on the previous year (first year 0).

    Years between the first and last with no values total 0 (no carry-forward,
    as ``resample('Y').last().sum(axis=1)``).  The final window runs over one
    row per year.
    """
    x = since(cells, time_col, start).withColumn("year", F.year(time_col))
    last = x.groupBy(gsp_col, "year").agg(F.max_by(value, time_col).alias(value))
    tot = last.groupBy("year").agg(F.sum(value).alias("total_capacity_mwp"))
    years = x.groupBy().agg(F.min("year").alias("_lo"), F.max("year").alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi")).alias("year")
    )
    t = years.join(tot, "year", "left").withColumn(
        "total_capacity_mwp", F.coalesce("total_capacity_mwp", F.lit(0.0))
    )
    w = Window.orderBy("year")
    inc = F.coalesce(F.col("total_capacity_mwp") - F.lag("total_capacity_mwp").over(w), F.lit(0.0))
    return t.select("year", inc.alias("annual_increase_mwp"), "total_capacity_mwp")
