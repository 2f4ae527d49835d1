"""Data-quality reports.  Each is one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.functions.columns import epoch_us, month_string


def _missing(c: str, df: DataFrame):
    from pyspark.sql import types as T

    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """per column the missing count and any-flag, with the number of rows that
    have any missing value and the row count (long form, one row per column)."""
    cols = list(cols or df.columns)
    any_row = F.lit(False)
    for c in cols:
        any_row = any_row | _missing(c, df)
    agg = df.agg(
        *[F.sum(_missing(c, df).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)],
        F.sum(any_row.cast("long")).alias("rows_with_missing"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    stack = agg.unpivot(["rows_with_missing", "n_rows"], [f"m{i}" for i in range(len(cols))], "_c", "n_missing")
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"m{i}"), F.lit(c))])
    return stack.select(
        names[F.col("_c")].alias("column_name"),
        F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
        (F.coalesce("n_missing", F.lit(0)) > 0).alias("any_missing"),
        F.coalesce("rows_with_missing", F.lit(0)).cast("long").alias("rows_with_missing"),
        "n_rows",
    )


def nulls_by_month(df: DataFrame, col: str, ts: str = "datetime_gmt") -> DataFrame:
    """missing values of ``col`` per calendar month."""
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.sum(_missing(col, df).cast("long")).alias("n_missing")
    )


def rows_by_month(df: DataFrame, ts: str = "datetime_gmt") -> DataFrame:
    """row count per ``YYYY-MM``, sorted."""
    return df.groupBy(month_string(ts).alias("month")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy("month")


def completeness(df: DataFrame, keys: Sequence[str], ts: str, step_us: int,
                 value_cols: Sequence[str] = ()) -> DataFrame:
    """per key, expected slots ``(max - min)/step + 1`` against rows present,
    and missing values in ``value_cols``."""
    keys = list(keys)
    miss = F.lit(0).cast("long")
    for c in value_cols:
        miss = miss + F.sum(_missing(c, df).cast("long"))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("_lo"),
        F.max(ts).alias("_hi"),
        miss.alias("n_missing"),
    )
    exp = (F.floor((epoch_us("_hi") - epoch_us("_lo")) / F.lit(step_us)) + 1).cast("long")
    return agg.select(
        *keys, "n_rows", exp.alias("expected_rows"), "n_missing",
        ((F.col("n_rows") == exp) & (F.col("n_missing") == 0)).alias("complete"),
    )


def incomplete_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows (in ``order``) with any missing value."""
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | _missing(c, df)
    return df.filter(cond).orderBy(*order).limit(n)


def describe_schema(df: DataFrame) -> tuple[int, list[tuple[str, str]]]:
    """F16: shape and column types (an action: counts the rows)."""
    return df.count(), [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def unparsed(df: DataFrame, cols: Sequence[str], parse, keys: Sequence[str] = ()) -> DataFrame:
    """B7's check: per key and column the rows with text, and those of them that ``parse`` (text column ->
    value) turns into NULL, with the least such text.  The reference keeps such a column as text."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("_text")) for c in cols]))
    long = df.select(*keys, texts.alias("_t")).select(*keys, "_t.*").filter(F.col("_text").isNotNull())
    bad = parse(F.col("_text")).isNull()
    return long.groupBy(*keys, "column_name").agg(
        F.count(F.lit(1)).alias("n_text"), F.sum(bad.cast("long")).alias("n_unparsed"), F.min(F.when(bad, F.col("_text"))).alias("example"),
    )
