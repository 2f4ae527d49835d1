"""Stand-in inputs built from the driver's test tables (FIXTURES.md, Part 2).

Each role only reshapes rows into the schema an operator expects; the
operators do the work.  All roles read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpv.schemas import WEATHER_VARIABLES


_TABLES: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table, read once per session (listing and footer reads are eager)."""
    path = f"{sf_dir}/{name}.parquet"
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _TABLES[key] = df
    return df


def _k(props: str = "props"):
    return F.get_json_object(F.col(props), "$.k").cast("double")


def r1_halfhourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 dense half-hourly generation: key ``event_type``; every fifth event id is missing."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        "event_type", F.window("ts", "30 minutes").start.alias("datetime_gmt")
    ).agg(F.avg(F.when(F.col("event_id") % 5 != 0, F.col("value"))).alias("generation_mw"))


def r2_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 sparse irregular generation: key ``gsp_id`` (= user), order ``(datetime_gmt, event_id)``."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    gen = F.when(et == "error", F.lit(None)).when((et == "purchase") | (F.col("event_id") % 17 == 0), F.col("value"))
    return e.select(
        F.col("user_id").alias("gsp_id"),
        F.col("ts").alias("datetime_gmt"),
        "event_id",
        gen.alias("generation_mw"),
    )


def r3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 daily generation: key ``gsp_id`` (= supplier nation), one row per ship day."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        li.join(su, li.l_suppkey == su.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("gsp_id"), F.col("l_shipdate").alias("datetime_gmt"))
        .agg(F.sum("l_quantity").alias("generation_mw"))
    )


def r4_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 monthly cumulative capacity per nation name (``'unkown'`` for nation 24).

    Columns as the capacity file after loading: ``install_month, GSPs,
    cumul_capacity_mwp, system_count`` (orders that month).
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    m = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_nationkey", "n_name", F.trunc("o_orderdate", "month").alias("install_month"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("_cents"),
             F.count(F.lit(1)).alias("system_count"))
    )
    w = Window.partitionBy("n_nationkey").orderBy("install_month").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(
        "install_month",
        F.when(F.col("n_nationkey") == 24, F.lit("unkown")).otherwise(F.col("n_name")).alias("GSPs"),
        # Integer cents summed exactly, then one division: identical in every engine.
        (F.sum("_cents").over(w) / F.lit(1e8)).alias("cumul_capacity_mwp"),
        "system_count",
    )


def r5_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 location table: text ids (``'n/a'`` for some), padded lower-case names, two rows each."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    base = n.join(r, n.n_regionkey == r.r_regionkey)
    rows = base.withColumn("row_ord", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    shift = (F.col("row_ord") - 1).cast("double")
    return rows.select(
        F.when(k % 11 == 10, F.lit("n/a")).otherwise(k.cast("string")).alias("gsp_id"),
        F.concat(F.lit("  "), F.lower(F.col("n_name")), F.lit(" ")).alias("gsp_name"),
        (F.lit(50.0) + F.lit(0.25) * k + shift).alias("gsp_lat"),
        (F.lit(-5.0) + F.lit(0.25) * k + shift).alias("gsp_lon"),
        F.col("r_name").alias("region_name"),
        (F.lit(10) + F.col("n_regionkey")).cast("int").alias("pes_id"),
        "row_ord",
    )


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids the generation source knows: the supplier nations (``gsp_id`` int)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("gsp_id")).distinct()


def _weather_aggs() -> list:
    k = "CAST(get_json_object(props, '$.k') AS DOUBLE)"
    exprs = {
        "shortwave_radiation": f"avg({k})",
        "direct_radiation": f"min({k})",
        "diffuse_radiation": f"max({k}) - min({k})",
        "direct_normal_irradiance": "avg(value)",
        "global_tilted_irradiance": f"sum({k})",
        "shortwave_radiation_instant": "max(value)",
        "direct_radiation_instant": "min(value)",
        "diffuse_radiation_instant": "CAST(count(1) AS DOUBLE)",
        "direct_normal_irradiance_instant": "sum(value)",
        "global_tilted_irradiance_instant": f"max({k})",
    }
    return [F.expr(f"round(({exprs[name]}) * 1e6) / 1e6").alias(name) for name in WEATHER_VARIABLES]


def r6_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 hourly weather rows: key ``event_type``, ``date`` hour, ten variables from ``props.k``."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").start.alias("date")).agg(*_weather_aggs())


def r7_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7 weather payloads, one per key and day: epoch start/end, step 3600, 24-value arrays.

    Hours without weather rows hold NULL in the arrays.
    """
    w = r6_weather(spark, sf_dir)
    g = w.withColumn("_day", F.col("date").cast("date").cast("timestamp_ntz")).groupBy("event_type", "_day").agg(
        *[F.expr(f"map_from_entries(collect_list(struct(hour(date), CAST({v} AS FLOAT))))").alias(v)
          for v in WEATHER_VARIABLES]
    )
    start = F.expr("unix_date(CAST(_day AS DATE)) * 86400L")
    return g.select(
        "event_type",
        start.alias("time"),
        (start + F.lit(86_400)).alias("time_end"),
        F.lit(3600).alias("interval"),
        *[F.expr(f"transform(sequence(0, 23), h -> try_element_at({v}, h))").alias(v) for v in WEATHER_VARIABLES],
    )


def r8_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 scored table: key ``event_type``, actual ``value``, predicted ``props.k``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_type",
        F.col("ts").alias("datetime_gmt"),
        "event_id",
        F.col("value").alias("generation_mw"),
        _k().alias("pred_generation_mw"),
    )
