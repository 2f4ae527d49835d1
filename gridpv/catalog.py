"""Registered queries: one per operator or pipeline of SURVEY §2, on the driver tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the oracle SQL of the same key (``oracle_sql.py``).  Doubles are
rounded to 6 places on both sides.  Every query reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpv.functions.columns import parse_ts, round_to
from gridpv.operators import capacity as cap
from gridpv.operators import clean, model, quality, report, series, trees
from gridpv.operators.series import CHUNK, DAY_US, HALF_HOUR_US
from gridpv.operators.trees import TreeParams
from gridpv.plans import capacity as capplan
from gridpv.plans import dashboard, generation, modelling
from gridpv.plans import quality as qualityplan
from gridpv.schemas import LOCATION_COLUMNS
from gridpv.session import checkpoint_dir
from gridpv.sources import files
from gridpv.sources import manifest as mf
from gridpv.sources import requests as rq
from gridpv.sources import testdata as td
from gridpv.sources import weather
from gridpv.sources.files import select_generation

Query = Callable[[SparkSession, str], DataFrame]

R1K = ["event_type"]
SINCE = "1997-01-01"  # R4 ends in 2001 (FIXTURES); the reference defaults are 2010/2009.
# The nation names of the test tables, which stand in for GSP names (the pivot's columns).
NATIONS = [f"NATION_{i}" for i in range(25)]
LAST_FULL = "2001-08-01"  # the last R4 month holds only a few GSPs


# Capacity values of R4 are exact (integer cents / 1e8) and bit-identical in both
# engines; rounding them would only expose the engines' different half-way rules.
EXACT = ("cumul_capacity_mwp", "latest_capacity_mwp")


def _round(df: DataFrame, places: int = 6, keep: tuple[str, ...] = EXACT) -> DataFrame:
    """Round every computed double column (both sides of the oracle check do this)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep:
            cols.append(round_to(f.name, places).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            # Dates are reported as midnight timestamps so both engines hand over the same type.
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _no_chunk(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK) if CHUNK in df.columns else df


# --------------------------------------------------------------------------- shared inputs


_SHARED: dict[tuple, DataFrame] = {}


def _shared(fn):
    """Build a shared input once per session and sf_dir (DataFrames are immutable)."""

    def wrapper(spark: SparkSession, d: str) -> DataFrame:
        key = (fn.__name__, id(spark), d)
        df = _SHARED.get(key)
        if df is None or df.sparkSession is not spark:
            df = fn(spark, d)
            _SHARED[key] = df
        return df

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@_shared
def merged(spark: SparkSession, d: str) -> DataFrame:
    """K1 on R4/R5 with the supplier nations as known ids."""
    return capplan.capacity_with_locations(td.r4_capacity(spark, d), td.r5_locations(spark, d),
                                           td.known_ids(spark, d), release="R4")


@_shared
def locations_list(spark: SparkSession, d: str) -> DataFrame:
    return clean.gsp_locations(merged(spark, d))


@_shared
def scored(spark: SparkSession, d: str) -> DataFrame:
    """R8 with stand-in irradiance and capacity columns."""
    s = td.r8_scored(spark, d)
    return s.withColumns({
        "global_tilted_irradiance_instant": F.col("pred_generation_mw") * F.lit(10.0),
        "capacity_mwp": F.col("event_id").cast("double") / F.lit(100.0),
    })


@_shared
def capacity_by_month(spark: SparkSession, d: str) -> DataFrame:
    """K4 for all GSPs (``gsp_id, install_month, year, month, cumul_capacity_mwp``)."""
    return capplan.capacity_calendar(merged(spark, d))


# --------------------------------------------------------------------------- queries


def q_clean_daily_generation(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: R1 half-hours -> grid -> bounded interpolation -> hourly -> daily."""
    return generation.clean_daily_generation(td.r1_halfhourly(spark, d), R1K)


def q_g1_interpolate_time(spark, d):
    g = td.r2_sparse(spark, d)
    out = series.interpolate_time(g, ["gsp_id"], "datetime_gmt", "generation_mw", limit=12, tiebreak=["event_id"])
    return _round(_no_chunk(out))


def q_g1_grid_limit2(spark, d):
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    out = series.interpolate_time(r, R1K, "datetime_gmt", "generation_mw", limit=2)
    return _round(_no_chunk(out))


def q_g2_interpolate_linear(spark, d):
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    return _round(_no_chunk(series.interpolate_linear(r, R1K, "datetime_gmt", "generation_mw")))


def q_g3_ffill(spark, d):
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    return _round(_no_chunk(series.ffill(r, R1K, "datetime_gmt", "generation_mw")))


def q_g4_ffill_bfill(spark, d):
    g = td.r2_sparse(spark, d)
    out = series.ffill_bfill(g, ["gsp_id"], "datetime_gmt", "generation_mw", tiebreak=["event_id"])
    return _round(_no_chunk(out))


def q_g6_time_grid(spark, d):
    return series.time_grid(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US).drop(CHUNK)


def q_d4_regularize(spark, d):
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    return _round(_no_chunk(r))


def q_d7_missing_slots(spark, d):
    return series.missing_slots(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)


def q_d7_missing_slots_period(spark, d):
    return series.missing_slots(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US,
                                lo="2024-01-10 00:00:00", hi="2024-01-20 23:30:00")


def q_f1_to_hourly(spark, d):
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    return _round(_no_chunk(series.to_hourly(r, R1K, "datetime_gmt", ["generation_mw"])))


def q_g8_nth_from_end(spark, d):
    s = scored(spark, d).select("event_type", "datetime_gmt", "event_id", "capacity_mwp")
    return _round(series.nth_from_end(s, R1K, "datetime_gmt", 50, tiebreak=["event_id"]))


def q_c14_trailing(spark, d):
    return _round(series.trailing(td.r2_sparse(spark, d), ["gsp_id"], "datetime_gmt", "7d"))


def q_f2_daily_profile(spark, d):
    return _round(report.daily_profile(scored(spark, d), R1K))


def q_f3_hourly_profile(spark, d):
    return _round(report.hourly_profile(scored(spark, d), R1K))


def q_f6_kpis(spark, d):
    return _round(report.kpis(scored(spark, d), R1K))


def q_c11_last_month(spark, d):
    g = td.r3_daily(spark, d)
    return _round(report.last_period(g, ["gsp_id"], "datetime_gmt", "month"))


def q_c12_last_day(spark, d):
    s = scored(spark, d).select("event_type", "datetime_gmt", "event_id", "generation_mw")
    return _round(report.last_period(s, R1K, "datetime_gmt", "day"))


def q_k6_last_month_daily(spark, d):
    return _round(dashboard.last_month_daily(scored(spark, d), R1K))


def q_k7_last_day_hourly(spark, d):
    return _round(dashboard.last_day_hourly(scored(spark, d), R1K))


def q_k8_kpi_row(spark, d):
    return _round(dashboard.kpi_row(scored(spark, d), R1K, tiebreak=["event_id"]))


def q_k12_error_heatmap(spark, d):
    return _round(dashboard.error_heatmap(scored(spark, d), R1K))


def q_j1_split(spark, d):
    s = scored(spark, d).select("event_type", "datetime_gmt", "event_id")
    return model.split(s, R1K, "datetime_gmt", tiebreak=["event_id"])


def q_j2_scale(spark, d):
    s = scored(spark, d).select("event_type", "datetime_gmt", "event_id", "generation_mw", "pred_generation_mw")
    x = model.split(s, R1K, "datetime_gmt", tiebreak=["event_id"])
    return _round(model.scale(x, ["generation_mw", "pred_generation_mw"], R1K))


def q_f15_regression_metrics(spark, d):
    s = scored(spark, d)
    x = model.split(s, R1K, "datetime_gmt", tiebreak=["event_id"])
    return model.regression_metrics(x, by=["event_type", "split"])


def q_k1_capacity_with_locations(spark, d):
    return _round(merged(spark, d))


def q_e2_gsp_locations(spark, d):
    return _round(locations_list(spark, d))


def q_c6_keep_known(spark, d):
    return _round(clean.keep_known(td.r5_locations(spark, d), td.known_ids(spark, d)))


def q_c7_unknown_ids(spark, d):
    req = clean.distinct_values(td.r2_sparse(spark, d), ["gsp_id"]).select(F.col("gsp_id").cast("int").alias("gsp_id"))
    return clean.unknown_ids(req, locations_list(spark, d))


def q_e3_distinct_ids(spark, d):
    return clean.distinct_values(td.r2_sparse(spark, d).filter(F.col("generation_mw").isNotNull()), ["gsp_id"])


def q_c8_resolve_labels(spark, d):
    su = td.table(spark, d, "supplier")
    na = td.table(spark, d, "nation")
    re_ = td.table(spark, d, "region")
    req = (su.join(na, su.s_nationkey == na.n_nationkey).join(re_, na.n_regionkey == re_.r_regionkey)
           .select(F.col("s_suppkey").alias("request_id"),
                   F.when(F.col("s_acctbal") < 0, F.lit(None).cast("string"))
                   .otherwise(F.concat("n_name", F.lit(" | "), "r_name")).alias("gsp_region")))
    return rq.resolve_labels(req, locations_list(spark, d))


def q_c3_validate_periods(spark, d):
    o = td.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    li = td.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    req = o.join(li, o.o_orderkey == li.l_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
        F.col("l_shipdate").cast("date").alias("start_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 40).alias("end_date"),
    )
    return _round(rq.validate_periods(req))


def q_a2_choose_release(spark, d):
    p = td.table(spark, d, "part")
    ptype = F.col("p_type")
    man = p.select(
        F.col("p_size").alias("release_ord"),
        F.concat(F.lit("release_"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("release"),
        F.col("p_partkey").alias("file_ord"),
        F.concat(
            F.regexp_replace("p_name", " ", "_"), F.lit("_capacity_by_"),
            F.when(ptype == "ECONOMY", "20250101_GSP").when(ptype == "STANDARD", "20220314_GSP")
            .when(ptype == "SMALL", "llsoa").when(ptype == "MEDIUM", "gsp").otherwise("pes"),
            F.when(F.col("p_retailprice") < 950, "_and_month").otherwise(""),
            F.when(F.col("p_brand").endswith("7"), "_and_system_size").otherwise(""),
            F.lit(".csv.gz"),
        ).alias("filename"),
    ).withColumn("url", F.concat(F.lit("file:///capacity/"), "release", F.lit("/"), "filename"))
    outs = []
    for i, (region, hist, size, bv) in enumerate(A2_CASES):
        outs.append(mf.choose_release(man, region, hist, size, bv).withColumn("case_id", F.lit(i)))
    return clean.append(outs)


# Request parameter cases for the manifest query.
A2_CASES = [
    ("gsp", True, False, "20250101"),
    ("gsp", True, True, "20220314"),
    ("gsp", False, False, "20990101"),
    ("llsoa", True, False, "20250101"),
    ("pes", False, True, "20250101"),
    ("nowhere", True, False, "20250101"),
]


def q_a4_select_generation(spark, d):
    g = td.r2_sparse(spark, d)
    return _round(select_generation(g, "2024-01-05 00:00:00", "2024-01-20 23:30:00", td.known_ids(spark, d)))


def q_a7_explode_weather(spark, d):
    return _round(weather.explode_weather(td.r7_payload(spark, d), R1K))


def q_k2_clean_generation(spark, d):
    g = td.r2_sparse(spark, d).withColumn("gsp_id", F.col("gsp_id").cast("int"))
    out = generation.clean_generation(g, locations_list(spark, d), ["gsp_id"], tiebreak=["event_id"])
    return _round(out)


def q_a8_weather_requests(spark, d):
    g = td.r2_sparse(spark, d).withColumn("gsp_id", F.col("gsp_id").cast("int"))
    k2 = generation.clean_generation(g, locations_list(spark, d), ["gsp_id"], tiebreak=["event_id"])
    return _round(weather.weather_requests(k2, ["gsp_id"]))


def q_k3_generation_with_capacity(spark, d):
    g = td.r3_daily(spark, d)
    out = generation.generation_with_capacity(g, capacity_by_month(spark, d), ["gsp_id"], step_us=DAY_US)
    return _round(_no_chunk(out))


def q_k3_zero_fill(spark, d):
    g = td.r3_daily(spark, d)
    out = generation.generation_with_capacity(g, capacity_by_month(spark, d), ["gsp_id"], step_us=DAY_US,
                                              method="zero")
    return _round(_no_chunk(out))


def q_k3_with_locations(spark, d):
    """K3 on R3 with the location columns attached first; new grid rows get them by G5."""
    g = td.r3_daily(spark, d).withColumn("gsp_id", F.col("gsp_id").cast("int"))
    g = clean.attach_location(g, locations_list(spark, d))
    out = generation.generation_with_capacity(g, capacity_by_month(spark, d), ["gsp_id"], step_us=DAY_US,
                                              location_cols=LOCATION_COLUMNS)
    return _round(_no_chunk(out))


def q_k3_no_fill(spark, d):
    g = td.r3_daily(spark, d)
    out = generation.generation_with_capacity(g, capacity_by_month(spark, d), ["gsp_id"], step_us=DAY_US,
                                              method="none")
    return _round(_no_chunk(out))


def q_d5_half_hour_weather(spark, d):
    """D5 on weather of half-hour steps that start off the hour: every row gets the mean of its hour."""
    wx = weather.explode_weather(td.r7_payload(spark, d), R1K).select("event_type", "date", "shortwave_radiation")
    wx = wx.withColumn("date", F.explode(F.array(*[
        F.timestamp_add("MINUTE", F.lit(m), F.col("date")) for m in (10, 40)])))
    hourly = series.to_hourly(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", ["generation_mw"], out_ts="date")
    return _round(_no_chunk(series.merge_on_hour(wx, hourly, R1K, "date")))


def _report_table(name):
    """One table of K13's report on the sparse series R2."""
    def query(spark, d):
        report = qualityplan.quality_report(td.r2_sparse(spark, d).select("gsp_id", "datetime_gmt", "generation_mw"),
                                            ["gsp_id"], step_us=DAY_US)
        return _round(report[name])
    query.__doc__ = f"K13: the table ``{name}`` of the quality report of R2."
    return query


def q_c5_select_ids(spark, d):
    """Rows of the listed ids only (a list, and the distinct ids of a table)."""
    g = td.r2_sparse(spark, d)
    lo, hi = "1900-01-01", "2100-01-01"
    some = select_generation(g, lo, hi, gsp_ids=[1, 2, 3])
    table = select_generation(g, lo, hi, gsp_ids=g.filter("gsp_id > 5").select("gsp_id").distinct())
    out = some.withColumn("source", F.lit("list")).unionByName(table.withColumn("source", F.lit("table")))
    return out.groupBy("source", "gsp_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q_j11_residual_points(spark, d):
    """Actual and predicted value per split, on every row of R8."""
    x = model.split(scored(spark, d), R1K, "datetime_gmt", tiebreak=["event_id"])
    return _round(model.residual_points(x).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("generation_mw").alias("actual"), F.sum("pred_generation_mw").alias("predicted")))


def q_k13_quality_report(spark, d):
    """Missing-value profile (F10) of the complete daily grid before unbounded filling."""
    g = td.r3_daily(spark, d)
    k3 = generation.generation_with_capacity(g, capacity_by_month(spark, d), ["gsp_id"], step_us=DAY_US,
                                             method="none")
    return quality.null_profile(_no_chunk(k3), ["gsp_id", "datetime_gmt", "generation_mw", "capacity_mwp"])


def q_f7_time_extents(spark, d):
    """first and last timestamp per key."""
    g = td.r2_sparse(spark, d)
    return g.groupBy("gsp_id").agg(F.min("datetime_gmt").alias("first_ts"), F.max("datetime_gmt").alias("last_ts"))


def q_d3_align_capacity(spark, d):
    from gridpv.functions.columns import with_calendar

    g = with_calendar(td.r3_daily(spark, d), "datetime_gmt")
    return _round(generation.align_capacity(g, capacity_by_month(spark, d), ["gsp_id"]))


def q_k4_capacity_calendar(spark, d):
    return _round(capacity_by_month(spark, d))


def _key_capacity(spark, d, g):
    """Stand-in capacity of the event series: the R4 total of each calendar month over all GSPs."""
    total = cap.month_values(merged(spark, d)).groupBy(F.month(cap.M).alias("_m")).agg(F.sum(cap.V).alias("capacity_mwp"))
    return g.withColumn("_m", F.month("datetime_gmt")).join(total, "_m", "left").drop("_m")


def q_k5_modelling_table(spark, d):
    wx = weather.explode_weather(td.r7_payload(spark, d), R1K)
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    g = series.interpolate_time(r, R1K, "datetime_gmt", "generation_mw", limit=12)
    return _round(generation.modelling_table(wx, _key_capacity(spark, d, g), R1K))


def q_i1_wide_capacity(spark, d):
    wide = cap.wide_capacity(merged(spark, d), values=NATIONS)
    return _round(wide, keep=tuple(wide.columns))


def q_i2_long_capacity(spark, d):
    return _round(cap.long_capacity(cap.wide_capacity(merged(spark, d), values=NATIONS)))


def q_k9_location_map(spark, d):
    return _round(capplan.location_map(merged(spark, d)))


def q_k9_location_map_full_month(spark, d):
    return _round(capplan.location_map(merged(spark, d), before=LAST_FULL))


def _full_months(spark, d):
    """The cells before the last month, which holds only a few GSPs."""
    return cap.month_values(merged(spark, d)).filter(F.col(cap.M) < F.lit(LAST_FULL).cast("date"))


def q_f9_national_capacity(spark, d):
    return cap.national_capacity(cap.month_values(merged(spark, d)))


def q_f9_national_capacity_full_month(spark, d):
    return cap.national_capacity(_full_months(spark, d))


def q_h3_top_gsps(spark, d):
    return _round(cap.top_gsps(cap.month_values(merged(spark, d)), n=10, start=SINCE))


def q_h3_top_gsps_full_month(spark, d):
    return _round(cap.top_gsps(_full_months(spark, d), n=10, start=SINCE))


def q_k10_growth_top(spark, d):
    return _round(cap.growth_top(cap.month_values(merged(spark, d)), n=10, start=SINCE))


def q_k10_growth_top_full_month(spark, d):
    return _round(cap.growth_top(_full_months(spark, d), n=10, start=SINCE))


def q_k11_annual_capacity(spark, d):
    return _round(cap.annual(cap.month_values(merged(spark, d)), start=SINCE))


def q_f10_null_profile(spark, d):
    return quality.null_profile(td.r2_sparse(spark, d))


def q_f11_nulls_by_month(spark, d):
    from gridpv.functions.columns import with_calendar

    g = with_calendar(td.r3_daily(spark, d), "datetime_gmt")
    x = generation.align_capacity(g, capacity_by_month(spark, d), ["gsp_id"])
    return quality.nulls_by_month(x, "capacity_mwp")


def q_f12_rows_by_month(spark, d):
    return quality.rows_by_month(td.r3_daily(spark, d))


def q_f13_completeness(spark, d):
    g = td.r3_daily(spark, d)
    k3 = generation.generation_with_capacity(g, capacity_by_month(spark, d), ["gsp_id"], step_us=DAY_US)
    return quality.completeness(_no_chunk(k3), ["gsp_id"], "datetime_gmt", DAY_US, ["generation_mw", "capacity_mwp"])


def q_c13_incomplete_rows(spark, d):
    return _round(quality.incomplete_rows(td.r2_sparse(spark, d), 20, ["datetime_gmt", "event_id"]))


def q_k14_train_and_score(spark, d):
    """Modelling table of R1/R7, pooled tuned boosted trees, metrics per split."""
    wx = weather.explode_weather(td.r7_payload(spark, d), R1K)
    r = series.regularize(td.r1_halfhourly(spark, d), R1K, "datetime_gmt", HALF_HOUR_US)
    g = series.interpolate_time(r, R1K, "datetime_gmt", "generation_mw", limit=12)
    g = _key_capacity(spark, d, g)
    table = generation.modelling_table(wx, g, R1K).filter(F.col("generation_mw").isNotNull())
    _, metrics = modelling.train_and_score(table, R1K, "date", preset="boosted_tuned")
    return metrics


def _tree_table(spark, d):
    """R8 as a modelling table: the label, features with missing values, ties and many values."""
    s = scored(spark, d)
    return s.select(
        "event_type", "datetime_gmt", "event_id", "generation_mw",
        F.when(F.col("event_id") % 7 != 0, F.col("global_tilted_irradiance_instant")).alias("irradiance"),
        F.hour("datetime_gmt").cast("double").alias("hour"), F.dayofmonth("datetime_gmt").cast("double").alias("day"), "capacity_mwp")


TREE_FEATURES = ["irradiance", "hour", "day", "capacity_mwp"]


def q_j4_root_splits(spark, d):
    """The first split of each key's boosted model (L1, L2, missing direction) and the values of its sides."""
    p = replace(trees.TREE_PRESETS["boosted_tuned"], trees=1, depth=1, rows=1.0, columns=1.0)
    fitted = trees.fit_trees(_tree_table(spark, d), TREE_FEATURES, "generation_mw", ["event_id"], R1K, p)
    s = fitted.splits()
    value = lambda c: (F.col(c) / F.lit(float(trees.SCALE))).alias({"vl": "left_value", "vr": "right_value"}[c])
    return _round(s.select(
        F.get_json_object("model", "$.event_type").alias("event_type"), "feature", "threshold", "missing_left", "gain",
        F.col("cl").alias("n_left"), F.col("cr").alias("n_right"), value("vl"), value("vr")))


def q_k14_split_coverage(spark, d):
    """K14 per key without shrinkage or penalties, so that the mean prediction of the train rows is the mean label."""
    p = TreeParams(trees=1, rate=1.0, depth=3)
    out = modelling.train_per_key(_tree_table(spark, d), R1K, "datetime_gmt", p, tiebreak=["event_id"])
    c = modelling.split_coverage(out.scored, R1K)
    known = F.col("split") == "train"
    return c.select("event_type", "split", "n_rows", "n_predicted", round_to("mean_actual", 3).alias("mean_actual"),
                    round_to(F.when(known, F.col("mean_predicted")), 3).alias("mean_predicted_train"))


def q_k14_per_key(spark, d):
    """K14 with one tuned boosted model per key (5 of its 50 rounds), after a selection of features."""
    p = replace(trees.TREE_PRESETS["boosted_tuned"], trees=5)
    selector = replace(trees.TREE_PRESETS["selector"], trees=1)
    return modelling.train_per_key(_tree_table(spark, d), R1K, "datetime_gmt", p, selector, tiebreak=["event_id"]).metrics


#: The presets that J10 compares.
COMPARED = ["boosted_tuned", "forest_tuned", "extra_trees_tuned", "gradient_boosting"]


def q_j10_compare_presets(spark, d):
    """Four presets with all their trees per key on one shared table."""
    presets = {name: trees.TREE_PRESETS[name] for name in COMPARED}
    return modelling.compare_presets(_tree_table(spark, d), R1K, presets, "datetime_gmt", tiebreak=["event_id"])[0]


def q_j10_metrics_of_models(spark, d):
    """Metrics of given predictions of three models, in one aggregate."""
    x = model.split(scored(spark, d), R1K, "datetime_gmt", tiebreak=["event_id"])
    x = x.withColumns({"shifted": F.col("pred_generation_mw") + 1.5, "by_hour": F.when(F.col("event_id") % 5 != 0, F.hour("datetime_gmt") * 2.0)})
    return model.evaluate_columns(x, {"given": "pred_generation_mw", "shifted": "shifted", "by_hour": "by_hour"})


def q_b7_unparsed(spark, d):
    """Texts of times that do not parse, counted per key."""
    text = F.date_format("datetime_gmt", "yyyy-MM-dd HH:mm:ss")
    bad = F.when(F.col("event_id") % 13 == 0, "n/a").when(F.col("event_id") % 17 == 0, "31 May").when(F.col("event_id") % 19 != 0, text)
    x = scored(spark, d).select("event_type", bad.alias("start"), text.alias("end"))
    return quality.unparsed(x, ["start", "end"], parse_ts, R1K)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_a1_read_capacity(spark, d):
    """Capacity as gzip CSV with the source's column name and some bad numbers, read back."""
    path = _folder(spark, "capacity")
    bad = F.when(F.col("system_count") % 37 == 0, "n/k").otherwise(F.col("cumul_capacity_mwp").cast("string"))
    raw = td.r4_capacity(spark, d).select(
        "install_month", "GSPs", (F.col("cumul_capacity_mwp") * 1.25).alias("dc_capacity_MWp"), bad.alias("cumul_capacity_mwp"), "system_count")
    raw.write.option("header", True).option("compression", "gzip").csv(path)
    return _round(files.read_capacity(spark, path, release="R4"))


def q_a3_read_locations(spark, d):
    """Locations as CSV, read back; the first row of each name in file order."""
    path = _folder(spark, "locations")
    rows = td.r5_locations(spark, d).orderBy("row_ord", "gsp_name").coalesce(1).drop("row_ord")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _round(clean.first_per_key(files.read_locations(spark, path), ["gsp_name"], ["row_ord"]).drop("row_ord"))


def q_a6_read_weather_payload(spark, d):
    """Weather payloads as JSON, read back with the payload schema and turned to rows."""
    path = _folder(spark, "weather")
    payload = td.r7_payload(spark, d)
    payload.withColumn("gsp_id", F.ascii("event_type")).drop("event_type").write.json(path)
    return _round(weather.explode_weather(files.read_weather_payload(spark, path, "json"), ["gsp_id"]))


def q_a9_write_table(spark, d):
    """Daily generation exported as parquet by year and as CSV; the rows of both exports."""
    rows = td.r3_daily(spark, d).withColumn("year", F.year("datetime_gmt"))
    paths = {fmt: _folder(spark, fmt) for fmt in ("parquet", "csv")}
    files.write_table(rows, paths["parquet"], partition_by=["year"])
    files.write_table(rows, paths["csv"], "csv")
    ddl = rows.select("gsp_id", "datetime_gmt", "generation_mw", "year").schema
    back = {"parquet": spark.read.parquet(paths["parquet"]), "csv": spark.read.schema(rows.schema).option("header", True).csv(paths["csv"])}
    return _round(clean.append([df.select(*ddl.names, F.lit(fmt).alias("fmt")) for fmt, df in back.items()]))


def q_e5_append_ordered(spark, d):
    """E5: train and test rows appended again, in the order of time."""
    x = model.split(scored(spark, d).select("event_type", "datetime_gmt", "event_id", "generation_mw"), R1K, "datetime_gmt", tiebreak=["event_id"])
    both = clean.append([x.filter("split = 'train'"), x.filter("split = 'test'")])
    return _round(series.row_index(both, R1K, "datetime_gmt", ["event_id"]).select(
        *both.columns, F.col("_rn").cast("long").alias("place")).orderBy("event_type", "place"))


def q_f16_describe_schema(spark, d):
    """F16: rows, column names and types of the scored table."""
    n, columns = quality.describe_schema(td.r8_scored(spark, d))
    return spark.createDataFrame([(name, kind, n) for name, kind in columns], "column_name string, column_type string, n_rows long")


def q_h4_importance(spark, d):
    """H4: importance of the features in the first split of each key's boosted model."""
    p = replace(trees.TREE_PRESETS["boosted_tuned"], trees=1, depth=1, rows=1.0, columns=1.0)
    found = trees.fit_trees(_tree_table(spark, d), TREE_FEATURES, "generation_mw", ["event_id"], R1K, p).importance()
    return _round(found.select(F.get_json_object("model", "$.event_type").alias("event_type"), "feature", "importance"))


QUERIES: dict[str, Query] = {
    "clean_daily_generation": q_clean_daily_generation,
    "g1_interpolate_time": q_g1_interpolate_time,
    "g1_grid_limit2": q_g1_grid_limit2,
    "g2_interpolate_linear": q_g2_interpolate_linear,
    "g3_ffill": q_g3_ffill,
    "g4_ffill_bfill": q_g4_ffill_bfill,
    "g6_time_grid": q_g6_time_grid,
    "d4_regularize": q_d4_regularize,
    "d7_missing_slots": q_d7_missing_slots,
    "d7_missing_slots_period": q_d7_missing_slots_period,
    "f1_to_hourly": q_f1_to_hourly,
    "g8_nth_from_end": q_g8_nth_from_end,
    "c14_trailing": q_c14_trailing,
    "f2_daily_profile": q_f2_daily_profile,
    "f3_hourly_profile": q_f3_hourly_profile,
    "f6_kpis": q_f6_kpis,
    "c11_last_month": q_c11_last_month,
    "c12_last_day": q_c12_last_day,
    "k6_last_month_daily": q_k6_last_month_daily,
    "k7_last_day_hourly": q_k7_last_day_hourly,
    "k8_kpi_row": q_k8_kpi_row,
    "k12_error_heatmap": q_k12_error_heatmap,
    "j1_split": q_j1_split,
    "j2_scale": q_j2_scale,
    "f15_regression_metrics": q_f15_regression_metrics,
    "k1_capacity_with_locations": q_k1_capacity_with_locations,
    "e2_gsp_locations": q_e2_gsp_locations,
    "c6_keep_known": q_c6_keep_known,
    "c7_unknown_ids": q_c7_unknown_ids,
    "e3_distinct_ids": q_e3_distinct_ids,
    "c8_resolve_labels": q_c8_resolve_labels,
    "c3_validate_periods": q_c3_validate_periods,
    "a2_choose_release": q_a2_choose_release,
    "a4_select_generation": q_a4_select_generation,
    "a7_explode_weather": q_a7_explode_weather,
    "k2_clean_generation": q_k2_clean_generation,
    "a8_weather_requests": q_a8_weather_requests,
    "k3_generation_with_capacity": q_k3_generation_with_capacity,
    "k3_zero_fill": q_k3_zero_fill,
    "k3_with_locations": q_k3_with_locations,
    "k3_no_fill": q_k3_no_fill,
    "k13_quality_report": q_k13_quality_report,
    "f7_time_extents": q_f7_time_extents,
    "d3_align_capacity": q_d3_align_capacity,
    "k4_capacity_calendar": q_k4_capacity_calendar,
    "k5_modelling_table": q_k5_modelling_table,
    "i1_wide_capacity": q_i1_wide_capacity,
    "i2_long_capacity": q_i2_long_capacity,
    "k9_location_map": q_k9_location_map,
    "k9_location_map_full_month": q_k9_location_map_full_month,
    "f9_national_capacity": q_f9_national_capacity,
    "f9_national_capacity_full_month": q_f9_national_capacity_full_month,
    "h3_top_gsps": q_h3_top_gsps,
    "h3_top_gsps_full_month": q_h3_top_gsps_full_month,
    "k10_growth_top": q_k10_growth_top,
    "k10_growth_top_full_month": q_k10_growth_top_full_month,
    "c5_select_ids": q_c5_select_ids,
    "d5_half_hour_weather": q_d5_half_hour_weather,
    "j11_residual_points": q_j11_residual_points,
    "k13_null_profile": _report_table("null_profile"),
    "k13_nulls_by_month": _report_table("nulls_by_month"),
    "k13_rows_by_month": _report_table("rows_by_month"),
    "k13_completeness": _report_table("completeness"),
    "k13_missing_slots": _report_table("missing_slots"),
    "k13_incomplete_rows": _report_table("incomplete_rows"),
    "k11_annual_capacity": q_k11_annual_capacity,
    "f10_null_profile": q_f10_null_profile,
    "f11_nulls_by_month": q_f11_nulls_by_month,
    "f12_rows_by_month": q_f12_rows_by_month,
    "f13_completeness": q_f13_completeness,
    "c13_incomplete_rows": q_c13_incomplete_rows,
    "k14_train_and_score": q_k14_train_and_score,
    "j4_root_splits": q_j4_root_splits,
    "k14_split_coverage": q_k14_split_coverage,
    "k14_per_key": q_k14_per_key,
    "j10_compare_presets": q_j10_compare_presets,
    "j10_metrics_of_models": q_j10_metrics_of_models,
    "b7_unparsed": q_b7_unparsed,
    "a1_read_capacity": q_a1_read_capacity,
    "a3_read_locations": q_a3_read_locations,
    "a6_read_weather_payload": q_a6_read_weather_payload,
    "a9_write_table": q_a9_write_table,
    "e5_append_ordered": q_e5_append_ordered,
    "f16_describe_schema": q_f16_describe_schema,
    "h4_importance": q_h4_importance,
}
