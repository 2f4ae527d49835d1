import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from gridpv.operators import model, report
from gridpv.operators.series import HALF_HOUR_US


def _model_fixture(spark):
    """Irradiance as a half sine by hour; generation = 0.02 * irradiance * capacity + noise; 60 days, 3 GSPs."""
    rnd = random.Random(5)
    rows = []
    t0 = dt.datetime(2024, 5, 1)
    for g, capacity in [(1, 100.0), (2, 200.0), (3, 50.0)]:
        for h in range(60 * 24):
            t = t0 + dt.timedelta(hours=h)
            irr = max(0.0, math.sin(math.pi * (t.hour - 6) / 12)) * 800 * (0.7 + 0.3 * rnd.random())
            gen = 0.02 * irr * capacity / 100 + rnd.gauss(0, 0.5)
            rows.append((g, t, irr, float(t.hour), capacity, gen))
    return spark.createDataFrame(rows, "gsp_id int, date timestamp_ntz, shortwave_radiation double, hour double, "
                                       "capacity_mwp double, generation_mw double")


def test_split_exact_and_stable(spark):
    df = _model_fixture(spark)
    a = model.split(df, ["gsp_id"], "date")
    counts = {(r["gsp_id"], r["split"]): r["count"] for r in a.groupBy("gsp_id", "split").count().collect()}
    for g in (1, 2, 3):
        assert counts[(g, "test")] == math.ceil(0.2 * 1440)
    b = model.split(df.repartition(7), ["gsp_id"], "date")
    assert a.join(b, ["gsp_id", "date", "split"]).count() == df.count()


def test_model_fits_and_scores(spark):
    df = _model_fixture(spark)
    x = model.materialize(model.split(df, ["gsp_id"], "date"))
    feats = model.feature_columns(x, exclude=["date", "split", "gsp_id"])
    train = x.filter("split = 'train'")
    keep = model.select_features(train, feats)
    assert keep and set(keep) <= set(feats) and "shortwave_radiation" in keep
    m = model.fit(train, feats, preset="boosted_tuned", select=False)
    scored = model.predict(m, x)
    assert scored.count() == df.count()
    metrics = {r["split"]: r for r in model.regression_metrics(scored).collect()}
    assert metrics["test"]["r2"] > 0.8
    assert all(math.isfinite(metrics[s][k]) for s in metrics for k in ("r2", "mae", "mse", "rmse"))
    imp = model.feature_importance(m, spark).collect()
    assert imp and imp[0]["importance"] >= imp[-1]["importance"]


def test_kpis_variance_null_when_actual_zero(spark):
    rows = [("a", 0.0, 5.0), ("b", 10.0, 12.0)]
    df = spark.createDataFrame(rows, "k string, generation_mw double, pred_generation_mw double")
    got = {r["k"]: r["percent_variance"] for r in report.kpis(df, ["k"]).collect()}
    assert got["a"] is None and abs(got["b"] - 20.0) < 1e-9


def test_daily_profile_empty_day_rules(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("a", t, 1.0, 2.0, 10.0), ("a", t + dt.timedelta(days=2), 3.0, None, None)]
    df = spark.createDataFrame(rows, "k string, datetime_gmt timestamp_ntz, generation_mw double, "
                                     "pred_generation_mw double, global_tilted_irradiance_instant double")
    got = [(r["actual_generation_mw"], r["pred_generation_mw"], r["global_tilted_irradiance_instant"])
           for r in report.daily_profile(df, ["k"]).orderBy("date").collect()]
    assert got == [(1.0, 2.0, 10.0), (0.0, 0.0, None), (3.0, 0.0, None)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_udf_and_no_following_frames(spark):
    import sys, os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import queries

    d = "/root/testdata/sf0.001"
    for name, q in queries().items():
        if name.startswith(("k14", "j4_root", "j10_compare", "h4_")):
            continue  # these train models while the plan is built; test_trees checks the plan of a level
        plan = _plan(q(spark, d))
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        # A frame from the current row (or later) to unbounded following is
        # recomputed per row; whole-partition frames are computed once.
        assert not re.search(r"RowFrame, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan), name


def test_series_scan_prunes_columns(spark):
    from __spark_entry__ import queries

    plan = _plan(queries()["g1_interpolate_time"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["event_type", "date", "generation_mw"]
    assert df.count() > 0


def test_evaluate_compares_presets(spark):
    df = _model_fixture(spark)
    x = model.materialize(model.split(df, ["gsp_id"], "date"))
    feats = model.feature_columns(x, exclude=["date", "split", "gsp_id"])
    train = x.filter("split = 'train'")
    scored = {p: model.predict(model.fit(train, feats, preset=p, select=False), x)
              for p in ("extra_trees_tuned", "forest_tuned")}
    table = model.evaluate(scored)
    assert {(r["model"], r["split"]) for r in table.collect()} == {
        (p, s) for p in scored for s in ("train", "test")}
    pts = model.residual_points(scored["forest_tuned"])
    assert pts.columns == ["split", "generation_mw", "pred_generation_mw"] and pts.count() == df.count()


def test_compare_presets_shares_rows_and_scores_in_one_aggregate(spark):
    from gridpv.operators import trees
    from gridpv.operators.trees import TreeParams
    from gridpv.plans import modelling

    df = _model_fixture(spark).filter("day(date) <= 4")
    presets = {"stump": TreeParams(trees=1, depth=1, rate=1.0), "two": TreeParams(trees=2, depth=1, rate=0.5),
               "extra": TreeParams(kind="extra", trees=3, depth=2)}
    made = []
    rows = trees.training_rows
    trees.training_rows = lambda *a: made.append(a[-1]) or rows(*a)
    try:
        metrics, seconds = modelling.compare_presets(df, ["gsp_id"], presets)
    finally:
        trees.training_rows = rows
    assert made == [256, None] and set(seconds) == set(presets)
    assert _plan(metrics).count("partial_var_pop") == 1  # one aggregate for the metrics of all presets
    got = {(r["model"], r["split"]): r for r in metrics.collect()}
    assert set(got) == {(p, s) for p in presets for s in ("train", "test")}
    assert got["stump", "train"]["r2"] > 0.3 and sum(got["stump", s]["n"] for s in ("train", "test")) == df.count()


def test_query_compares_whole_presets(spark, monkeypatch):
    """J10 grows every tree of the four presets."""
    from gridpv import catalog
    from gridpv.operators import trees

    given = []
    monkeypatch.setattr(catalog, "_tree_table", lambda spark, d: None)
    monkeypatch.setattr(catalog.modelling, "compare_presets", lambda table, keys, presets, *a, **k: given.append(presets) or (None, {}))
    catalog.q_j10_compare_presets(spark, "nowhere")
    names = {"boosted_tuned": 50, "forest_tuned": 50, "extra_trees_tuned": 100, "gradient_boosting": 30}
    assert {n: p.trees for n, p in given[0].items()} == names
    assert all(p == trees.TREE_PRESETS[n] for n, p in given[0].items())


def test_evaluate_columns_equals_one_model_at_a_time(spark):
    rows = [("train", float(i), float(i % 3), None if i % 4 else float(i)) for i in range(20)] + [("test", 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "split string, generation_mw double, a double, b double")
    got = sorted(tuple(r) for r in model.evaluate_columns(df, {"A": "a", "B": "b"}).select("model", "split", "n", "r2", "mae", "mse", "rmse").collect())
    want = []
    for name, c in (("A", "a"), ("B", "b")):
        want += [(name, *tuple(r)) for r in model.regression_metrics(df, pred=c).collect()]
    assert [tuple(map(str, r)) for r in got] == sorted(tuple(map(str, r)) for r in want)


def test_split_coverage_and_selection_per_key(spark):
    from gridpv.operators.trees import TreeParams
    from gridpv.plans import modelling

    df = _model_fixture(spark).filter("day(date) <= 4")
    out = modelling.train_per_key(df, ["gsp_id"], params=TreeParams(trees=1, rate=1.0, depth=2), selector=TreeParams(trees=1, depth=2))
    assert "shortwave_radiation" in out.features and out.model.models == 3
    total = 0
    for r in modelling.split_coverage(out.scored, ["gsp_id"]).collect():
        total += r["n_rows"]
        assert r["n_rows"] == r["n_predicted"]
        if r["split"] == "train":  # leaves without shrinkage hold the mean of their rows
            assert abs(r["mean_actual"] - r["mean_predicted"]) < 1e-5
    assert total == df.count() and out.metrics.count() == 6


def test_unparsed_counts(spark):
    from gridpv.functions.columns import parse_ts
    from gridpv.operators import quality

    df = spark.createDataFrame([("k", "2024-01-01"), ("k", "x"), ("k", "31 May"), ("k", None), (None, "x")], "k string, t string")
    got = {r["k"]: (r["n_text"], r["n_unparsed"], r["example"]) for r in quality.unparsed(df, ["t"], parse_ts, ["k"]).collect()}
    assert got == {"k": (3, 2, "31 May"), None: (1, 1, "x")}
    assert quality.unparsed(df.limit(0), ["t"], parse_ts).count() == 0


def test_entry_stands_without_the_text_libraries(spark):
    """A library missing that only the text operators need leaves all other queries."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 72 and out[1:] == ["0", "False"]
