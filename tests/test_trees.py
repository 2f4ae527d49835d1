import math
import random

import pytest
from pyspark.sql import functions as F
from reference_trees import Trainer, binned, borders

from gridpv.operators import trees
from gridpv.operators.trees import SCALE, TreeParams

FEATURES = ["a", "b", "c", "d"]
SCHEMA = "gsp_id int, id long, a double, b double, c double, d int, y double"


def rows_of(seed, n, keys=(1,), missing=0.1):
    """Rows with ties, missing values, a constant-ish and an irrelevant feature."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = rnd.uniform(0, 10), rnd.choice([0.0, 1.0, 2.5, -3.0]), round(rnd.gauss(0, 1), 1), rnd.randint(0, 5)
        y = 3 * a + (5 if b > 1 else -5) * (1 + d) + rnd.gauss(0, 0.5)
        x = [None if rnd.random() < missing else v for v in (a, b, c)]
        if x[0] is None:
            y += 20  # a missing value says something
        out.append((rnd.choice(keys), i, *x, d, y if rnd.random() > 0.02 else None))
    return out


def plain(spark, rows, params, key=None):
    """The reference's splits and predictor for the rows of one key, with Spark's hashes of the row ids."""
    mine = [r for r in rows if r[-1] is not None and (key is None or r[0] == key)]
    ids = spark.createDataFrame([(r[1],) for r in mine], "id long").select("id", F.xxhash64("id").alias("h")).collect()
    hashes = {r["id"]: r["h"] for r in ids}
    xs = [[None if v is None else float(v) for v in r[2:6]] for r in mine]
    if params.kind != "extra":
        xs = binned(xs, params.bins)
    ys = [math.floor(r[-1] * SCALE + 0.5) for r in mine]
    return Trainer(params).fit([(hashes[r[1]], x, y) for r, x, y in zip(mine, xs, ys)])


def splits_of(model, key=None):
    rows = model.splits().collect()
    return sorted(
        (r["tree"], r["level"], r["node"], r["f"], r["threshold"], r["missing_left"], r["gain"], r["cl"], r["cr"])
        for r in rows if key is None or r["model"] == key
    )


SMALL = {
    "boosted_tuned": dict(trees=2, depth=3, bins=16),
    "forest_tuned": dict(trees=3, depth=30, min_leaf=15, min_split=40, bins=32, at_once=2),
    "extra_trees_tuned": dict(trees=3, depth=3),
    "gradient_boosting": dict(trees=2, bins=20),
}


def small(name, **more):
    return trees.replace(trees.TREE_PRESETS[name], **(SMALL[name] | more))


@pytest.mark.parametrize("name", list(SMALL))
def test_equals_plain_trainer(spark, name):
    """Equal splits, thresholds and gains, and equal predictions on 300 rows."""
    rows, p = rows_of(1, 300), small(name)
    df = spark.createDataFrame(rows, SCHEMA)
    model = trees.fit_trees(df, FEATURES, "y", ["id"], params=p)
    splits, predict = plain(spark, rows, p)
    assert splits_of(model) == sorted(splits) and len(splits) >= 6
    scored = {r["id"]: r["p"] for r in trees.predict_trees(model, df, "p").collect()}
    assert len(scored) == 300
    for r in rows:
        assert scored[r[1]] == predict([None if v is None else float(v) for v in r[2:6]])


def _without_l1(p):
    return trees.replace(p, l1=0.0, l2=0.0)


def test_penalties_and_samples_change_the_trees(spark):
    df = spark.createDataFrame(rows_of(2, 200), SCHEMA)
    p = small("boosted_tuned", trees=1, depth=2, rows=1.0, columns=1.0)
    fits = {n: splits_of(trees.fit_trees(df, FEATURES, "y", ["id"], params=q)) for n, q in
            {"tuned": p, "free": _without_l1(p), "rows": trees.replace(p, rows=0.5), "columns": trees.replace(p, columns=0.5)}.items()}
    assert len({str(s) for s in fits.values()}) == 4
    assert len({s[3] for s in fits["columns"]}) <= 2


@pytest.mark.parametrize("name", ["boosted_tuned", "extra_trees_tuned"])
def test_one_model_per_key_equals_single_fits(spark, name):
    keys = (1, 2)
    rows, p = rows_of(3, 300, keys), small(name, depth=2)
    rows += [(None, 1000 + i, *r[2:]) for i, r in enumerate(rows[:40])]  # a missing key is a key of its own
    df = spark.createDataFrame(rows, SCHEMA)
    model = trees.fit_trees(df, FEATURES, "y", ["id"], ["gsp_id"], p)
    assert model.models == 3
    scored = {r["id"]: r["p"] for r in trees.predict_trees(model, df, "p").collect()}
    for key in keys:
        part = df.where(F.col("gsp_id") == key)
        single = trees.fit_trees(part, FEATURES, "y", ["id"], params=p)
        assert splits_of(model, f'{{"gsp_id":{key}}}') == splits_of(single)
        for r in trees.predict_trees(single, part, "p").collect():
            assert scored[r["id"]] == r["p"]


def test_one_pass_over_the_rows_per_level(spark, monkeypatch):
    """However many keys there are, a level is one set of splits from one scan of the rows and one aggregate of them."""
    df = spark.createDataFrame(rows_of(4, 200, range(20)), SCHEMA)
    calls, plans = [], []
    best = trees.best_splits

    def counted(rows, p, features, level=0, columns=None):
        out = best(rows, p, features, level, columns)
        calls.append(level)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(trees, "best_splits", counted)
    model = trees.fit_trees(df, FEATURES, "y", ["id"], ["gsp_id"], small("boosted_tuned", trees=2, depth=2))
    assert model.models == 20 and calls == [0, 1, 0, 1]
    for plan in plans:
        assert plan.count("Generate posexplode") == 1 and "Python" not in plan and "Pandas" not in plan
        # rows are summed up before the only exchange that sees them
        assert plan.count("partial_sum(g") == 1 and plan.count("Exchange hashpartitioning(model") == 3


@pytest.mark.parametrize("name", ["boosted_tuned", "forest_tuned", "extra_trees_tuned"])
def test_partitioning_does_not_matter(spark, name):
    df = spark.createDataFrame(rows_of(5, 150, (1, 2)), SCHEMA)
    p = small(name, trees=1, depth=2)
    fits = [splits_of(trees.fit_trees(x, FEATURES, "y", ["id"], ["gsp_id"], p)) for x in (df.coalesce(1), df.repartition(7))]
    assert fits[0] == fits[1] and fits[0]


def test_forest_node_sizes_and_depth(spark):
    """A chain of ever larger steps needs a split per row, level after level; node sizes keep to the minima."""
    rows = [(1, i, float(i), 0.0, 0.0, 0, float(4**i)) for i in range(12)]
    deep = TreeParams(kind="forest", trees=1, depth=None, bins=None)
    model = trees.fit_trees(spark.createDataFrame(rows, SCHEMA), FEATURES, "y", ["id"], params=deep)
    assert len(model.parts[0][1].levels) == 11
    many = rows_of(6, 300, missing=0.0)
    p = small("forest_tuned", trees=1)
    fitted = trees.fit_trees(spark.createDataFrame(many, SCHEMA), FEATURES, "y", ["id"], params=p)
    for r in fitted.splits().collect():
        assert min(r["cl"], r["cr"]) >= 15 and r["cl"] + r["cr"] >= 40


def test_borders_beyond_the_sent_size_are_joined(spark):
    rows = rows_of(7, 120, (1, 2))
    df = spark.createDataFrame([r for r in rows if r[-1] is not None], SCHEMA)
    raw = df.select("id", trees.model_key(["gsp_id"]).alias("model"), trees.feature_array(FEATURES).alias("x"))
    sent = {r["id"]: list(r["x"]) for r in trees.bin_values(raw, 8).collect()}
    joined = {r["id"]: list(r["x"]) for r in trees.bin_values(raw, 8, sent=0).collect()}
    assert sent == joined
    for key in (1, 2):
        mine = [r for r in rows if r[0] == key and r[-1] is not None]
        want = binned([[None if v is None else float(v) for v in r[2:6]] for r in mine], 8)
        assert [sent[r[1]] for r in mine] == want


def test_borders_of_few_and_many_values(spark):
    values = [-1e300, -2.0, -0.0, 0.0, 1e-300, 5.0, 5.0, 5.0] + [float(i) for i in range(100)]
    rows = spark.createDataFrame([("", [v]) for v in values] + [("", [None])], "model string, x array<double>")
    for bins in (5, 200):
        got = [float(v) for v in trees.bin_borders(rows, bins).first()["borders"]]
        assert got == borders([v + 0.0 for v in values], bins)


def test_missing_and_awkward_rows(spark):
    """NaN is missing, constant and empty features are never split on, unknown keys predict NULL, every row is kept."""
    rows = [(1, i, math.nan if i % 3 else None, 7.0, float(i % 2), 1, float(10 * (i % 2))) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = trees.fit_trees(df, FEATURES, "y", ["id"], ["gsp_id"], TreeParams(trees=1, rate=1.0, depth=2))
    assert {r["feature"] for r in model.splits().collect()} == {"c"}
    more = df.unionByName(spark.createDataFrame([(9, 99, 1.0, 1.0, 1.0, 1, None), (1, 98, None, None, None, None, None)], SCHEMA))
    scored = {r["id"]: r["p"] for r in trees.predict_trees(model, more, "p").collect()}
    assert len(scored) == 42 and scored[99] is None and scored[0] == 0.0 and scored[1] == 10.0 and scored[98] is not None


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = trees.fit_trees(empty, FEATURES, "y", ["id"], ["gsp_id"], TreeParams(trees=2))
    assert model.models == 0 and trees.predict_trees(model, empty, "p").count() == 0


def test_importance_and_selection(spark):
    df = spark.createDataFrame(rows_of(8, 300, missing=0.0), SCHEMA)
    model = trees.fit_trees(df, FEATURES, "y", ["id"], params=small("boosted_tuned"))
    shares = {r["feature"]: r["importance"] for r in model.importance().collect()}
    assert set(shares) == set(FEATURES) and abs(sum(shares.values()) - 1) < 1e-9
    kept = trees.select_by_importance(model)
    assert kept == [f for f in FEATURES if shares[f] >= 0.25] and kept and "c" not in kept


def _level(spark, few=True, **more):
    """The plan of a level of extra trees, and its splits, of rows in one partition."""
    p = small("extra_trees_tuned", trees=2, **more)
    x = F.array("a", "b", "c", F.col("d").cast("double"))
    rows = spark.createDataFrame(rows_of(5, 300), SCHEMA).where("y IS NOT NULL").coalesce(1)
    rows = rows.withColumn("tree", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    rows = rows.select(F.lit("").alias("model"), "tree", x.alias("x"), F.expr(f"-CAST(y * {SCALE} AS LONG)").alias("g"), F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("node"))
    out = trees.best_splits(rows, p, 4, 0, None, 2 if few else None)
    return out._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, out.collect()))


def test_rows_of_extra_trees_are_not_shuffled_to_their_thresholds(spark, monkeypatch):
    """Drawn thresholds go to the rows; the tried features of a node are not sorted out per row and feature."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan, splits = _level(spark)
        _, shuffled = _level(spark, few=False)
        monkeypatch.setattr(trees, "FEW_FEATURES", 0)
        _, sorted_ = _level(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "array_sort" not in plan
    assert splits and splits == shuffled == sorted_


def test_training_rows_are_dealt_to_all_cores(spark):
    """One input partition does not leave the levels to one task."""
    df = spark.createDataFrame(rows_of(6, 400), SCHEMA).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    for bins in (None, 256):
        assert trees.training_rows(df, FEATURES, "y", ["id"], ["gsp_id"], bins).rdd.getNumPartitions() >= cores
