"""Trees grown from packed rows equal those of the plain trainer and of the SQL levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference_trees import spark_hash, uniform
from test_trees import FEATURES, SCHEMA, SMALL, plain, rows_of, small

from gridpv.operators import blocks, trees
from gridpv.operators.trees import SCALE, TreeParams


def fitted(df, p, keys=()):
    bins = None if p.kind == "extra" else p.bins
    packed = trees.packed_rows(trees.training_rows(df, FEATURES, "y", ["id"], keys, bins), FEATURES, bins)
    return trees.fit_trees(df, FEATURES, "y", ["id"], keys, p, binned=packed)


def scores(model, df):
    return {r["id"]: r["p"] for r in trees.predict_trees(model, df, "p").collect()}


@pytest.fixture
def cut_small(monkeypatch):
    """Blocks, nodes of a task, groups and sent trees of a few rows."""
    for name, n in {"BLOCK": 16, "HELD": 40, "NODE_ROWS": 60, "GROUP_ROWS": 30, "GROUP_CELLS": 1, "SENT_BYTES": 1, "HELD_BYTES": 1}.items():
        monkeypatch.setattr(blocks, name, n)


def check_plain(spark, name):
    rows, p = rows_of(1, 300), small(name)
    df = spark.createDataFrame(rows, SCHEMA)
    model = fitted(df, p)
    assert isinstance(model, blocks.BlockEnsemble)
    _, predict = plain(spark, rows, p)
    got = scores(model, df)
    assert len(got) == 300 and len(set(got.values())) > 5
    for r in rows:
        assert got[r[1]] == predict([None if v is None else float(v) for v in r[2:6]])
    return model


def test_equals_plain_trainer(spark):
    check_plain(spark, "boosted_tuned")


@pytest.mark.parametrize("name", list(SMALL))
def test_cuts_do_not_matter(spark, cut_small, name):
    model = check_plain(spark, name)
    assert name == "extra_trees_tuned" or len(model.parts) > 1


@pytest.mark.parametrize("name", ["forest_tuned", "extra_trees_tuned"])
def test_keys_equal_the_sql_levels(spark, name):
    """Models per key, a missing key, a key without rows to train from and rows without label, twice the same id, infinite values."""
    rows, p = rows_of(3, 240, (1, 2)), small(name, trees=2, depth=2)
    rows += [(None, 1000 + i, *r[2:]) for i, r in enumerate(rows[:40])]
    far = math.inf if p.kind == "extra" else 1e9
    rows += [(1, 2000, far, -far, 0.0, 1, 5.0), (1, 2000, -far, math.nan, -0.0, 1, 7.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    more = df.unionByName(spark.createDataFrame([(9, 3000, 1.0, 1.0, 1.0, 1, None)], SCHEMA)).where("id <> 2000 OR a > 0")
    got = scores(fitted(df, p, ["gsp_id"]), more)
    want = scores(trees.fit_trees(df, FEATURES, "y", ["id"], ["gsp_id"], p), more)
    assert got == want and got[3000] is None and len(got) == 282


def test_deep_forest_and_no_rows(spark):
    """A chain of ever larger steps needs a split per row; without rows there is no model."""
    rows = [(1, i, float(i), 0.0, 0.0, 0, float(4**i)) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = TreeParams(kind="forest", trees=1, depth=None)
    assert scores(fitted(df, p), df) == {i: float(4**i) for i in range(12)}
    for name in SMALL:
        assert scores(fitted(df.limit(0), small(name)), df) == dict.fromkeys(range(12))


def test_sums_are_exact():
    """Sums of numbers beyond the exact doubles, many to a cell."""
    rng = np.random.default_rng(1)
    cell = rng.integers(0, 3, 500)
    for most in (1 << 20, 1 << 52):
        g = rng.integers(-most, most, 500)
        got = blocks.added(cell, blocks.exact(g), 4)
        assert got.tolist() == [sum(int(v) for v in g[cell == c]) for c in range(4)]


def test_hashes_and_samples():
    for values in ((42, 3, 7), (-5, 1 << 40, -(1 << 62))):
        assert blocks.chain(*values) == spark_hash(*values)
        ids = blocks.mixed(np.array([values[-1]] * 2))
        assert blocks.uniforms(blocks.chain(*values[:-1]), ids).tolist() == [uniform(*values)] * 2


def test_too_large_labels_are_an_error(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 0, 1.5 * (-1) ** i * 2.0**40) for i in range(6)], SCHEMA)
    for p in (TreeParams(kind="forest", trees=1, depth=2), TreeParams(kind="extra", trees=1, depth=2)):
        with pytest.raises(Exception, match=r"beyond 2 \*\* 42"):
            fitted(df, p)


def test_what_blocks_cannot_hold_grows_by_levels(spark, monkeypatch):
    """Raw values of a forest, tried features below its nodes, and more models than the driver takes."""
    df = spark.createDataFrame(rows_of(4, 60, (1, 2)), SCHEMA)
    for p in (TreeParams(kind="forest", trees=1, depth=2, bins=None), TreeParams(kind="forest", trees=1, depth=2, node_columns=1)):
        assert isinstance(fitted(df, p, ["gsp_id"]), trees.Ensemble)
    monkeypatch.setattr(trees, "LOCAL", 1)
    assert isinstance(fitted(df, TreeParams(trees=1, depth=1), ["gsp_id"]), trees.Ensemble)


def test_compare_presets_grows_from_blocks(spark, monkeypatch):
    """J10 makes no query per level of a tree, and gives the metrics that the SQL levels give."""
    from gridpv.plans import modelling

    df = spark.createDataFrame(rows_of(5, 200, (1, 2)), SCHEMA).withColumnRenamed("y", "generation_mw").withColumn("date", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id)"))
    presets = {name: small(name, trees=1, depth=1) for name in SMALL}
    levels = []
    best = trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda *a, **k: levels.append(1) or best(*a, **k))
    got = modelling.compare_presets(df, ["gsp_id"], presets, tiebreak=["id"])[0].collect()
    assert not levels
    monkeypatch.setattr(trees.blocks, "fits", lambda *a: False)
    want = modelling.compare_presets(df, ["gsp_id"], presets, tiebreak=["id"])[0].collect()
    assert levels and sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 8
    assert SCALE == blocks.SCALE
