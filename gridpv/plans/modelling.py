"""Split, select features, train, predict and score; J10: compare presets on one shared table."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpv.operators import model, trees
from gridpv.operators.blocks import Packed
from gridpv.operators.trees import Ensemble, TreeParams


def train_and_score(table: DataFrame, keys: Sequence[str], ts: str = "date", preset: str = "boosted_tuned",
                    select: bool = True, key_features: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pooled model over all keys: J1 split per key, J3 selection, fit of the preset
    (J4 by default) on the train rows, J9 predictions for every row, F15 metrics
    per split.  Returns (scored, metrics)."""
    keys = list(keys)
    x = model.split(table, keys, ts)
    x = model.materialize(x)
    exclude = [ts, "split"] + ([] if key_features else keys)
    feats = model.feature_columns(x, exclude=exclude)
    if key_features:  # text keys become features too
        feats += [k for k in keys if k not in feats]
    train = x.filter("split = 'train'")
    m = model.fit(train, feats, preset=preset, select=select)
    scored = model.predict(m, x)
    return scored, model.regression_metrics(scored)


@dataclass
class Trained:
    """``model`` per key, its ``features``, every row with split and prediction, and metrics per key and split."""

    model: Ensemble
    features: list[str]
    scored: DataFrame
    metrics: DataFrame


def _sides(table: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str]) -> DataFrame:
    return model.materialize(model.split(table, keys, ts, tiebreak=tiebreak))


def train_per_key(table: DataFrame, keys: Sequence[str], ts: str = "date", params: TreeParams | str = "boosted_tuned",
                  selector: TreeParams | str | None = None, exclude: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> Trained:
    """K14 with one model per key, all keys in one pass per level: J1 split, J3 selection (features whose
    importance in a pooled ``selector`` is at least the mean), fit on the train rows, predictions for every row.

    Missing features need no imputation: each split learns the side of missing values.
    """
    keys, tiebreak = list(keys), list(tiebreak)
    x = _sides(table, keys, ts, tiebreak)
    features = model.feature_columns(x, exclude=[ts, "split", *keys, *tiebreak, *exclude])
    train, ids = x.filter("split = 'train'"), [*keys, ts, *tiebreak]
    if selector is not None:
        features = trees.select_by_importance(trees.fit_trees(train, features, model.TARGET, ids, params=selector))
    fitted = trees.fit_trees(train, features, model.TARGET, ids, keys, params)
    scored = trees.predict_trees(fitted, x, model.PRED)
    return Trained(fitted, features, scored, model.regression_metrics(scored, by=[*keys, "split"]))


def compare_presets(table: DataFrame, keys: Sequence[str], presets: dict[str, TreeParams | str], ts: str = "date",
                    exclude: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> tuple[DataFrame, dict[str, float]]:
    """Metrics per model and split of several presets, and the seconds that each fit took.

    The split is made once; presets that need the same bins share one table of packed training rows; each preset
    adds its column of predictions, and one aggregate over these gives all metrics.
    """
    keys, tiebreak = list(keys), list(tiebreak)
    x = _sides(table, keys, ts, tiebreak)
    features = model.feature_columns(x, exclude=[ts, "split", *keys, *tiebreak, *exclude])
    train, ids = x.filter("split = 'train'"), [*keys, ts, *tiebreak]
    shared: dict[int | None, Packed] = {}
    columns, seconds, scored = {}, {}, trees.spread(x)
    for number, (name, preset) in enumerate(presets.items()):
        p = trees.TREE_PRESETS[preset] if isinstance(preset, str) else preset
        bins = None if p.kind == "extra" else p.bins
        began = time.perf_counter()
        if bins not in shared:
            shared[bins] = trees.packed_rows(trees.training_rows(train, features, model.TARGET, ids, keys, bins), features, bins)
        fitted = trees.fit_trees(train, features, model.TARGET, ids, keys, p, binned=shared[bins])
        columns[name] = f"_pred_{number}"
        scored = trees.predict_trees(fitted, scored, columns[name])
        seconds[name] = time.perf_counter() - began
    return model.evaluate_columns(scored, columns), seconds


def split_coverage(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and split: rows, predicted rows, and the means of the label and of the prediction where both are there."""
    both = F.col(model.TARGET).isNotNull() & F.col(model.PRED).isNotNull()
    mean = lambda c: F.avg(F.when(both, F.col(c)))
    return scored.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(model.PRED).alias("n_predicted"),
        mean(model.TARGET).alias("mean_actual"), mean(model.PRED).alias("mean_predicted"),
    )
