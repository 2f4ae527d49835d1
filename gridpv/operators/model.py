"""Modelling on Spark ML.

The reference fits scikit-learn / XGBoost estimators on one machine; here the
same presets are expressed with ``pyspark.ml`` tree regressors, trained
distributedly.  Differences: no L1/L2 penalties on trees, no random split
thresholds, no minimum split size (SURVEY §7.5), a depth of 30 where the reference
sets no limit, and missing features imputed (see :func:`preparation`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.functions.columns import epoch_us, quote
from gridpv.operators.joins import small_side

TARGET = "generation_mw"
PRED = "pred_generation_mw"


# --------------------------------------------------------------------------- J1 split


def split(df: DataFrame, keys: Sequence[str], ts: str = "date", test_size: float = 0.2, seed: int = 101,
          tiebreak: Sequence[str] = (), bucket_bits: int = 12) -> DataFrame:
    """Per key, rows ordered by ``md5(key|epoch_us|seed)``; the first
    ``ceil(test_size * n)`` are ``test``, the rest ``train``.

    Deterministic and stable under repartitioning.  Every row is kept: a missing key is a
    key of its own, written as '' in the hash.  Rows are counted per key and first ``bucket_bits`` bits of
    the hash (uniform; a multiple of 4); buckets before the boundary are test, those after it
    train, and only the one bucket of a key that holds the boundary is ranked.
    """
    if bucket_bits <= 0 or bucket_bits % 4:
        raise ValueError("bucket_bits must be a positive multiple of 4")
    from pyspark.sql import Window

    keys = list(keys)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    h = F.md5(F.concat_ws("|", *parts, epoch_us(ts).cast("string"), F.lit(str(seed))))
    x = df.withColumns({"_h": h}).withColumn("_b", F.conv(F.substring("_h", 1, bucket_bits // 4), 16, 10).cast("long"))
    counts = x.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n_test = F.ceil(F.sum("_n").over(per_key) * F.lit(test_size))
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_n",
        (n_test - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_need"),
    )
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = x.join(counts, same)
    split_at = (F.col("_need") > 0) & (F.col("_need") < F.col("_n"))
    whole = x.filter(~split_at).withColumn("split", F.when(F.col("_need") > 0, "test").otherwise("train"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", ts, *tiebreak)
    edge = x.filter(split_at).withColumn("_r", F.row_number().over(inside))
    edge = edge.withColumn("split", F.when(F.col("_r") <= F.col("_need"), "test").otherwise("train")).drop("_r")
    return whole.unionByName(edge).select(*df.columns, "split")


# --------------------------------------------------------------------------- J2 scale


def scale(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), fit_on: str | None = "train",
          split_col: str = "split") -> DataFrame:
    """``(x - mean) / std_pop`` with statistics of the ``fit_on`` rows, per key.

    The statistics are one row per key, joined back on the key.
    """
    keys = list(keys)
    base = df.filter(F.col(split_col) == fit_on) if fit_on else df
    stats = base.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols]
    )
    if keys:
        x = df.join(small_side(stats), keys, "left")
    else:
        # One row of statistics, as StandardScaler.fit returns to the driver.
        row = stats.first().asDict()
        x = df.withColumns({k: F.lit(v).cast("double") for k, v in row.items()})
    new = {c: F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.nullif(F.col(f"_sd_{c}"), F.lit(0.0))) for c in cols}
    return x.withColumns(new).drop(*[f"_{s}_{c}" for c in cols for s in ("mu", "sd")])


# --------------------------------------------------------------------------- F15 metrics


def regression_metrics(df: DataFrame, actual: str = TARGET, pred: str = PRED, by: Sequence[str] = ("split",),
                       places: int = 3) -> DataFrame:
    """R², MAE, MSE, RMSE per group, rounded.

    ``R² = 1 - SSE / SST`` with ``SST = n * var_pop(actual)``; rows without
    both values are skipped.
    """
    by = list(by)
    x = df.filter(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    e = F.col(pred) - F.col(actual)
    agg = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(actual).alias("_var"),
        F.avg(F.abs(e)).alias("_mae"),
        F.avg(e * e).alias("_mse"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))
    from gridpv.functions.columns import round_to

    return agg.select(
        *by, "n",
        round_to(r2, places).alias("r2"),
        round_to("_mae", places).alias("mae"),
        round_to("_mse", places).alias("mse"),
        round_to(F.sqrt("_mse"), places).alias("rmse"),
    )


# --------------------------------------------------------------------------- J3-J9 estimators

# The reference's estimator presets (tuned winner and alternatives).
PRESETS = {
    "boosted_tuned": dict(kind="gbt", maxIter=50, stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
                          featureSubsetStrategy="0.8", seed=42),
    "boosted_default": dict(kind="gbt", maxIter=100, stepSize=0.3, maxDepth=6, seed=42),
    "selector": dict(kind="gbt", maxIter=50, stepSize=0.3, maxDepth=6, seed=42),
    "forest_default": dict(kind="rf", numTrees=100, maxDepth=30, seed=42),
    "forest_tuned": dict(kind="rf", numTrees=50, maxDepth=30, minInstancesPerNode=20, seed=42),
    "extra_trees_default": dict(kind="rf", numTrees=100, maxDepth=30, bootstrap=False,
                                featureSubsetStrategy="all", seed=42),
    "extra_trees_tuned": dict(kind="rf", numTrees=100, maxDepth=4, minInstancesPerNode=8, bootstrap=False,
                              featureSubsetStrategy="sqrt", seed=42),
    "gradient_boosting": dict(kind="gbt", maxIter=30, stepSize=0.15, maxDepth=2, minInstancesPerNode=5,
                              subsamplingRate=0.9, featureSubsetStrategy="sqrt", seed=42),
    "gradient_boosting_default": dict(kind="gbt", maxIter=100, stepSize=0.1, maxDepth=3, seed=42),
}

# The estimator each reference pipeline uses for feature selection.
SELECTORS = {
    "boosted_tuned": "selector",
    "boosted_default": "boosted_default",
    "forest_default": "forest_default",
    "forest_tuned": "forest_default",
    "extra_trees_default": "extra_trees_default",
    "extra_trees_tuned": "extra_trees_default",
    "gradient_boosting": "gradient_boosting_default",
}


def estimator(preset: str = "boosted_tuned", features: str = "features", label: str = TARGET,
              prediction: str = PRED, **changes):
    """The estimator of a preset, with parameters of the preset replaced by ``changes``."""
    p = PRESETS[preset] | changes
    kind = p.pop("kind")
    if p.get("maxDepth", 5) > 30:
        raise ValueError("trees deeper than 30 levels are not supported")
    # Node-id caching pays off for deep trees only (measured ~2x slower at depth 6);
    # checkpoints every 10 iterations keep the lineage of boosting short.
    common = dict(featuresCol=features, labelCol=label, predictionCol=prediction, maxBins=64,
                  checkpointInterval=10, cacheNodeIds=p.get("maxDepth", 5) > 10)
    if kind == "gbt":
        return GBTRegressor(**common, **p)
    return RandomForestRegressor(**common, **p)


def feature_columns(df: DataFrame, target: str = TARGET, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric columns but the target and ``exclude`` (the reference's feature set)."""
    from pyspark.sql import types as T

    num = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, num) and f.name != target and f.name not in exclude]


def preparation(train: DataFrame, features: Sequence[str], out: str = "_all_features") -> Pipeline:
    """Stages that turn rows into one vector, whatever is missing.

    The reference's boosted trees take missing values; Spark's do not.  A missing number becomes the
    median of the train rows (0 if none is present) and, where train rows lack it, an indicator feature
    says so.  Text features are indexed by frequency; values not seen in training get an index of
    their own.
    """
    from pyspark.sql import types as T

    features = list(features)
    text = [c for c in features if isinstance(train.schema[c].dataType, T.StringType)]
    numbers = [c for c in features if c not in text]
    value = lambda c: f"nanvl(CAST({quote(c)} AS DOUBLE), NULL)"
    seen = train.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"count({value(c)})").alias(f"c{i}") for i, c in enumerate(numbers)])
    row = seen.first()
    gaps = [c for i, c in enumerate(numbers) if row[f"c{i}"] < row["n"]]
    empty = [c for i, c in enumerate(numbers) if row[f"c{i}"] == 0]
    columns = [f"{'CAST(0 AS DOUBLE)' if c in empty else value(c)} AS `_imp_{c}`" for c in numbers]
    columns += [f"CAST({value(c)} IS NULL AS DOUBLE) AS `_gap_{c}`" for c in gaps]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")] if columns else []
    filled = [f"_imp_{c}" for c in numbers if c not in empty]
    if filled:
        stages.append(Imputer(strategy="median", inputCols=filled, outputCols=filled))
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"_idx_{c}" for c in text], handleInvalid="keep"))
    names = [f"_imp_{c}" for c in numbers] + [f"_idx_{c}" for c in text] + [f"_gap_{c}" for c in gaps]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol=out)])


def _important(vectors: DataFrame, n: int, preset: str, label: str) -> list[int]:
    """Positions of the vector whose importance is at least the mean."""
    model = estimator(preset, features="_all_features", label=label, prediction="_fs_pred").fit(vectors)
    imp = model.featureImportances.toArray()
    mean = float(imp.mean()) if len(imp) else 0.0
    return [i for i, v in enumerate(imp) if v >= mean] or list(range(n))


def _vectors(prepared: PipelineModel, train: DataFrame, label: str) -> DataFrame:
    """The training vectors, kept while models are fitted on them."""
    rows = prepared.transform(train).filter(F.col(label).isNotNull())
    return rows.select("_all_features", label).persist()


def _feature_names(prepared: PipelineModel) -> list[str]:
    names = [c[5:] if c[:5] in ("_imp_", "_idx_") else f"{c[5:]}_missing" for c in prepared.stages[-1].getInputCols()]
    return names


def select_features(train: DataFrame, features: Sequence[str], preset: str = "selector",
                    label: str = TARGET) -> list[str]:
    """Fit a tree model; keep features with importance >= mean importance."""
    prepared = preparation(train, features).fit(train)
    vectors = _vectors(prepared, train, label)
    names = _feature_names(prepared)
    keep = [names[i] for i in _important(vectors, len(names), preset, label)]
    vectors.unpersist()
    return keep


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """H4: importance per selected feature, descending."""
    names = _feature_names(model.stages[0])
    if len(model.stages) > 2:
        names = [names[i] for i in model.stages[1].getIndices()]
    imp = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, (float(v) for v in imp)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def fit(train: DataFrame, features: Sequence[str], preset: str = "boosted_tuned", select: bool = True,
        label: str = TARGET) -> PipelineModel:
    """Prepare the features, optionally select them by importance (with the selector the
    reference pairs with this preset), fit the preset.  Rows without a label are not used.

    The reference's forest pipelines also standard-scale first; tree splits
    (and Spark's quantile binning) do not change under a per-feature monotone
    transform, so that step is left out.  Training data should be materialised
    first (see :func:`materialize`).  The vectors are made once for all fits.
    """
    prepared = preparation(train, list(features)).fit(train)
    vectors = _vectors(prepared, train, label)
    n = len(prepared.stages[-1].getInputCols())
    keep = _important(vectors, n, SELECTORS.get(preset, "selector"), label) if select else list(range(n))
    slicer = VectorSlicer(inputCol="_all_features", outputCol="features", indices=keep)
    tree = estimator(preset, label=label).fit(slicer.transform(vectors))
    vectors.unpersist()
    return PipelineModel(stages=[prepared, slicer, tree])


def predict(model: PipelineModel, df: DataFrame, pred: str = PRED) -> DataFrame:
    """Predictions for every row (train and test together), also where features are missing."""
    return model.transform(df).select(*[c for c in df.columns if c != pred], pred)


def evaluate(scored: dict[str, DataFrame], actual: str = TARGET, pred: str = PRED) -> DataFrame:
    """Metrics per model and split, one table."""
    out = None
    for name, df in scored.items():
        m = regression_metrics(df, actual, pred).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def evaluate_columns(df: DataFrame, preds: dict[str, str], actual: str = TARGET, by: Sequence[str] = ("split",)) -> DataFrame:
    """J10 for models whose predictions are columns of one table (model name -> column): all metrics in one
    aggregate.  Rows without both values are skipped per model."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("_pred")) for name, c in preds.items()]))
    long = df.select(*by, F.col(actual).alias("_actual"), each.alias("_m")).select(*by, "_actual", "_m.*")
    return regression_metrics(long, "_actual", "_pred", by=["model", *by])


def residual_points(df: DataFrame, actual: str = TARGET, pred: str = PRED, fraction: float | None = None,
                    seed: int = 42) -> DataFrame:
    """Actual-vs-predicted pairs per split (optionally sampled for plotting)."""
    x = df.select("split", actual, pred)
    return x.sample(fraction=fraction, seed=seed) if fraction else x


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before iterative training: a reliable checkpoint in the
    session's ``spark.checkpoint.dir`` (survives executor loss)."""
    from gridpv.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

