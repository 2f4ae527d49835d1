"""Regression trees grown level by level with DataFrame aggregates (J3-J9, one model per key or one pooled model).

Each level of all trees of all models is one aggregate of the rows, keyed by (model, tree, node, feature,
value): sums of gradients and weights.  Splits are chosen from these sums; no row reaches the driver.
The same code grows boosted trees (second order, L1/L2 penalties, a column sample per tree, a
learned direction for missing values), forests (weights by hash instead of a bootstrap draw, a split minimum,
any depth) and extremely randomised trees (one random threshold per node and feature).

Labels, gradients and leaf values are whole numbers of ``1 / SCALE``, so sums do not depend on the order of the
rows, and sampling goes by hashes of row ids: a fit is the same however the rows are partitioned.
Labels whose absolute sum exceeds 2 ** 42 make the sums overflow, which is an error, not a wrong result.

Rules.  Features are numbers; NULL and NaN are missing.  Rows without label are not used.  Ties between splits go
to the lower feature, then the lower threshold, then missing values to the right.  A row goes left if its
value is at most the threshold.  Rows that repeat an id are sampled alike.  A model key may be missing; it is a key of
its own.  Rows of a model without training rows are predicted as NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpv.functions.columns import quote
from gridpv.operators import blocks
from gridpv.session import checkpoint_dir

#: Labels and leaf values are whole numbers of this fraction of a unit.
SCALE = 1 << 20
#: Splits of a level that pass through the driver (and are broadcast to the rows); more stay in a checkpoint.
LOCAL = 100_000
#: Bytes of bin borders that are sent to the workers; more are joined to the rows.
SENT_BORDERS = 64 << 20
#: Levels of a deep tree, and rounds of boosting, after which the lineage is cut.
CUT_LEVELS, CUT_ROUNDS = 8, 5

#: Up to so many features the tried ones are told by comparing hashes, beyond by sorting them once per row.
FEW_FEATURES = 32

_NODE = ["model", "tree", "node"]


@dataclass(frozen=True)
class TreeParams:
    """``trees`` rounds of boosting, or trees of a forest; ``depth`` None means no limit.

    ``rows``: share of rows per tree.  ``columns``: share of features per tree.  ``node_columns``: features tried per
    node (a number, "sqrt", or None for all).  ``min_leaf`` and ``min_split`` count rows, ``min_weight`` weights.
    ``bins``: values per feature that are told apart (None: all).  ``bootstrap``: Poisson weights by hash.
    """

    kind: str = "boosted"  # boosted, forest, extra
    trees: int = 50
    rate: float = 0.3
    depth: int | None = 6
    rows: float = 1.0
    columns: float = 1.0
    node_columns: int | str | None = None
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 0.0
    min_leaf: int = 1
    min_split: int = 2
    bootstrap: bool = False
    bins: int | None = 256
    at_once: int = 10
    seed: int = 42


# The reference's estimator presets (tuned winner and alternatives).
_XGB = TreeParams(l2=1.0, min_weight=1.0, min_gain=1e-6)
TREE_PRESETS = {
    "boosted_tuned": replace(_XGB, rate=0.05, rows=0.8, columns=0.8, l1=1.0),
    "boosted_default": replace(_XGB, trees=100),
    "selector": _XGB,
    "forest_default": TreeParams(kind="forest", trees=100, depth=None, bootstrap=True),
    "forest_tuned": TreeParams(kind="forest", depth=30, min_leaf=20, min_split=30, bootstrap=True),
    "extra_trees_default": TreeParams(kind="extra", trees=100, depth=None),
    "extra_trees_tuned": TreeParams(kind="extra", trees=100, depth=4, min_leaf=8, node_columns="sqrt"),
    "gradient_boosting": TreeParams(trees=30, rate=0.15, depth=2, min_leaf=5, rows=0.9, node_columns="sqrt"),
    "gradient_boosting_default": TreeParams(trees=100, rate=0.1, depth=3),
}


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, dealt to one task per core at least.  Levels cost time per row and feature, not per byte: partitions cut
    by bytes (one row group of a file, a small exchange) would leave them to a few tasks."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), *by)


def _hash(seed: int, *parts: Column | str) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *[F.col(p).cast("long") if isinstance(p, str) else p.cast("long") for p in parts])


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from whole-number columns: the 53 low bits of their hash."""
    return _hash(seed, *parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _fixed(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


# --------------------------------------------------------------------------- rows


def model_key(keys: Sequence[str]) -> Column:
    """One text for the key columns; a missing key is a key of its own.  '' for a pooled model."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def feature_array(features: Sequence[str]) -> Column:
    """The features as an array of numbers, NULL where missing."""
    value = lambda c: F.expr(f"nanvl(CAST({quote(c)} AS DOUBLE), CAST(NULL AS DOUBLE)) + 0.0D")
    return F.array(*[value(c) for c in features])


def bin_borders(rows: DataFrame, bins: int) -> DataFrame:
    """Per (model, f) the sorted array ``borders`` of the greatest values of the bins: all values if there
    are at most ``bins``, else those where the running count passes a multiple of ``n / bins``.

    Values are counted first; their running counts go by cells of 1/64 of an octave (one small table of cells per
    feature), so no task orders all values of a feature.
    """
    values = rows.select("model", F.posexplode("x").alias("f", "v")).where("v IS NOT NULL")
    octave = F.floor(F.log2(F.abs("v")) * 64) + 100_000
    cell = F.when(F.col("v") == 0, F.lit(0)).when(F.col("v") > 0, octave).otherwise(-octave)
    counted = values.groupBy("model", "f", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("cell", cell)
    of, key = Window.partitionBy("model", "f"), ["model", "f", "cell"]
    before = of.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy(*key).agg(F.sum("c").alias("held"), F.count(F.lit(1)).alias("kinds"))
    cells = cells.select(
        *key, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("below"), F.sum("held").over(of).alias("n"), F.sum("kinds").over(of).alias("kinds")
    )
    within = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("c").over(within)).join(cells, key)
    ranked = ranked.withColumn("upto", F.col("upto") + F.col("below"))
    step = lambda c: F.floor(c * bins / F.col("n"))
    edge = (F.col("kinds") <= bins) | (step(F.col("upto")) > step(F.col("upto") - F.col("c")))
    return ranked.where(edge).groupBy("model", "f").agg(F.array_sort(F.collect_list("v")).alias("borders"))


def bin_values(rows: DataFrame, bins: int, sent: int = SENT_BORDERS) -> DataFrame:
    """``rows`` (model, x, ...) with each value replaced by the greatest of its bin."""
    borders = _cut(bin_borders(rows, bins))
    size = borders.agg(F.coalesce(F.sum(F.size("borders")), F.lit(0))).first()[0] * 8
    if size > sent:
        # beyond the bound: one row per model, joined; the first border that is not below the value
        nested = borders.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("f", "borders"))).alias("_borders"))
        joined = rows.join(nested, "model", "left")
        up = "transform(x, (v, i) -> CASE WHEN v IS NOT NULL THEN element_at(filter(_borders[i], b -> b >= v), 1) END)"
        return joined.withColumn("x", F.expr(up)).select(*rows.columns)
    held = {}
    for r in borders.toArrow().to_pylist():
        held.setdefault(r["model"], {})[r["f"]] = np.array(r["borders"])
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            column = batch.column("x")
            models = batch.column("model").to_pylist()
            offsets = column.offsets
            n = len(column.value_lengths()[0:1]) and int(column.value_lengths()[0].as_py())
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(models), n) if len(models) else np.zeros((0, n))
            coded = pa.array(models).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            out = values.copy()
            for code, model in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero(which == code)
                for f, edges in shared.value.get(model, {}).items():
                    v = values[mine, f]
                    some = ~np.isnan(v)
                    out[mine[some], f] = edges[np.searchsorted(edges, v[some])]
            new = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (len(models) + 1) * n, n, dtype=np.int32)) if n else offsets, pa.array(out.ravel(), from_pandas=True)
            )
            arrays = [new if name == "x" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


# --------------------------------------------------------------------------- one level


# Written as SQL text: a level is one query, analysed once (a chain of DataFrame calls costs more than its job).


def _soft(g: str, p: TreeParams) -> str:
    """The gradient sum less the L1 penalty."""
    g = f"CAST({g} AS DOUBLE)"
    return f"signum({g}) * greatest(abs({g}) - {p.l1 * SCALE!r}D, 0.0D)" if p.l1 else g


def _worth(g: str, w: str, p: TreeParams) -> str:
    return f"({_soft(g, p)}) * ({_soft(g, p)}) / (CAST({w} AS DOUBLE) + {float(p.l2)!r}D)"


def _leaf(g: str, w: str, p: TreeParams) -> str:
    rate = p.rate if p.kind == "boosted" else 1.0
    return f"CAST(floor(-({_soft(g, p)}) / (CAST({w} AS DOUBLE) + {float(p.l2)!r}D) * {float(rate)!r}D + 0.5D) AS BIGINT)"


def _tried(p: TreeParams, features: int) -> int:
    if p.node_columns is None:
        return features
    n = int(features**0.5) if p.node_columns == "sqrt" else int(p.node_columns)
    return min(max(n, 1), features)


def _each(text: str) -> str:
    """``text`` for the sums of gradients, weights and rows."""
    return ", ".join(text.format(n=n) for n in "gwc")


def _candidates(p: TreeParams, features: int, level: int, columns: Sequence[int] | None, few: bool = False) -> str:
    """CTEs up to ``cand``: per node, feature and threshold ``v`` the sums to its left (gl, wl, cl), of missing values
    (gm, wm, cm) and of the node (gt, wt, ct).  ``few``: the thresholds drawn for extra trees fit in every task, so the
    rows are not shuffled to them."""
    tests = ["true"]
    if columns is not None and len(columns) < features:
        tests.append(f"f IN ({', '.join(map(str, columns))})")
    source = "{rows}"
    if (tried := _tried(p, features)) < features:
        # the features of the least hashes: one array of hashes per row, not a sort per row and feature
        hashes = ", ".join(f"xxhash64({p.seed}L, tree, {level}L, node, {i}L)" for i in range(features))
        source = f"(SELECT *, array({hashes}) AS h FROM {{rows}})"
        if features <= FEW_FEATURES:
            before = " + ".join(f"IF(h[{i}] < h[f] OR h[{i}] = h[f] AND {i} < f, 1, 0)" for i in range(features))
            tests.append(f"{before} < {tried}")
        else:
            order = "array_sort(transform(h, (value, i) -> struct(value, i)))"
            source = f"(SELECT *, slice({order}, 1, {tried}).i AS tried FROM {source})"
            tests.append("array_contains(tried, f)")
    node, spot = "model, tree, node", "model, tree, node, f"
    long = f"long AS (SELECT {node}, g, w, 1L AS c, f, v FROM {source} LATERAL VIEW posexplode(x) AS f, v WHERE {' AND '.join(tests)})"
    if p.kind == "extra":
        u = f"(xxhash64({p.seed + 1}L, tree, {level}L, node, CAST(f AS BIGINT)) & {(1 << 53) - 1}L) / {float(1 << 53)!r}D"
        hint = "/*+ BROADCAST(picked) */ " if few else ""
        return f"""{long},
        ends AS (SELECT {spot}, min(v) AS lo, max(v) AS hi FROM long GROUP BY {spot}),
        drawn AS (SELECT {spot}, lo, hi, lo + {u} * (hi - lo) AS at FROM ends WHERE lo < hi),
        picked AS (SELECT {spot}, IF(at < hi, at, lo) AS at FROM drawn),
        cand AS (SELECT {hint}{spot}, at AS v, {_each("sum(IF(v <= at, {n}, 0L)) AS {n}l")}, {_each("sum(IF(v IS NULL, {n}, 0L)) AS {n}m")},
          {_each("sum({n}) AS {n}t")} FROM long JOIN picked USING ({spot}) GROUP BY {spot}, at)"""
    return f"""{long},
        hist AS (SELECT {spot}, v, {_each("sum({n}) AS {n}")} FROM long GROUP BY {spot}, v),
        cand AS (SELECT {spot}, v, {_each("sum(IF(v IS NOT NULL, {n}, 0L)) OVER upto AS {n}l")},
          {_each("sum(IF(v IS NULL, {n}, 0L)) OVER whole AS {n}m")}, {_each("sum({n}) OVER whole AS {n}t")}
          FROM hist WINDOW whole AS (PARTITION BY {spot}), upto AS (PARTITION BY {spot} ORDER BY v ROWS UNBOUNDED PRECEDING))"""


def best_splits(rows: DataFrame, p: TreeParams, features: int, level: int = 0, columns: Sequence[int] | None = None,
                at_most: int | None = None) -> DataFrame:
    """The split of each node that has one: f, threshold, missing_left, gain, and the rows (cl, cr) and
    values (vl, vr) of both sides.

    ``rows``: model, tree, node, x, g (gradient) and w (weight).  gain is half the loss that the split saves.
    ``at_most``: the number of nodes, if it is bounded.
    """
    least = max(p.min_leaf, 1)
    saved = f"({_worth('gl', 'wl', p)} + {_worth('gr', 'wr', p)} - {_worth('gt', 'wt', p)}) * {0.5 / SCALE**2!r}D"
    few = at_most is not None and at_most * _tried(p, features) <= LOCAL
    query = f"""WITH {_candidates(p, features, level, columns, few)},
        sided AS (SELECT model, tree, node, f, v, missing_left, {_each("{n}t")}, {_each("{n}l + IF(missing_left, {n}m, 0L) AS {n}l")}
          FROM cand LATERAL VIEW explode(IF(cm > 0, array(false, true), array(false))) AS missing_left
          WHERE v IS NOT NULL AND ct >= {p.min_split}),
        both AS (SELECT *, {_each("{n}t - {n}l AS {n}r")} FROM sided),
        valued AS (SELECT *, {saved} AS gain FROM both
          WHERE cl >= {least} AND cr >= {least} AND wl >= {float(p.min_weight)!r}D AND wr >= {float(p.min_weight)!r}D),
        best AS (SELECT model, tree, node, max_by(struct(f, v, missing_left, gain, cl, cr, gl, wl, gr, wr), struct(gain, -f, -v, NOT missing_left)) AS s
          FROM valued WHERE gain > {float(p.min_gain)!r}D GROUP BY model, tree, node)
        SELECT model, tree, node, s.f, s.v AS threshold, s.missing_left, s.gain, s.cl, s.cr,
          {_leaf('s.gl', 's.wl', p)} AS vl, {_leaf('s.gr', 's.wr', p)} AS vr FROM best"""
    return rows.sparkSession.sql(query, rows=rows)


#: 0 for the left child, 1 for the right one.
_GO = "IF(x[f] IS NULL, IF(missing_left, 0L, 1L), IF(x[f] <= threshold, 0L, 1L))"


def _numbered(splits: DataFrame, at_most: int) -> tuple[DataFrame, int]:
    """The splits of a level with ``child``, the number of the left child on the next level (the right one follows),
    and how many there are: a small local table, or a checkpoint where there may be more than ``LOCAL``."""
    schema = T.StructType([*splits.schema.fields, T.StructField("child", T.LongType())])
    if at_most > LOCAL:
        nth = F.row_number().over(Window.partitionBy("model", "tree").orderBy("node"))
        kept = _cut(splits.withColumn("child", (nth.cast("long") - 1) * 2))
        return kept, kept.count()
    out, last, child = [], None, 0
    for r in sorted(splits.collect(), key=lambda r: (r["model"], r["tree"], r["node"])):
        child = child + 2 if (r["model"], r["tree"]) == last else 0
        last = r["model"], r["tree"]
        out.append((*r, child))
    return splits.sparkSession.createDataFrame(out, schema), len(out)


def _side(splits: DataFrame, n: int) -> DataFrame:
    return F.broadcast(splits) if n <= LOCAL else splits


@dataclass
class Grown:
    """Trees grown together: root values (model, tree, value) and the splits of each level with their number."""

    roots: DataFrame
    levels: list[tuple[DataFrame, int]] = field(default_factory=list)


def grow(rows: DataFrame, p: TreeParams, features: int, models: int, trees: int, columns: Sequence[int] | None = None) -> Grown:
    """Grow the trees of ``rows`` (model, tree, x, g, w): one aggregate per level (two for extra trees)."""
    spark = rows.sparkSession
    at_most = models * trees
    roots = rows.groupBy("model", "tree").agg(F.expr(f"{_leaf('sum(g)', 'sum(w)', p)} AS value"))
    out = Grown(spark.createDataFrame(roots.collect(), roots.schema) if at_most <= LOCAL else _cut(roots))
    here = rows.withColumn("node", F.lit(0).cast("long"))
    level, least = 0, max(p.min_split, 2 * max(p.min_leaf, 1))
    while p.depth is None or level < p.depth:
        nodes = {"at_most": at_most} if p.kind == "extra" else {}
        splits, n = _numbered(best_splits(here, p, features, level, columns, **nodes), at_most)
        if not n:
            break
        out.levels.append((splits, n))
        level += 1
        if level == p.depth:
            break
        # rows of nodes without a split stay behind, and those that go to a node too small for one
        here = here.join(_side(splits, n), _NODE).where(f"IF({_GO} = 0, cl, cr) >= {least}")
        here = here.selectExpr("model", "tree", "x", "g", "w", f"child + {_GO} AS node")
        if level % CUT_LEVELS == 0:
            here = _cut(here)
        at_most = 2 * n
    return out


def walk(rows: DataFrame, grown: Grown, models: int) -> DataFrame:
    """``rows`` (model, tree, x, ...) with ``value``: that of the leaf where each ends."""
    kept = rows.columns
    roots = F.broadcast(grown.roots) if models <= LOCAL else grown.roots
    here = rows.join(roots, ["model", "tree"], "left").withColumn("node", F.lit(0).cast("long"))
    for splits, n in grown.levels:
        side = _side(splits.select(*_NODE, "f", "threshold", "missing_left", "child", "vl", "vr"), n)
        here = here.join(side, _NODE, "left").selectExpr(*kept, f"coalesce(IF({_GO} = 0, vl, vr), value) AS value", f"child + {_GO} AS node")
    return here.select(*kept, "value")


# --------------------------------------------------------------------------- fits


@dataclass
class Ensemble:
    """A fitted model for each key.  ``base``: (model, base) start values; ``parts``: trees grown together, with
    their numbers."""

    keys: list[str]
    features: list[str]
    params: TreeParams
    base: DataFrame
    models: int
    parts: list[tuple[list[int], Grown]]

    def splits(self) -> DataFrame:
        """Every split: model, tree, level, node, f, feature, threshold, missing_left, gain, cl, cr, vl, vr, child."""
        out = None
        names = F.array(*[F.lit(f) for f in self.features])
        for _, grown in self.parts:
            for level, (splits, _) in enumerate(grown.levels):
                one = splits.withColumns({"level": F.lit(level), "feature": names[F.col("f")]})
                out = one if out is None else out.unionByName(one)
        return out

    def importance(self) -> DataFrame:
        """H4: per model and feature the share of its average gain per split (boosted) or of its total gain."""
        per = F.avg("gain") if self.params.kind == "boosted" else F.sum("gain")
        names = self.base.select("model", F.explode(F.array(*[F.lit(f) for f in self.features])).alias("feature"))
        splits = self.splits()
        found = names.withColumn("gain", F.lit(0.0))
        if splits is not None:
            found = names.join(splits.groupBy("model", "feature").agg(per.alias("gain")), ["model", "feature"], "left").fillna(0.0, ["gain"])
        total = F.sum("gain").over(Window.partitionBy("model"))
        return found.select("model", "feature", F.coalesce(F.try_divide("gain", total), F.lit(0.0)).alias("importance"))


def tree_columns(p: TreeParams, tree: int, features: int) -> list[int]:
    """The features of one tree: the share ``columns`` of them (one at least), drawn by seed and tree."""
    n = max(1, int(features * p.columns))
    return sorted(np.random.Generator(np.random.PCG64([p.seed, tree])).permutation(features)[:n].tolist())


def poisson_weight(u: Column) -> Column:
    """A weight of 0 to 8 with the frequencies of draws with replacement, from a uniform number."""
    out, below = F.lit(8), [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(8)]
    for k in reversed(range(8)):
        out = F.when(u < F.lit(below[k]), F.lit(k)).otherwise(out)
    return out.cast("long")


def fit_trees(train: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], keys: Sequence[str] = (),
              params: TreeParams | str = "boosted_tuned",
              binned: DataFrame | blocks.Packed | None = None) -> Ensemble | blocks.BlockEnsemble:
    """Fit one model per key (or one pooled model) on the rows with a label.

    ``id_cols`` name the columns that tell rows apart; samples go by their hash.  ``binned`` reuses the rows
    of :func:`training_rows` for several presets, as they are or packed (:func:`packed_rows`); trees grow from packed rows
    where they can.
    """
    p = TREE_PRESETS[params] if isinstance(params, str) else params
    features, keys = list(features), list(keys)
    if isinstance(binned, blocks.Packed):
        if blocks.fits(binned, p):
            columns = lambda tree: tree_columns(p, tree, len(features))
            return blocks.fit(binned, keys, features, p, _tried(p, len(features)), columns, LOCAL)
        binned = binned.rows
    # thresholds of extra trees are drawn between raw values, all others from bins
    rows = binned if binned is not None else training_rows(train, features, label, id_cols, keys, None if p.kind == "extra" else p.bins)
    stats = rows.groupBy("model").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    start = _fixed(F.col("y") / F.col("n")) if p.kind == "boosted" else F.lit(0).cast("long")
    base = _cut(stats.select("model", start.alias("base")))
    models = base.count()
    fit = _boost if p.kind == "boosted" else _forest
    return Ensemble(keys, features, p, base, models, fit(rows, p, len(features), base, models))


def training_rows(train: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], keys: Sequence[str] = (),
                  bins: int | None = 256) -> DataFrame:
    """The rows that trees are grown from: rid, model, y and x, binned, behind a checkpoint."""
    y = F.col(label).cast("double")
    known = train.where(y.isNotNull() & ~F.isnan(y))
    rows = known.select(F.xxhash64(*id_cols).alias("rid"), model_key(keys).alias("model"), _fixed(y * SCALE).alias("y"), feature_array(features).alias("x"))
    rows = _cut(spread(rows, "rid"))
    return _cut(bin_values(rows, bins)) if bins else rows


def packed_rows(rows: DataFrame, features: Sequence[str], bins: int | None = 256) -> blocks.Packed:
    """The rows of :func:`training_rows` in blocks of arrays, kept in memory and on disk."""
    return blocks.pack(rows, len(features), bins, LOCAL, _fixed(F.col("y") / F.col("n")))


def _boost(rows: DataFrame, p: TreeParams, features: int, base: DataFrame, models: int) -> list[tuple[list[int], Grown]]:
    side = F.broadcast(base) if models <= LOCAL else base
    here = rows.join(side, "model").withColumnRenamed("base", "pred").persist()
    parts, last = [], None
    for tree in range(p.trees):
        one = here.withColumn("tree", F.lit(tree).cast("long"))
        taken = one.where(uniform(p.seed, "tree", "rid") < p.rows) if p.rows < 1 else one
        sample = taken.select("model", "tree", "x", (F.col("pred") - F.col("y")).alias("g"), F.lit(1).cast("long").alias("w"))
        grown = grow(sample, p, features, models, 1, tree_columns(p, tree, features))
        parts.append(([tree], grown))
        if tree + 1 < p.trees:
            moved = walk(one, grown, models)
            moved = moved.select("rid", "model", "y", "x", (F.col("pred") + F.coalesce("value", F.lit(0).cast("long"))).alias("pred"))
            # kept in memory and on disk between rounds; a lost executor costs the rounds since the last cut
            last, here = here, _cut(moved) if (tree + 1) % CUT_ROUNDS == 0 else moved.persist()
            here.count() if (tree + 1) % CUT_ROUNDS else None
            last.unpersist()
    here.unpersist()
    return parts


def _forest(rows: DataFrame, p: TreeParams, features: int, base: DataFrame, models: int) -> list[tuple[list[int], Grown]]:
    parts = []
    for first in range(0, p.trees, p.at_once):
        trees = list(range(first, min(first + p.at_once, p.trees)))
        each = rows.withColumn("tree", F.explode(F.array(*[F.lit(t).cast("long") for t in trees])))
        weight = poisson_weight(uniform(p.seed, "tree", "rid")) if p.bootstrap else F.lit(1).cast("long")
        if p.rows < 1 and not p.bootstrap:
            each = each.where(uniform(p.seed, "tree", "rid") < p.rows)
        each = each.withColumn("w", weight).where("w > 0")
        sample = each.select("model", "tree", "x", (-F.col("y") * F.col("w")).alias("g"), "w")
        parts.append((trees, grow(sample, p, features, models, len(trees))))
    return parts


def predict_trees(model: Ensemble | blocks.BlockEnsemble, df: DataFrame, pred: str = "pred_generation_mw") -> DataFrame:
    """``df`` with a prediction for every row.  Each part of the trees adds a joined walk per level; rows are told
    apart by a number of their own, given once.  Trees grown from packed rows are walked in arrays, without a join."""
    if isinstance(model, blocks.BlockEnsemble):
        return blocks.predict(model, df, model_key(model.keys), feature_array(model.features), pred)
    names = [c for c in df.columns if c != pred]
    numbered = _cut(spread(df.select(*names)).withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select("_row", model_key(model.keys).alias("model"), feature_array(model.features).alias("x"))
    side = F.broadcast(model.base) if model.models <= LOCAL else model.base
    total = None
    for group in _joined(model.parts):
        trees = [t for numbers, _ in group for t in numbers]
        grown = _merged([g for _, g in group])
        each = rows.withColumn("tree", F.explode(F.array(*[F.lit(t).cast("long") for t in trees])))
        sums = walk(each, grown, model.models * len(trees)).groupBy("_row").agg(F.sum("value").alias("value"))
        total = sums if total is None else total.union(sums)
    share = F.lit(1.0) if model.params.kind == "boosted" else F.lit(float(model.params.trees))
    total = total.groupBy("_row").agg(F.sum("value").alias("value"))
    scored = rows.select("_row", "model").join(side, "model").join(total, "_row", "left")
    value = (F.col("base") + F.coalesce("value", F.lit(0).cast("long"))) / share / F.lit(float(SCALE))
    return numbered.join(scored.select("_row", value.alias(pred)), "_row", "left").select(*names, pred)


def _joined(parts: list, most: int = 100) -> list[list]:
    """Runs of parts of up to ``most`` trees, which walk together."""
    out: list[list] = []
    for part in parts:
        if not out or sum(len(t) for t, _ in out[-1]) + len(part[0]) > most:
            out.append([])
        out[-1].append(part)
    return out


def _merged(grown: list[Grown]) -> Grown:
    """Trees grown apart as if grown together: their levels appended."""
    roots = grown[0].roots
    for g in grown[1:]:
        roots = roots.union(g.roots)
    levels = []
    for level in range(max((len(g.levels) for g in grown), default=0)):
        here = [g.levels[level] for g in grown if level < len(g.levels)]
        splits = here[0][0]
        for s, _ in here[1:]:
            splits = splits.union(s)
        levels.append((splits, sum(n for _, n in here)))
    return Grown(roots, levels)


def select_by_importance(model: Ensemble) -> list[str]:
    """The features of a pooled model whose importance is at least the mean; all if none has any."""
    rows = model.importance().collect()
    mean = sum(r["importance"] for r in rows) / max(len(rows), 1)
    keep = {r["feature"] for r in rows if r["importance"] >= mean}
    return [f for f in model.features if f in keep] or list(model.features)
