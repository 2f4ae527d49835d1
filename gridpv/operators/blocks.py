"""The trees of :mod:`gridpv.operators.trees` grown from blocks of packed rows: same rules, same splits, less work per row.

A block holds up to ``BLOCK`` rows of one model as arrays: codes of the bins (raw values for extra trees), label and
hashed row id.  A level is one pass over the blocks in all tasks, which adds up gradients, weights and rows
per (node, feature, bin) in arrays; these are summed per tree, and only splits reach the driver.  A forest goes on like
this until a node has at most ``NODE_ROWS`` rows; rows of such nodes are sent to one task each, which grows the
rest of the tree there.  Sums are whole numbers, so they do not depend on the order of the rows; gains are the same
doubles that the SQL of ``best_splits`` gives.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from math import exp, factorial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, and rows that a task holds back while it packs or scores them.
BLOCK, HELD = 1 << 16, 1 << 18
#: Rows of a node of a forest that one task grows to the leaves; larger nodes are split by all tasks.
NODE_ROWS = 2_000_000
#: Rows of the nodes that are split together in such a task, and cells of their sums.
GROUP_ROWS, GROUP_CELLS = 1 << 15, 1 << 21
#: Bytes of sums that a task holds, and of grown trees that pass through the driver at once.
HELD_BYTES = SENT_BYTES = 64 << 20
#: The greatest code, number of features, and depth of a tree whose levels all go over all rows.
MOST_CODES, MOST_FEATURES, MOST_LEVELS = 65_534, 32_000, 8
SCALE = 1 << 20

# The workers get these functions by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --------------------------------------------------------------------------- Spark's xxhash64 of whole numbers

_1, _2, _3, _4, _5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_64 = (1 << 64) - 1


def _turn(v, by: int):
    return (v << by | v >> (64 - by)) & _64 if isinstance(v, int) else v << np.uint64(by) | v >> np.uint64(64 - by)


def mixed(values: np.ndarray) -> np.ndarray:
    """The part of the hash that depends on the hashed numbers alone."""
    return _turn(values.view(np.uint64) * np.uint64(_2), 31) * np.uint64(_1)


def chain(*values: int) -> int:
    """The hash of whole numbers."""
    h = 42
    for v in values:
        h = (h + _5 + 8) & _64 ^ _turn((v & _64) * _2 & _64, 31) * _1 & _64
        h = (_turn(h, 27) * _1 + _4) & _64
        h = (h ^ h >> 33) * _2 & _64
        h = (h ^ h >> 29) * _3 & _64
        h ^= h >> 32
    return h


def uniforms(h: int, ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1): the hashes of ``ids`` (mixed) after those of ``h``, as ``trees.uniform``."""
    a = np.uint64((h + _5 + 8) & _64) ^ ids
    a = _turn(a, 27) * np.uint64(_1) + np.uint64(_4)
    a = (a ^ a >> np.uint64(33)) * np.uint64(_2)
    a = (a ^ a >> np.uint64(29)) * np.uint64(_3)
    a ^= a >> np.uint64(32)
    return (a & np.uint64((1 << 53) - 1)) / float(1 << 53)


_POISSON = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(8)]


def taken(p, tree: int, ids: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The sampled rows of a tree (None: all) and their weights (None: 1 each)."""
    if p.kind != "boosted" and p.bootstrap:
        w = np.searchsorted(_POISSON, uniforms(chain(p.seed, tree), ids), side="right")
        rows = np.flatnonzero(w)
        return rows, w[rows]
    return (np.flatnonzero(uniforms(chain(p.seed, tree), ids) < p.rows) if p.rows < 1 else None), None


def tried(p, tree: int, level: int, nodes: list[int], features: int) -> np.ndarray | None:
    """Per node and feature whether it is tried (None: all are)."""
    if p.tried >= features:
        return None
    out = np.zeros((len(nodes), features), bool)
    for row, node in zip(out, nodes):
        h = np.array([chain(p.seed, tree, level, node, f) for f in range(features)], np.uint64).view(np.int64)
        row[np.argsort(h, kind="stable")[: p.tried]] = True
    return out


# --------------------------------------------------------------------------- the best split of each node


def _soft(g, p):
    g = np.asarray(g).astype(float)
    return np.sign(g) * np.maximum(np.abs(g) - p.l1 * SCALE, 0.0) if p.l1 else g


def _worth(g, w, p):
    s = _soft(g, p)
    return s * s / (np.asarray(w).astype(float) + p.l2)


def leaf(g, w, p) -> np.ndarray:
    return np.floor(-_soft(g, p) / (np.asarray(w).astype(float) + p.l2) * p.rate + 0.5).astype(np.int64)


def exact(g: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Whole numbers as doubles whose sums are exact: as they are, or cut into three parts of 22 bits, with their shifts."""
    if len(g) and float(np.abs(g.astype(float)).max()) * len(g) >= 2.0**52:
        return [(by, (g >> by if by == 44 else g >> by & (1 << 22) - 1).astype(float)) for by in (0, 22, 44)]
    return [(0, g.astype(float))]


def added(cell: np.ndarray, parts: list, size: int) -> np.ndarray:
    """The sums of :func:`exact` numbers per cell (many times as fast as ``np.add.at`` in a worker)."""
    return sum(np.bincount(cell, v, size).astype(np.int64) << by for by, v in parts)


def best_of(found: list[tuple], ct, gt, wt, p) -> tuple:
    """Of the candidates (f, node, at, missing left, and cl, gl, wl, the sums to the left) the best of each node: node,
    f, at, missing left, cl, cr, vl, vr.  ``ct, gt, wt``: the sums of the nodes."""
    f, i, at, ml, cl, gl, wl = (np.concatenate(x) for x in zip(*found))
    keep = (ct[i] >= p.min_split) & (cl >= p.least) & (ct[i] - cl >= p.least)
    if p.min_weight > 0:
        keep &= (wl >= p.min_weight) & (wt[i] - wl >= p.min_weight)
    f, i, at, ml, cl, gl, wl = (x[keep] for x in (f, i, at, ml, cl, gl, wl))
    gr, wr = gt[i] - gl, wt[i] - wl
    # a node without rows has no candidates
    total = np.zeros(len(ct))
    some = ct > 0
    total[some] = _worth(gt[some], wt[some], p)
    gain = (_worth(gl, wl, p) + _worth(gr, wr, p) - total[i]) * (0.5 / SCALE**2)
    best = np.full(len(ct), -np.inf)
    if len(i):
        order = np.argsort(i.astype(np.uint16) if len(ct) <= 1 << 16 else i, kind="stable")
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        best[i[order[first]]] = np.maximum.reduceat(gain[order], first)
    # ties go to the lower feature, then the lower threshold, then missing values to the right
    top = np.flatnonzero((gain == best[i]) & (gain > p.min_gain))
    top = top[np.lexsort((ml[top], at[top], f[top], i[top]))]
    top = top[np.flatnonzero(np.diff(i[top], prepend=-1))]
    f, i, at, ml, cl, gl, wl, gr, wr = (x[top] for x in (f, i, at, ml, cl, gl, wl, gr, wr))
    return i, f, at, ml, cl, ct[i] - cl, leaf(gl, wl, p), leaf(gr, wr, p)


def choose(c, g, w, columns: list[int], p, mask: np.ndarray | None = None) -> tuple:
    """:func:`best_of` the sums (feature of ``columns``, node, code; the last code is that of missing values)."""
    w = c if w is None else w
    some, cm = c[..., :-1] > 0, c[..., -1]
    cc, gc = c[..., :-1].cumsum(-1), g[..., :-1].cumsum(-1)
    wc = cc if w is c else w[..., :-1].cumsum(-1)
    ct, gt = cc[0, :, -1] + cm[0], gc[0, :, -1] + g[0, :, -1]
    wt = ct if w is c else wc[0, :, -1] + w[0, :, -1]
    if mask is not None:
        some &= mask.T[columns][..., None]
    names, found = np.array(columns), []
    for left in (False, True) if cm.any() else (False,):
        cl = cc + cm[..., None] if left else cc
        ok = some & (cl >= p.least) & (ct[:, None] - cl >= p.least)
        if left:
            ok &= cm[..., None] > 0
        f, i, at = np.nonzero(ok)
        gl, wl = gc[f, i, at], wc[f, i, at]
        if left:
            gl, wl = gl + g[f, i, -1], wl + w[f, i, -1]
        found.append((names[f], i, at, np.full(len(f), left), cl[f, i, at], gl, wl))
    return best_of(found, ct, gt, wt, p)


# --------------------------------------------------------------------------- grown trees


@dataclass
class Tree:
    """Nodes in a list, the two children of a split next to each other; ``open``: per level the nodes that may split,
    as (number on the level, place, rows)."""

    split: dict[int, tuple] = field(default_factory=dict)  # place: f, threshold or code, missing left, left child
    value: list[int] = field(default_factory=lambda: [0])
    open: list[tuple[int, int, int | None]] = field(default_factory=lambda: [(0, 0, None)])
    depth: int = 0
    done: "tuple | None" = None

    def grown(self, found: tuple, p) -> None:
        """Add the splits of a level; ``found`` names nodes by their position in ``open``."""
        i, f, at, ml, cl, cr, vl, vr = (x.tolist() for x in found)
        here, self.open = self.open, []
        for child, j in enumerate(range(len(i))):
            left = len(self.value)
            self.split[here[i[j]][1]] = f[j], at[j], ml[j], left
            self.value += [vl[j], vr[j]]
            for side, n in enumerate((cl[j], cr[j])):
                if n >= p.least_split:
                    self.open.append((2 * child + side, left + side, n))
        self.depth += bool(i)

    def packed(self) -> tuple:
        """For codes: one whole number per node, (left child, code, feature, missing left); else four arrays.  A leaf is its own left
        child.  With the values and the depth."""
        n = len(self.value)
        left = np.arange(n)
        f, ml = np.zeros(n, np.int64), np.zeros(n, bool)
        coded = not any(isinstance(s[1], float) for s in self.split.values())
        at = np.full(n, MOST_CODES + 1) if coded else np.full(n, np.inf)
        for k, (one, t, m, child) in self.split.items():
            f[k], at[k], ml[k], left[k] = one, t, m, child
        if not coded:
            ml |= left == np.arange(n)  # a missing value stays at a leaf
        nodes = left << 32 | at << 16 | f << 1 | ml if coded else (left, at, f, ml)
        return nodes, np.array(self.value, np.int64), self.depth


def walk(x: np.ndarray, tree: tuple, missing: int | None) -> np.ndarray:
    """The place of the leaf where each row (feature, row) ends."""
    nodes, _, depth = tree
    n, flat = x.shape[1], x.ravel()
    rows, at = np.arange(n), np.zeros(n, np.int64)
    if isinstance(nodes, tuple):
        left, threshold, feature, ml = nodes
        for _ in range(depth):
            v = flat[feature[at] * n + rows]
            at = left[at] + (v > threshold[at]) + (np.isnan(v) & ~ml[at])
        return at
    some = missing is not None and bool((x == missing).any())
    out, here, turn = None, rows, 0
    for turn in range(depth):
        node = nodes[at]
        v = flat[(node >> 1 & 0x7FFF) * n + here]
        go = v > (node >> 16 & 0xFFFF)
        if some:
            go &= (v != missing) | (node & 1 == 0)
        at = (node >> 32) + go
        if turn % 4 == 3 and turn + 1 < depth:
            # rows at a leaf stay there
            out = np.zeros(n, np.int64) if out is None else out
            more = np.flatnonzero(nodes[at] >> 32 != at)
            out[here] = at
            here, at = here[more], at[more]
    if out is None:
        return at
    out[here] = at
    return out


# --------------------------------------------------------------------------- packed rows


@dataclass
class Packed:
    """``rows`` of ``training_rows``, and their blocks: (model, mixed ids, labels, values by feature).  ``edges``: per
    (model, feature) the values of the bins (None: raw values)."""

    rows: DataFrame
    features: int
    names: list[str]
    counts: list[int]
    means: list[int]
    blocks: RDD | None = None
    edges: Broadcast | None = None
    width: int = 0

    @property
    def missing(self) -> int | None:
        return self.width - 1 if self.edges else None


def _columns(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """The feature arrays of a batch as (feature, row); NaN is missing."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(batch.num_rows, features).T


def _models(batch: pa.RecordBatch, number: dict[str, int]) -> np.ndarray:
    """The number of the model of each row, -1 for unknown ones."""
    coded = batch.column("model").dictionary_encode()
    known = np.array([number.get(name, -1) for name in coded.dictionary.to_pylist()], np.int64)
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def _pack(features: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def out():
            for model, parts in held.items():
                ids, y, x = (np.concatenate(v, axis=-1) for v in zip(*parts))
                for k in range(0, len(ids), BLOCK):
                    part = slice(k, k + BLOCK)
                    row = [model, len(ids[part]), mixed(ids[part]).tobytes(), y[part].tobytes(), x[:, part].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["model", "n", "ids", "y", "x"])
            held.clear()

        for batch in batches:
            coded = batch.column("model").dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            ids, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "y"))
            x = _columns(batch, features) if batch.num_rows else None
            for code, model in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero(which == code)
                held.setdefault(model, []).append((ids[mine], y[mine], x[:, mine]))
            n += batch.num_rows
            if n >= HELD:
                yield from out()
                n = 0
        yield from out()

    return run


def pack(rows: DataFrame, features: int, bins: int | None, most_models: int, mean: Column) -> Packed:
    """The rows of ``training_rows`` as blocks; without blocks if there are too many models or bins for them."""
    found = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).select("model", "n", mean.alias("mean"))
    found = found.orderBy("model").limit(most_models + 1).collect()
    names = [r["model"] for r in found]
    out = Packed(rows, features, names, [r["n"] for r in found], [r["mean"] for r in found])
    if len(names) > most_models or features > MOST_FEATURES or not features or (bins or 0) + 2 > MOST_CODES:
        return out
    sc = rows.sparkSession.sparkContext
    number = {name: i for i, name in enumerate(names)}
    schema = "model string, n long, ids binary, y binary, x binary"

    def block(r):
        ids, y = np.frombuffer(r["ids"], np.uint64), np.frombuffer(r["y"], np.int64)
        return number[r["model"]], ids, y, np.frombuffer(r["x"], float).reshape(features, r["n"])

    raw = rows.mapInArrow(_pack(features), schema).rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)
    if not bins:
        out.blocks = raw
        return out

    def values(parts):
        seen: dict = {}
        for m, _, _, x in parts:
            for f in range(features):
                v = np.unique(x[f][~np.isnan(x[f])])
                seen[m, f] = np.union1d(seen[m, f], v) if (m, f) in seen else v
        yield from seen.items()

    edges = raw.mapPartitions(values).reduceByKey(np.union1d, 1).collectAsMap()
    width = max((len(v) for v in edges.values()), default=0) + 2
    out.width, out.edges = width, sc.broadcast({(m, f): edges.get((m, f), np.zeros(0)) for m in range(len(names)) for f in range(features)})
    sent = out.edges
    out.blocks = raw.map(lambda b: (*b[:3], codes(b[3], b[0], sent.value, width))).persist(StorageLevel.MEMORY_AND_DISK)
    out.blocks.count()
    raw.unpersist()
    return out


def codes(x: np.ndarray, model: int, edges: dict, width: int) -> np.ndarray:
    """The number of each value's bin: that of the first border that is not below it."""
    out = np.empty(x.shape, np.uint16)
    for f, v in enumerate(x):
        out[f] = np.searchsorted(edges[model, f], v)
        out[f][np.isnan(v)] = width - 1
    return out


# --------------------------------------------------------------------------- a level over all rows


def _sample(block: tuple, tree: int, p) -> tuple:
    """Values, gradients and weights (None: 1) of the sampled rows of a tree."""
    _, ids, y, x = block[:4]
    rows, w = taken(p, tree, ids)
    g = block[4] - y if len(block) > 4 else -y
    if rows is not None:
        x, g = x.take(rows, axis=1), g[rows]
    return x, (g if w is None else g * w), w


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _checked(total: float) -> None:
    if total >= 2.0**62:
        raise OverflowError("the sum of the absolute labels of a tree is beyond 2 ** 42")


def _places(trees: dict, p) -> dict:
    """What the tasks need of the trees that have open nodes: packed nodes, position per place, numbers of nodes."""
    out = {}
    for key, t in trees.items():
        if t.open:
            slot = np.full(len(t.value), -1, np.int64)
            slot[[place for _, place, _ in t.open]] = np.arange(len(t.open))
            out[key] = t.packed(), slot, [node for node, _, _ in t.open]
    return out


def _by_codes(blocks: RDD, trees: dict, p, level: int, features: int, width: int, columns: list[int]) -> list:
    """The best splits of the open nodes: [((model, tree), splits, sums of the first level)]."""
    sent = blocks.context.broadcast(_places(trees, p))
    numbers = sorted({tree for _, tree in trees})

    def sums(parts):
        held, size = {}, 0
        for block in parts:
            for tree in numbers:
                at = sent.value.get((block[0], tree))
                if at is None:
                    continue
                grown, slot, nodes = at
                x, g, w = _sample(block, tree, p)
                where = slot[walk(x, grown, width - 1)] if level else np.zeros(x.shape[1], np.int64)
                if level and (where < 0).any():
                    stay = np.flatnonzero(where >= 0)
                    where, x, g, w = where[stay], x.take(stay, axis=1), g[stay], None if w is None else w[stay]
                if not len(g):
                    continue
                key = block[0], tree
                if key not in held:
                    held[key] = [np.zeros((2 if w is None else 3, len(columns), len(nodes) * width), np.int64), 0.0]
                    size += held[key][0].nbytes
                acc = held[key][0]
                where, parts = where * width, exact(g)
                for k, f in enumerate(columns):
                    cell = where + x[f]
                    acc[0, k] += np.bincount(cell, minlength=acc.shape[2])
                    acc[1, k] += added(cell, parts, acc.shape[2])
                    if w is not None:
                        acc[2, k] += added(cell, [(0, w)], acc.shape[2])
                if not level:
                    held[key][1] += float(np.abs(g.astype(float)).sum())
            if size > HELD_BYTES:
                yield from ((key, tuple(v)) for key, v in held.items())
                held, size = {}, 0
        yield from ((key, tuple(v)) for key, v in held.items())

    def best(item):
        (m, tree), (acc, total) = item
        _checked(total)
        nodes = sent.value[m, tree][2]
        acc = acc.reshape(*acc.shape[:2], len(nodes), width)
        w = acc[2] if len(acc) > 2 else None
        root = (int(acc[1, 0].sum()), int((acc[0] if w is None else w)[0].sum())) if not level else None
        return (m, tree), choose(acc[0], acc[1], w, columns, p, tried(p, tree, level, nodes, features)), root

    return blocks.mapPartitions(sums).reduceByKey(_added, _reducers(blocks, len(trees))).map(best).collect()


def _reducers(blocks: RDD, keys: int) -> int:
    return max(1, min(blocks.context.defaultParallelism, keys))


def _apply(trees: dict, found: list, p) -> None:
    splits = {key: s for key, s, _ in found}
    for key, t in trees.items():
        if key in splits:
            t.grown(splits[key], p)
        else:
            t.open = []
    for key, _, root in found:
        if root:
            trees[key].value[0] = int(leaf(np.array([root[0]]), np.array([root[1]]), p)[0])


def _levels(blocks: RDD, trees: dict, p, features: int, width: int, columns: list[int]) -> None:
    level = 0
    while any(t.open for t in trees.values()) and level < p.depth:
        _apply(trees, _by_codes(blocks, trees, p, level, features, width, columns), p)
        level += 1


# --------------------------------------------------------------------------- boosted trees


def _boost(data: Packed, p, base: list[int], columns_of: Callable) -> Iterator[dict]:
    """The trees of each round; running predictions are kept in memory and on disk from round to round, and can be made again from
    the rows and the trees so far."""
    start = data.blocks.context.broadcast(base)
    here = data.blocks.map(lambda b: (*b, np.full(len(b[2]), start.value[b[0]], np.int64))).persist(StorageLevel.MEMORY_AND_DISK)
    last = None
    for tree in range(p.trees):
        trees = {(m, tree): Tree() for m in range(len(data.names))}
        _levels(here, trees, p, data.features, data.width, columns_of(tree))
        if last is not None:
            last.unpersist()
        done = {key: t.packed() for key, t in trees.items()}
        yield done
        if tree + 1 < p.trees:
            last, here = here, _moved(here, done, tree, data.width).persist(StorageLevel.MEMORY_AND_DISK)
    here.unpersist()
    if last is not None:
        last.unpersist()


def _moved(blocks: RDD, trees: dict, tree: int, width: int) -> RDD:
    sent = blocks.context.broadcast(trees)

    def moved(b):
        grown = sent.value[b[0], tree]
        return *b[:4], b[4] + grown[1][walk(b[3], grown, width - 1)]

    return blocks.map(moved)


# --------------------------------------------------------------------------- extra trees


def _nodes_of(x: np.ndarray, t: tuple) -> dict[int, np.ndarray]:
    """The rows at each open node, by its position."""
    (left, at, f, ml), slot = t[0][0], t[1]
    out, todo = {}, [(0, None)]
    while todo:
        k, rows = todo.pop()
        if slot[k] >= 0:
            out[int(slot[k])] = rows
        elif left[k] != k:
            v = x[f[k]] if rows is None else x[f[k]][rows]
            go = v > at[k]
            if not ml[k]:
                go |= np.isnan(v)
            both = (np.flatnonzero(~go), np.flatnonzero(go)) if rows is None else (rows[~go], rows[go])
            todo += [(left[k], both[0]), (left[k] + 1, both[1])]
    return out


def _extra(data: Packed, p, most: int) -> Iterator[dict]:
    """Up to so many trees at once that the splits of a level are at most ``most``."""
    models = max(len(data.names), 1)
    step = max(1, min(p.trees, most // (models << p.depth)))
    for first in range(0, p.trees, step):
        numbers = range(first, min(first + step, p.trees))
        trees = {(m, tree): Tree() for m in range(len(data.names)) for tree in numbers}
        level = 0
        while any(t.open for t in trees.values()) and level < p.depth:
            _apply(trees, _by_thresholds(data, trees, p, level), p)
            level += 1
        yield {key: t.packed() for key, t in trees.items()}


def _floats(places: dict) -> dict:
    """Trees without a split yet are packed as codes; here all hold thresholds."""
    out = {}
    for key, ((nodes, value, depth), slot, names) in places.items():
        if not isinstance(nodes, tuple):
            n = len(value)
            nodes = np.arange(n), np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
        out[key] = (nodes, value, depth), slot, names
    return out


def _by_thresholds(data: Packed, trees: dict, p, level: int) -> list:
    features, blocks = data.features, data.blocks
    places = _floats(_places(trees, p))
    sent = blocks.context.broadcast({key: (*v, tried(p, key[1], level, v[2], features)) for key, v in places.items()})
    by_model: dict[int, list] = {}
    for m, tree in sorted(places):
        by_model.setdefault(m, []).append(tree)

    def each(parts):
        for block in parts:
            for tree in by_model.get(block[0], []):
                t = sent.value[block[0], tree]
                rows, w = taken(p, tree, block[1])
                x = block[3] if rows is None else block[3][:, rows]
                g = -block[2] if rows is None else -block[2][rows]
                yield (block[0], tree), t, x, (g if w is None else g * w), w

    def ends(parts):
        held = {}
        for key, t, x, _, _ in each(parts):
            acc = held.setdefault(key, np.full((2, len(t[2]), features), np.inf))
            for i, rows in _nodes_of(x, t).items():
                for f in range(features) if t[3] is None else np.flatnonzero(t[3][i]):
                    v = x[f] if rows is None else x[f][rows]
                    if len(v):
                        # the least value, and the greatest with its sign turned; NaN is left out
                        acc[0, i, f] = np.fmin(acc[0, i, f], np.fmin.reduce(v))
                        acc[1, i, f] = np.fmin(acc[1, i, f], -np.fmax.reduce(v))
        yield from held.items()

    found = blocks.mapPartitions(ends).reduceByKey(np.minimum, _reducers(blocks, len(trees))).collectAsMap()
    drawn = {}
    for (m, tree), (lo, hi) in found.items():
        nodes, at = places[m, tree][2], np.full(lo.shape, np.nan)
        for i, f in zip(*np.nonzero(lo < -hi)):
            u = (chain(p.seed + 1, tree, level, nodes[i], int(f)) & ((1 << 53) - 1)) / float(1 << 53)
            a, b = float(lo[i, f]), float(-hi[i, f])
            t = a + u * (b - a)
            at[i, f] = t if t < b else a
        drawn[m, tree] = at
    picked = blocks.context.broadcast(drawn)

    def sums(parts):
        held = {}
        for key, t, x, g, w in each(parts):
            at = picked.value[key]
            if key not in held:
                # rows, gradients, weights: of the node, and per feature to the left and missing
                held[key] = [np.zeros((3, len(t[2]), 1 + 2 * features), np.int64), 0.0]
            acc = held[key][0]
            if not level:
                held[key][1] += float(np.abs(g.astype(float)).sum())
            for i, rows in _nodes_of(x, t).items():
                gi = g if rows is None else g[rows]
                wi = w if rows is None or w is None else w[rows]
                total = lambda sel: (np.count_nonzero(sel), n := gi[sel].sum(), np.count_nonzero(sel) if wi is None else wi[sel].sum())
                acc[:, i, 0] += (len(gi), gi.sum(), len(gi) if wi is None else wi.sum())
                for f in np.flatnonzero(~np.isnan(at[i])):
                    v = x[f] if rows is None else x[f][rows]
                    acc[:, i, 1 + f] += total(v <= at[i, f])
                    gone = np.isnan(v)
                    if gone.any():
                        acc[:, i, 1 + features + f] += total(gone)
        yield from ((key, tuple(v)) for key, v in held.items())

    def best(item):
        key, (acc, total) = item
        _checked(total)
        at = picked.value[key]
        (ct, gt, wt), left, gone = acc[..., 0], acc[..., 1 : 1 + features], acc[..., 1 + features :]
        found = []
        for side in (False, True):
            i, f = np.nonzero(~np.isnan(at) & (gone[0] > 0) if side else ~np.isnan(at))
            cl, gl, wl = (left + gone if side else left)[:, i, f]
            found.append((f, i, at[i, f], np.full(len(f), side), cl, gl, wl))
        root = (int(gt[0]), int(wt[0])) if not level else None
        return key, best_of(found, ct, gt, wt, p), root

    return blocks.mapPartitions(sums).reduceByKey(_added, _reducers(blocks, len(trees))).map(best).collect()


# --------------------------------------------------------------------------- forests


def grow_node(x: np.ndarray, g: np.ndarray, w: np.ndarray | None, p, width: int, depth: int) -> tuple:
    """The rest of a tree below a node from its rows (codes by feature; the arrays are reordered): packed nodes, values
    and depth.  Nodes of up to ``GROUP_ROWS`` rows together are split at once."""
    features, n = x.shape
    room = 2 * (n // p.least) + 3
    nodes, value = np.zeros(room, np.int64), np.zeros(room, np.int64)
    nodes[:] = np.arange(room) << 32 | (MOST_CODES + 1) << 16
    value[0] = leaf(np.array([g.sum()]), np.array([n if w is None else w.sum()]), p)[0]
    used, deepest, columns = 1, 0, list(range(features))
    most = max(256, min(GROUP_ROWS, GROUP_CELLS * p.least_split // (features * width)))
    todo = [(0, np.zeros(1, np.int64), np.array([n]), 0)] if n >= p.least_split else []
    while todo:
        first, places, sizes, level = todo.pop()
        if level >= depth:
            continue
        here, k = slice(first, first + int(sizes.sum())), len(places)
        slot = np.repeat(np.arange(k), sizes)
        start = slot * width
        c, s = np.empty((features, k * width), np.int64), np.empty((features, k * width), np.int64)
        ws = None if w is None else np.empty((features, k * width), np.int64)
        parts, weights = exact(g[here]), None if w is None else [(0, w[here].astype(float))]
        for f in columns:
            cell = start + x[f, here]
            c[f] = np.bincount(cell, minlength=k * width)
            s[f] = added(cell, parts, k * width)
            if w is not None:
                ws[f] = added(cell, weights, k * width)
        shape = (features, k, width)
        i, f, at, ml, cl, cr, vl, vr = choose(c.reshape(shape), s.reshape(shape), None if w is None else ws.reshape(shape), columns, p)
        if not len(i):
            continue
        left = used + 2 * np.arange(len(i))
        used += 2 * len(i)
        nodes[places[i]] = left << 32 | at << 16 | f << 1 | ml
        value[left], value[left + 1] = vl, vr
        deepest = max(deepest, level + 1)
        # rows go to their children; those of nodes too small to split stay behind
        held = np.stack([cl, cr], 1).ravel()
        more = held >= p.least_split
        if not more.any():
            continue
        split = np.full(k, -1)
        split[i] = np.arange(len(i))
        which = split[slot]
        rows = np.flatnonzero(which >= 0)
        which = which[rows]
        v = x[:, here].ravel()[f[which] * len(slot) + rows]
        go = (v > at[which]) & ~((v == width - 1) & ml[which])
        child = 2 * which + go
        stay = more[child]
        rows, child = rows[stay], child[stay]
        order = first + rows[np.argsort(child.astype(np.uint16) if 2 * len(i) <= 1 << 16 else child, kind="stable")]
        here = slice(first, first + len(order))
        for f in columns:
            x[f, here] = x[f, order]
        g[here] = g[order]
        if w is not None:
            w[here] = w[order]
        places, sizes = (left[:, None] + np.arange(2)).ravel()[more], held[more]
        begin, ahead = np.cumsum(sizes) - sizes, 0
        while ahead < len(sizes):
            upto = max(ahead + 1, int(np.searchsorted(begin + sizes, begin[ahead] + most, side="right")))
            todo.append((first + int(begin[ahead]), places[ahead:upto], sizes[ahead:upto], level + 1))
            ahead = upto
    return nodes[:used].copy(), value[:used].copy(), deepest


def _joined(top: Tree, below: dict[int, tuple]) -> tuple:
    """The packed tree of ``top`` with the trees ``below`` some of its places."""
    nodes, value, depth = top.packed()
    nodes, value = [nodes], [value]
    size = len(value[0])
    for place, (more, values, levels) in sorted(below.items()):
        # the root of the part takes the place, its other nodes follow
        moved = more + ((size - 1) << 32)
        nodes[0][place] = moved[0] if levels else nodes[0][place]
        value[0][place] = values[0]
        nodes.append(moved[1:])
        value.append(values[1:])
        size += len(values) - 1
        depth = max(depth, top.at[place] + levels)
    return np.concatenate(nodes), np.concatenate(value), depth


@dataclass
class Top(Tree):
    """``at``: the levels of the nodes that a task each grows on."""

    at: dict[int, int] = field(default_factory=dict)


def _forest(data: Packed, p) -> Iterator[dict]:
    features, width, blocks = data.features, data.width, data.blocks
    depth = 1 << 30 if p.depth is None else p.depth
    # what the trees of a batch take at most: two nodes a leaf, 16 bytes each, of all rows
    one = sum(data.counts) * 32 // p.least + 1
    step = max(1, min(p.trees, max(p.at_once, 4 * blocks.context.defaultParallelism // max(len(data.names), 1)), SENT_BYTES // one))
    for first in range(0, p.trees, step):
        numbers = list(range(first, min(first + step, p.trees)))
        tops = {(m, tree): Top() for m in range(len(data.names)) for tree in numbers}
        for (m, _), t in tops.items():
            t.open = [(0, 0, data.counts[m])]
        level = 0
        while True:
            for t in tops.values():
                t.at |= {place: level for _, place, n in t.open if n <= NODE_ROWS}
                t.open = [o for o in t.open if o[2] > NODE_ROWS]
            if level >= depth or not any(t.open for t in tops.values()):
                break
            _apply(tops, _by_codes(blocks, tops, p, level, features, width, list(range(features))), p)
            level += 1
        below: dict[tuple, dict] = {key: {} for key in tops}
        for (m, tree, place), part in _sent(blocks, tops, numbers, p, width, depth):
            below[m, tree][place] = part
        yield {key: _joined(t, below[key]) for key, t in tops.items()}


def _sent(blocks: RDD, tops: dict, numbers: list[int], p, width: int, depth: int) -> Iterator:
    """The parts of trees that a task each grows, from the rows sent to it."""
    where = {}
    for key, t in tops.items():
        if t.at:
            slot = np.full(len(t.value), -1, np.int64)
            slot[list(t.at)] = np.arange(len(t.at))
            where[key] = t.packed(), slot, list(t.at)
    ways = {way: i for i, way in enumerate((*key, place) for key, (_, _, places) in where.items() for place in places)}
    if not ways:
        return
    levels = {(*key, place): level for key, t in tops.items() for place, level in t.at.items()}
    sent = blocks.context.broadcast(where)

    def send(block):
        for tree in numbers:
            t = sent.value.get((block[0], tree))
            if t is None:
                continue
            x, g, w = _sample(block, tree, p)
            slot = t[1][walk(x, t[0], width - 1)] if t[0][2] else np.full(x.shape[1], t[1][0])
            w = None if w is None else w.astype(np.uint8)
            for i, place in enumerate(t[2]):
                rows = slice(None) if t[0][2] == 0 else np.flatnonzero(slot == i)
                if len(g[rows]):
                    yield (block[0], tree, place), (x if t[0][2] == 0 else x.take(rows, axis=1), g[rows], None if w is None else w[rows])

    def grow(parts):
        held: dict[tuple, list] = {}
        for key, part in parts:
            held.setdefault(key, []).append(part)
        for key in list(held):
            x, g, w = zip(*held.pop(key))
            x, g = np.concatenate(x, axis=1), np.concatenate(g)
            w = None if w[0] is None else np.concatenate(w).astype(np.int64)
            _checked(float(np.abs(g.astype(float)).sum()))
            yield key, grow_node(x, g, w, p, width, depth - levels[key])

    yield from blocks.flatMap(send).partitionBy(len(ways), lambda key: ways[key]).mapPartitions(grow).collect()


# --------------------------------------------------------------------------- fits and predictions


@dataclass
class BlockEnsemble:
    """A fitted model for each key; ``parts``: the trees of each model as sent to the workers, a batch each."""

    keys: list[str]
    features: list[str]
    params: object
    names: list[str]
    base: list[int]
    parts: list[Broadcast]
    edges: Broadcast | None
    width: int


def fits(data: Packed, p) -> bool:
    """Whether the preset can grow from the blocks: raw values for extra trees only, deep trees for forests only."""
    if data.blocks is None or (p.kind == "extra") != (data.edges is None):
        return False
    if p.kind == "forest":
        return p.node_columns is None
    return p.depth is not None and p.depth <= MOST_LEVELS


def fit(data: Packed, keys: list[str], features: list[str], p, tried_columns: int, columns_of: Callable, most: int) -> BlockEnsemble:
    rules = SimpleNamespace(**asdict(p))
    rules.least = max(p.min_leaf, 1)
    rules.least_split = max(p.min_split, 2 * rules.least)
    rules.rate = float(p.rate) if p.kind == "boosted" else 1.0
    rules.tried = tried_columns
    start = data.means if p.kind == "boosted" else [0] * len(data.names)
    grown = {"boosted": lambda: _boost(data, rules, start, columns_of), "extra": lambda: _extra(data, rules, most), "forest": lambda: _forest(data, rules)}
    sc = data.rows.sparkSession.sparkContext
    parts, held, size = [], {}, 0

    def send():
        nonlocal held, size
        by_model: dict[int, list] = {}
        for (m, _), t in sorted(held.items(), key=lambda item: item[0]):
            by_model.setdefault(m, []).append(t)
        if by_model:
            parts.append(sc.broadcast(by_model))
        held, size = {}, 0

    for trees in grown[p.kind]():
        held |= trees
        size += sum(t[1].nbytes * 2 for t in trees.values())
        if size > SENT_BYTES:
            send()
    send()
    return BlockEnsemble(keys, features, p, data.names, start, parts, data.edges, data.width)


def predict(model: BlockEnsemble, df: DataFrame, model_key, x, pred: str) -> DataFrame:
    """``df`` with a prediction for every row, in one pass without a shuffle: ``HELD`` rows at a time walk all trees."""
    names = [c for c in df.columns if c != pred]
    number = {name: i for i, name in enumerate(model.names)}
    features, width, edges, parts, base = len(model.features), model.width, model.edges, model.parts, model.base
    share = 1.0 if model.params.kind == "boosted" else float(model.params.trees)
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(pred, T.DoubleType())])

    def scored(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.concatenate([_models(b, number) for b in batches])
        raw = np.concatenate([_columns(b, features) for b in batches], axis=1)
        mine = {m: np.flatnonzero(which == m) for m in np.unique(which[which >= 0]).tolist()}
        value = {m: np.full(len(rows), base[m], np.int64) for m, rows in mine.items()}
        x = {m: raw[:, rows] if edges is None else codes(raw[:, rows], m, edges.value, width) for m, rows in mine.items()}
        for part in parts:
            for m, rows in mine.items():
                for tree in part.value.get(m, []):
                    for k in range(0, len(rows), BLOCK):
                        some = slice(k, k + BLOCK)
                        value[m][some] += tree[1][walk(np.ascontiguousarray(x[m][:, some]), tree, width - 1 if edges else None)]
            if len(parts) > 1:
                vars(part).pop("_value", None)  # one batch of trees in memory at a time
        out, known = np.zeros(len(which)), which >= 0
        for m, rows in mine.items():
            out[rows] = value[m] / share / float(SCALE)
        first = 0
        for b in batches:
            here = slice(first, first + b.num_rows)
            first += b.num_rows
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], pa.array(out[here], mask=~known[here])], names=[*names, pred])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HELD:
                yield from scored(held)
                held, n = [], 0
        if held:
            yield from scored(held)

    return df.select(*names, model_key.alias("model"), x.alias("x")).mapInArrow(run, schema)
