"""A plain trainer with the rules of ``gridpv.operators.trees``: one model, lists of rows, no Spark."""

import math
import struct

import xxhash

from gridpv.operators.trees import SCALE, TreeParams, tree_columns


def spark_hash(*values):
    """xxhash64 of whole numbers as Spark chains it."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h


def uniform(seed, *values):
    return (spark_hash(seed, *values) & ((1 << 53) - 1)) / float(1 << 53)


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def borders(values, bins):
    """The greatest value of each bin."""
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    n, upto, out = sum(counts.values()), 0, []
    for v in sorted(counts):
        before, upto = upto, upto + counts[v]
        if len(counts) <= bins or upto * bins // n > before * bins // n:
            out.append(v)
    return out


def binned(xs, bins):
    edges = [borders([x[f] for x in xs], bins) for f in range(len(xs[0]))]
    return [[None if v is None else next(e for e in edges[f] if e >= v) for f, v in enumerate(x)] for x in xs]


class Trainer:
    def __init__(self, p: TreeParams):
        self.p = p

    def soft(self, g):
        if not self.p.l1:
            return float(g)
        return math.copysign(1.0, g) * max(abs(float(g)) - self.p.l1 * SCALE, 0.0) if g else 0.0

    def worth(self, g, w):
        s = self.soft(g)
        return s * s / (float(w) + self.p.l2)

    def leaf(self, g, w):
        rate = self.p.rate if self.p.kind == "boosted" else 1.0
        return math.floor(-self.soft(g) / (float(w) + self.p.l2) * rate + 0.5)

    def thresholds(self, rows, f, tree, level, node):
        values = sorted({x[f] for x, _, _ in rows if x[f] is not None})
        if self.p.kind != "extra":
            return values
        if len(values) < 2:
            return []
        lo, hi = values[0], values[-1]
        at = lo + uniform(self.p.seed + 1, tree, level, node, f) * (hi - lo)
        return [at if at < hi else lo]

    def best(self, rows, tree, level, node, columns):
        """(gain, f, threshold, missing_left, left rows, right rows) or None."""
        p, features = self.p, len(rows[0][0])
        if len(rows) < p.min_split:
            return None
        if p.node_columns is not None:
            k = int(features**0.5) if p.node_columns == "sqrt" else p.node_columns
            order = sorted(range(features), key=lambda f: (signed(spark_hash(p.seed, tree, level, node, f)), f))
            columns = sorted(set(columns) & set(order[: max(1, min(k, features))]))
        total = self.worth(sum(g for _, g, _ in rows), sum(w for _, _, w in rows))
        best = None
        for f in columns:
            gone = any(x[f] is None for x, _, _ in rows)
            for at in self.thresholds(rows, f, tree, level, node):
                for missing_left in (False, True) if gone else (False,):
                    left = [r for r in rows if (missing_left if r[0][f] is None else r[0][f] <= at)]
                    right = [r for r in rows if not (missing_left if r[0][f] is None else r[0][f] <= at)]
                    if min(len(left), len(right)) < max(p.min_leaf, 1):
                        continue
                    sums = [(sum(g for _, g, _ in s), sum(w for _, _, w in s)) for s in (left, right)]
                    if min(w for _, w in sums) < p.min_weight:
                        continue
                    gain = (self.worth(*sums[0]) + self.worth(*sums[1]) - total) * (0.5 / SCALE**2)
                    key = (gain, -f, -at, not missing_left)
                    if gain > p.min_gain and (best is None or key > best[0]):
                        best = key, (gain, f, at, missing_left, left, right)
        return best and best[1]

    def grow(self, rows, tree, columns):
        """Splits [(level, node, f, threshold, missing_left, gain, cl, cr)] and the walk of a row to its leaf."""
        splits, tops, level = [], {}, 0
        value = self.leaf(sum(g for _, g, _ in rows), sum(w for _, _, w in rows)) if rows else 0
        nodes = {0: rows}
        while nodes and (self.p.depth is None or level < self.p.depth):
            below, child = {}, 0
            for node in sorted(nodes):
                found = self.best(nodes[node], tree, level, node, columns)
                if found:
                    gain, f, at, missing_left, left, right = found
                    values = [self.leaf(sum(g for _, g, _ in s), sum(w for _, _, w in s)) for s in (left, right)]
                    splits.append((level, node, f, at, missing_left, gain, len(left), len(right)))
                    tops[level, node] = (f, at, missing_left, child, values)
                    below[child], below[child + 1] = left, right
                    child += 2
            nodes, level = below, level + 1

        def walk(x):
            out, node, at = value, 0, 0
            while (at, node) in tops:
                f, threshold, missing_left, child, values = tops[at, node]
                right = not (missing_left if x[f] is None else x[f] <= threshold)
                out, node, at = values[right], child + right, at + 1
            return out

        return splits, walk

    def fit(self, rows):
        """rows: (rid, x, y in fixed point), x binned already.  All splits with their tree, and a predictor."""
        p, features = self.p, len(rows[0][1])
        splits, walks = [], []
        if p.kind == "boosted":
            base = math.floor(sum(y for _, _, y in rows) / len(rows) + 0.5)
            pred = [base] * len(rows)
            for tree in range(p.trees):
                sample = [(x, pr - y, 1) for (rid, x, y), pr in zip(rows, pred) if p.rows >= 1 or uniform(p.seed, tree, rid) < p.rows]
                found, walk = self.grow(sample, tree, tree_columns(p, tree, features))
                splits += [(tree, *s) for s in found]
                walks.append(walk)
                pred = [pr + walk(x) for pr, (_, x, _) in zip(pred, rows)]
            return splits, lambda x: (base + sum(w(x) for w in walks)) / SCALE
        cumulated = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
        for tree in range(p.trees):
            sample = []
            for rid, x, y in rows:
                u = uniform(p.seed, tree, rid)
                w = next((k for k in range(8) if u < cumulated[k]), 8) if p.bootstrap else 1
                if w and (p.bootstrap or p.rows >= 1 or u < p.rows):
                    sample.append((x, -y * w, w))
            found, walk = self.grow(sample, tree, list(range(features)))
            splits += [(tree, *s) for s in found]
            walks.append(walk)
        return splits, lambda x: sum(w(x) for w in walks) / float(p.trees) / SCALE
