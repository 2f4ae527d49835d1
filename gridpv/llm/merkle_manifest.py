"""Merkle manifest of a dataset: a root digest, and for each row the proof that it belongs to it.

Method: time-forward processing.  Nodes are labelled by (tree, level, place) and handled in that
order; each sends its digest forward to its parent through a priority queue ordered by the receiver's label.
The disk part of the queue is Spark's external sort: nodes are dealt by subtrees of ``fanout ** DEPTH`` places
and sorted by label; what a task sends on within a subtree goes through a heap.  The top of each
subtree is a message to the next round, until one node of each tree is left.  The trees' roots are the
leaves of one more tree.  A reversed sweep then goes down the same rounds: each node sends its proof
suffix (the siblings on the way to the root) to its children, and the leaves receive theirs.

A leaf is the SHA-256 of its columns, each ``-`` if null, else UTF-8 byte count, ``:``, value (numbers as
Spark prints them).  A node is the SHA-256 of its children's digests as hex text.  While a tree has multiple
nodes, each run of ``fanout`` consecutive ones (the last may be shorter, even one) gets a parent; the only leaf
of a tree is its root.  Leaves ascend by the order column, nulls first; rows that repeat a value follow in
the order of their digests, so equal rows may swap without effect.  Trees ascend by their column, null
first, then bytewise.  An empty table has no root and no rows.

A tree with a third of all rows is dealt by subtrees like any other.  The driver sees one row for
each partition (the trees at its ends) and the root.
"""

from __future__ import annotations

import hashlib
import heapq
from binascii import hexlify
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpv.llm.common import add_columns, checkpoint, read_table, slices

FANOUT = 16
#: Levels that one round handles: a task holds the nodes of one subtree of this depth at a time.
DEPTH = 3
DIGEST = 32
_LOCAL = 33  # bits of a row's position in monotonically_increasing_id


# ------------------------------------------------------------------ digests


def leaf_digests(docs: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """``docs`` with a leaf digest (binary) of the listed columns for each entry of ``variants``."""
    named = {c: f"_leaf_{i}" for i, c in enumerate(dict.fromkeys(c for cs in variants.values() for c in cs))}
    wide = docs.withColumns({to: F.col(f"`{c}`").cast("string") for c, to in named.items()})
    lists = [[named[c] for c in columns] for columns in variants.values()]

    def run(batch):
        widest = max(named.values(), key=lambda c: batch.column(c).nbytes)
        for part in slices(batch, widest):
            values = {c: part.column(c).cast(pa.large_binary()) for c in named.values()}
            out = []
            for columns in lists:
                digests = []
                for row in zip(*(values[c] for c in columns), strict=True):
                    h = hashlib.sha256()
                    for value in row:
                        if value.is_valid:
                            body = value.as_buffer()
                            h.update(b"%d:" % body.size)
                            h.update(body)
                        else:
                            h.update(b"-")
                    digests.append(h.digest())
                out.append(pa.array(digests, pa.binary()))
            yield part, out

    fields = ", ".join(f"`{name}` binary" for name in variants)
    return add_columns(wide, fields, run, drop=tuple(named.values()))


def parent_digest(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256(hexlify(b"".join(children))).digest()


def fold(leaf: bytes, shape: bytes, proof: bytes) -> bytes:
    """The root that ``leaf`` and the siblings of a proof give.  ``shape`` has two bytes for each level: the
    node's place in its run and the number of siblings, whose digests ``proof`` holds from left to right."""
    at = 0
    for place, siblings in zip(shape[::2], shape[1::2], strict=True):
        mid, end = at + DIGEST * place, at + DIGEST * siblings
        leaf = parent_digest((proof[at:mid], leaf, proof[mid:end]))
        at = end
    return leaf


# ------------------------------------------------------------------ sweeps within one subtree


def height_of(block: int, nodes: int, fanout: int, depth: int) -> tuple[int, bool]:
    """Levels above a subtree's lowest nodes, and whether its top is its tree's root: a first subtree with
    room left is the only one of its tree."""
    if block or nodes == fanout**depth:
        return depth, False
    height = 0
    while fanout**height < nodes:
        height += 1
    return height, True


def sweep_up(digests: list[bytes], height: int, fanout: int) -> list[list[bytes]]:
    """The digests of each level, the given lowest one first."""
    levels = [digests] + [[] for _ in range(height)]
    # messages (receiver's level, receiver's place, sender's place, digest); a sorted list is a heap
    queue = [(1, place // fanout, place, d) for place, d in enumerate(digests)] if height else []
    while queue:
        receiver, children = queue[0][:2], []
        while queue and queue[0][:2] == receiver:
            children.append(heapq.heappop(queue)[3])
        level, place = receiver
        levels[level].append(parent_digest(children))
        if level < height:
            heapq.heappush(queue, (level + 1, place // fanout, place, levels[level][-1]))
    return levels


def sweep_down(levels: list[list[bytes]], fanout: int, shape: bytes, proof: bytes) -> list[tuple[bytes, bytes]]:
    """Of each lowest node the shape and proof up to the root, given those of the top."""
    received = [(shape, proof)]
    for nodes in reversed(levels[:-1]):
        sent = []
        for place, _ in enumerate(nodes):
            parent, nth = divmod(place, fanout)
            run = nodes[parent * fanout : (parent + 1) * fanout]
            above = received[parent]
            siblings = b"".join(run[:nth] + run[nth + 1 :])
            sent.append((bytes((nth, len(run) - 1)) + above[0], siblings + above[1]))
        received = sent
    return received


def _subtrees(batches) -> Iterator[pa.Table]:
    """Cut a stream sorted by (tree, block) into one table for each of them."""
    held, last = [], None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if start < i:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


# ------------------------------------------------------------------ the distributed sweeps


def _dealt(nodes: DataFrame, *label: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *label)


def _climb(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """One round up: (tree, place, digest, done) of the top of each subtree."""
    span = fanout**depth
    schema = T.StructType().add("tree", nodes.schema["tree"].dataType).add("place", "long").add("digest", "binary").add("done", "boolean")

    def run(batches):
        for table in _subtrees(batches):
            tree, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
            height, done = height_of(block, table.num_rows, fanout, depth)
            top = sweep_up(table.column("digest").to_pylist(), height, fanout)[-1][0]
            columns = [[tree], [block], [top], [done]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, (table.schema.field("tree").type, pa.int64(), pa.binary(), pa.bool_()), strict=True)],
                names=["tree", "place", "digest", "done"],
            )

    slim = nodes.select("tree", F.expr(f"place div {span}").alias("block"), "place", "digest")
    return _dealt(slim, "place").mapInArrow(run, schema)


def _descend(nodes: DataFrame, messages: DataFrame, fanout: int, depth: int) -> DataFrame:
    """One round down: ``nodes`` with the shape, proof and subroot that follow from the messages (tree, block,
    shape, proof, subroot) to their subtrees."""
    span = fanout**depth
    schema = T.StructType([*nodes.schema.fields, *messages.select("shape", "proof", "subroot").schema.fields])
    kept = nodes.columns

    def run(batches):
        for table in _subtrees(batches):
            shape, proof, subroot = (table.column(c)[0].as_py() for c in ("shape", "proof", "subroot"))
            rows = table.slice(1).select(kept).combine_chunks()
            height, _ = height_of(table.column("block")[0].as_py(), rows.num_rows, fanout, depth)
            levels = sweep_up(rows.column("digest").to_pylist(), height, fanout)
            shapes, proofs = zip(*sweep_down(levels, fanout, shape, proof), strict=True)
            new = [pa.array(shapes, pa.binary()), pa.array(proofs, pa.binary()), pa.array([subroot] * rows.num_rows, pa.binary())]
            arrays = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
            yield pa.RecordBatch.from_arrays([*arrays, *new], names=[*kept, "shape", "proof", "subroot"])

    sent = messages.withColumn("place", F.lit(-1).cast("long"))
    both = nodes.withColumn("block", F.expr(f"place div {span}")).unionByName(sent, allowMissingColumns=True)
    return _dealt(both, "place").mapInArrow(run, schema)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``tree`` and ``digest``) with ``place``: the number of rows of the same tree before it."""
    label = ["tree", *order, "digest"]
    dealt = rows.repartitionByRange(*label).sortWithinPartitions(*label)
    dealt = checkpoint(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL).alias("part")
    runs = dealt.groupBy(part, "tree").agg(F.count("*").alias("n"), F.min("_at").alias("start"))
    ends = runs.groupBy("part").agg(
        F.min_by(F.struct("tree", "n"), "start").alias("first"), F.max_by(F.struct("tree", "n"), "start").alias("last"), F.count("*").alias("runs")
    )
    carried, before = {}, (None, 0)
    for e in sorted(ends.collect()):
        carried[e["part"]] = carry = before[1] if before[0] == e["first"]["tree"] else 0
        before = (e["last"]["tree"], e["last"]["n"] + (carry if e["runs"] == 1 else 0))
    fields = [f for f in dealt.schema.fields if f.name != "_at"]
    names = [f.name for f in fields]

    def run(batches):
        part, tree, offset = None, None, 0
        for batch in batches:
            places = []
            for at, t in zip(batch.column("_at").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                if at >> _LOCAL != part:
                    part, tree = at >> _LOCAL, t
                    offset = at - carried[part]
                elif t != tree:
                    tree, offset = t, at
                places.append(at - offset)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(places, pa.int64())], names=[*names, "place"])

    return dealt.mapInArrow(run, T.StructType(fields).add("place", "long"))


@dataclass
class Forest:
    """Trees over placed leaves: the nodes of each round and the trees' roots (tree, digest, round)."""

    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int
    depth: int

    @classmethod
    def grown(cls, leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> Forest:
        rounds, roots = [leaves], None
        while True:
            tops = checkpoint(_climb(rounds[-1], fanout, depth))
            done = tops.where("done").select("tree", "digest", F.lit(len(rounds) - 1).alias("round"))
            roots = done if roots is None else roots.union(done)
            rest = tops.where("NOT done").select("tree", "place", "digest")
            if rest.isEmpty():
                return cls(rounds, roots, fanout, depth)
            rounds.append(rest)

    def proofs(self, messages: DataFrame) -> DataFrame:
        """The leaves with shape, proof and subroot, from messages (tree, round, shape, proof, subroot) to the roots."""
        below = None
        for number, nodes in reversed(list(enumerate(self.rounds))):
            sent = messages.where(F.col("round") == number)
            sent = sent.select("tree", F.lit(0).cast("long").alias("block"), "shape", "proof", "subroot")
            if below is not None:
                sent = sent.union(below.select("tree", F.col("place").alias("block"), "shape", "proof", "subroot"))
            below = _descend(nodes, sent, self.fanout, self.depth)
        return below


@dataclass
class Manifest:
    """``root`` (hex text; None for an empty table), ``trees`` (tree, subroot) and ``leaves``: the carried columns,
    tree, place, leaf, subroot, shape and proof (see :func:`fold`); digests are binary."""

    root: str | None
    trees: DataFrame
    leaves: DataFrame


def build(leaves: DataFrame, tree_col: str, order_col: str, leaf_col: str = "leaf", fanout: int = FANOUT, depth: int = DEPTH) -> Manifest:
    """The manifest of rows with a leaf digest.  Their other columns are carried along (prefixed while on the way,
    so that any name may occur); the rows are written once beforehand."""
    carried = leaves.columns
    inner = {c: f"c{i}_" for i, c in enumerate(carried)}
    rows = leaves.select(
        F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{order_col}`").alias("order"),
        F.col(f"`{leaf_col}`").alias("digest"), *[F.col(f"`{c}`").alias(to) for c, to in inner.items()],
    )
    forest = Forest.grown(_placed(checkpoint(rows), "order"), fanout, depth)
    subroots = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("order"), "digest", "round")
    crown = Forest.grown(_placed(subroots, "order"), fanout, depth)
    top = crown.roots.first()
    empty = F.lit(b"")
    to_crown = crown.roots.select("tree", "round", empty.alias("shape"), empty.alias("proof"), F.col("digest").alias("subroot"))
    to_trees = crown.proofs(to_crown).select(F.col("order").alias("tree"), "round", "shape", "proof", F.col("digest").alias("subroot"))
    proven = forest.proofs(checkpoint(to_trees))
    out = proven.select(
        *[F.col(to).alias(c) for c, to in inner.items() if c != leaf_col], F.col("tree").alias("tree"), "place",
        F.col("digest").alias(leaf_col), "subroot", "shape", "proof",
    )
    return Manifest(top["digest"].hex() if top else None, forest.roots.select("tree", F.col("digest").alias("subroot")), out)


def verify(rows: DataFrame, leaf_col: str, out_col: str = "folded_root") -> DataFrame:
    """``rows`` (with shape and proof) with the root that ``leaf_col`` folds to (binary)."""

    def run(batch):
        for part in slices(batch, "proof", 1 << 23):
            triples = zip(*(part.column(c).to_pylist() for c in (leaf_col, "shape", "proof")), strict=True)
            yield part, ([fold(*t) for t in triples],)

    return add_columns(rows, f"`{out_col}` binary", run)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its leaf, the roots, its proof's digest, and whether the row as found (with the
    text lower-cased where 5 divides the CRC-32 of the id) still folds to the root."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", upper, upper.lower()))
    both = docs.withColumn("found_text", F.coalesce(changed, F.col("text")))
    variants = {"leaf": COLUMNS, "found": [*COLUMNS[:-1], "found_text"]}
    leaves = leaf_digests(both, variants).select("doc_id", "source", "leaf", "found")
    manifest = build(leaves, "source", "doc_id")
    folded = verify(manifest.leaves, "found")
    text = lambda c: F.lower(F.hex(c))
    return folded.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"),
        (text("folded_root") == F.lit(manifest.root).cast("string")).alias("verified"),
    )


def _oracle(fanout: int = FANOUT, levels: int = 8) -> str:
    """DuckDB SQL: the trees by one grouping for each level, the proofs and folds by joins up the levels."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
    fields = lambda text: " || ".join(field.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    ctes = [
        """r AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ord(x) AS UBIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')]),
          lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(0 AS UBIGINT) for i in range(8)]),
            lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, CAST(3988292384 AS UBIGINT)) ELSE b >> 1 END)), CAST(4294967295 AS UBIGINT)) % 5 = 0 AS hit FROM documents)""",
        f"""d AS (SELECT doc_id, source, sha256({fields('text')}) AS leaf, sha256({fields('found')}) AS found
          FROM (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found FROM r))""",
        """a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, leaf AS h FROM d)""",
    ]

    def tree(name: str, key: str) -> str:
        """CTEs name1..; the last level's h is the root of each key."""
        for i in range(1, levels + 1):
            ctes.append(
                f"""{name}{i} AS MATERIALIZED (SELECT {key}, CASE WHEN t = 1 THEN k ELSE k // {fanout} END AS k,
                CASE WHEN max(t) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY k0)) END AS h
                FROM (SELECT {key}, k, k AS k0, h, count(*) OVER (PARTITION BY {key}) AS t FROM {name}{i - 1}) GROUP BY {key}, 2)"""
            )
        return f"{name}{levels}"

    top = tree("a", "source")
    ctes.append(f"""b0 AS MATERIALIZED (SELECT 0 AS g, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, h FROM {top})""")
    root = tree("b", "g")
    ctes.append(f"""f0 AS (SELECT a0.doc_id, a0.source, a0.leaf, a0.k, a0.found AS f, '' AS proof, s.h AS subroot, s.k AS s FROM a0 JOIN b0 s ON a0.source IS NOT DISTINCT FROM s.source)""")

    def climb(name: str, at: str, i: int, before: str, same: str) -> str:
        """One level of proof and fold: the run that a node at place ``at`` belongs to."""
        new = f"f{len([c for c in ctes if c.startswith('f')])}"
        ctes.append(
            f"""{new} AS (SELECT x.* EXCLUDE (f, proof, {at}), CASE WHEN y.t = 1 THEN x.{at} ELSE x.{at} // {fanout} END AS {at},
            CASE WHEN y.t = 1 THEN x.f ELSE sha256(array_to_string(list_concat(y.hs[1:x.{at} % {fanout}], [x.f], y.hs[x.{at} % {fanout} + 2:]), '')) END AS f,
            CASE WHEN y.t = 1 THEN x.proof ELSE x.proof || array_to_string(list_concat(y.hs[1:x.{at} % {fanout}], y.hs[x.{at} % {fanout} + 2:]), '') END AS proof
            FROM {before} x JOIN (SELECT {same}, k // {fanout} AS run, list(h ORDER BY k) AS hs, max(t) AS t
              FROM (SELECT {same}, k, h, count(*) OVER (PARTITION BY {same}) AS t FROM {name}{i}) GROUP BY {same}, 2) y
            ON {'x.source IS NOT DISTINCT FROM y.source AND ' if same == 'source' else ''} x.{at} // {fanout} = y.run)"""
        )
        return new

    last = "f0"
    for i in range(levels):
        last = climb("a", "k", i, last, "source")
    for i in range(levels):
        last = climb("b", "s", i, last, "g")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM {last}, (SELECT h FROM {root}) root"""
    )


ORACLE_SQL = _oracle(levels=5)
