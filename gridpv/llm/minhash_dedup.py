"""MinHash near-dedup: documents whose sets of word shingles have a Jaccard similarity of a threshold
or more are linked, and one document of each connected group is kept.

Method: one-permutation hashing (one hash per shingle, the least in each of ``BANDS * ROWS`` bins) with
optimal densification (an empty bin copies a filled one found by hashing the bin and the attempt,
alike for all documents), banded buckets, and star-shaped candidate edges.

Equal sets form a class first; only class representatives (least id) are bucketed.  In each bucket
the other members are compared to a star centre (the least id) on full sets; connected components
follow.  A bucket whose members are then in one component is done; the others get a second star around the
member most like the first centre.  What is left goes through an exact prefix and position
filter: linked sets share one of the ``n - ceil(t * n) + 1`` rarest shingles of each, and from the first
that they share enough shingles have to follow in both.  Members outside the largest component of
their bucket are so matched with those of other components, and compared on full sets.  So no
bucket emits all its pairs, and no link between two members of a bucket is lost that would join
two components.

With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with a probability of 5e-8 (0.85:
6e-11).  Shingles and set equality go by 64-bit and 128-bit hashes.

Words are lower-cased from A to Z only.  A document with fewer words than a shingle has its whole
sequence as one shingle; one without words has none and is linked with nothing.  A class is named by the
least id of its rows and by the text of that row, so rows that repeat an id with other texts are compared each by
its own text; a null id sorts first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpv.llm.common import Texts, checkpoint, gram_hashes, mix, read_table, slices

BANDS, ROWS = 32, 4
#: Attempts to fill an empty bin that are drawn beforehand.
_ATTEMPTS = 1024


def shingles(texts: Texts, k: int) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, in order."""
    words = texts.hashes(lower=True)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(texts.first[:-1].tolist(), texts.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signatures:
    """One-permutation signatures and their band hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        step = (1 << 64) // self.bins
        self.edges = np.arange(self.bins, dtype=np.uint64) * np.uint64(step)
        self.probes = np.random.Generator(np.random.PCG64(20)).integers(0, self.bins, (_ATTEMPTS, self.bins))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted distinct hashes (at least one): the least in each bin, densified."""
        at = np.searchsorted(hashes, self.edges)
        filled = at < np.append(at[1:], len(hashes))
        values = hashes[np.minimum(at, len(hashes) - 1)] - self.edges
        empty = np.flatnonzero(~filled)
        for t in range(0, _ATTEMPTS, 16):
            if not len(empty):
                break
            tried = self.probes[t : t + 16, empty]
            good = filled[tried]
            hit = good.any(axis=0)
            source = tried[good.argmax(axis=0), np.arange(len(empty))]
            values[empty[hit]] = values[source[hit]]
            empty = empty[~hit]
        if len(empty):
            values[empty] = values[np.argmax(filled)]
        return values

    def band_hashes(self, signatures: np.ndarray) -> np.ndarray:
        """For each row of ``signatures`` one hash per band; the band is part of it."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(self.rows):
            out = mix(out + parts[:, :, j] * np.uint64(0xD6E8FEB86659FD93))
        return out


def _sign(k: int):
    def run(batches):
        make = Signatures()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(Texts(part.column("text")), k)
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                bands = np.zeros((0, make.bands), np.uint64)
                if len(some):
                    bands = make.band_hashes(np.stack([make.signature(sets[i]) for i in some]))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, make.bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("mark"),
                        pa.array(digests, pa.binary()),
                        pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64))),
                    ],
                    names=["id", "mark", "digest", "n", "bands"],
                )

    return run


def _compare(k: int, percent: int):
    """For rows (a, b, a_text, b_text): the Jaccard similarity of the full sets, and whether it is
    enough (in whole numbers)."""

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            for part in slices(batch, "b_text", 1 << 20):
                sets = shingles(Texts(part.column("b_text")), k)
                likeness, linked = [], []
                for text, y in zip(part.column("a_text"), sets, strict=True):
                    text = text.as_py()
                    if last[0] != text:
                        last = text, shingles(Texts(pa.array([text])), k)[0]
                    both = len(np.intersect1d(last[1], y, assume_unique=True))
                    either = len(last[1]) + len(y) - both
                    likeness.append(both / max(either, 1))
                    linked.append(100 * both >= percent * either)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(likeness, pa.float64()), pa.array(linked, pa.bool_())],
                    names=["a", "b", "likeness", "linked"],
                )

    return run


def _sets(k: int):
    """Rows (node, n, shingle) of the texts of nodes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingles(Texts(part.column("text")), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                node = part.column("node").take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([node, pa.array(np.repeat(sizes, sizes)), values], names=["node", "n", "shingle"])

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of ``u`` (for ``large`` the greater ones, else the smaller ones and ``u``) are
    linked to the least of ``u`` and its neighbours."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` only, and no ``v`` is a ``u``."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("ups"), F.lit(0).alias("top"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("ups").alias("ups"), F.max("top").alias("top"))
    return ends.where("ups > 1 OR ups = 1 AND top = 1").isEmpty()


#: Edges for which a task is worth while.
TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node that it reaches) for the nodes of ``edges`` (a, b), by
    large-star and small-star steps until each component is a star around its least node.

    The steps run in as many tasks as there are edges for: each task of a shuffle costs files, whatever it holds."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    tasks = edges.count() // TASK_EDGES + 1  # the steps add no edges
    edges = edges.coalesce(tasks)
    while not _are_stars(edges):
        large = _star(edges, True).coalesce(tasks)
        edges = checkpoint(_star(large, False).coalesce(tasks).distinct().coalesce(tasks))
    tops = edges.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def _rank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def _mark(text_col: str) -> Column:
    """The MD5 of a text (null: empty): it tells apart the texts of rows that repeat an id."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> tuple[DataFrame, DataFrame]:
    """Signatures (id, mark, digest, n, bands, row) of all rows, and per class of equal sets (digest) its
    ``component``: the least (id, mark) that it reaches."""
    plain = docs.select(_rank(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _mark(text_col).alias("mark"))
    signed = plain.mapInArrow(_sign(k), "id long, mark binary, digest binary, n long, bands array<long>")
    # the rows are numbered once, in the checkpoint; the least number of a class is its node
    signed = checkpoint(signed.withColumn("row", F.monotonically_increasing_id()))
    classes = signed.where("n > 0").groupBy("digest")
    classes = classes.agg(F.min("row").alias("node"), F.min(F.struct("id", "mark")).alias("head"), F.first("bands").alias("bands"))
    rows = classes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = checkpoint(rows.join(shared.select("bucket"), "bucket"))
    nodes = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "head.id", "head.mark")
    texts = checkpoint(plain.join(nodes, ["id", "mark"]).groupBy("node").agg(F.first("text").alias("text")))

    def compared(pairs: DataFrame) -> DataFrame:
        held = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        held = held.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        held = held.select("a", "b", "a_text", "b_text")
        return checkpoint(held.mapInArrow(_compare(k, percent), "a long, b long, likeness double, linked boolean"))

    def still_open(found: DataFrame) -> DataFrame:
        """Members of the buckets that hold two components or more, with the largest of these."""
        labelled = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        spread = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("top"))
        return checkpoint(labelled.join(spread.where("parts > 1").select("bucket", F.col("top.component").alias("largest")), "bucket"))

    centres = members.groupBy("bucket").agg(F.min("node").alias("a"))
    first = compared(members.join(centres, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    links = first.where("linked").select("a", "b")
    found = components(links)

    rest = still_open(found)
    if not rest.isEmpty():
        near = rest.join(centres, "bucket").where("node <> a").select("bucket", "a", F.col("node").alias("b"))
        near = near.join(first.select("a", "b", "likeness"), ["a", "b"])
        second = near.groupBy("bucket").agg(F.max(F.struct("likeness", (-F.col("b")).alias("b"))).alias("best"))
        second = second.select("bucket", (-F.col("best.b")).alias("a"))
        pairs = rest.join(second, "bucket").where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        more = compared(pairs.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"))
        links = links.union(more.where("linked").select("a", "b"))
        found = components(links)
        rest = still_open(found)
    if not rest.isEmpty():
        some = rest.select("node", "component").distinct()
        held = texts.join(some, "node").select("node", "text").mapInArrow(_sets(k), "node long, n long, shingle long")
        times = held.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
        order = Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "shingle")
        prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
        # shingles of one set only cannot be shared; they count as the rarest all the same
        ranked = held.join(times, "shingle", "left").withColumn("nth", F.row_number().over(order))
        ranked = ranked.where((F.col("nth") <= prefix) & F.col("times").isNotNull()).drop("times")
        ranked = checkpoint(ranked.join(some, "node"))
        odd = rest.where("component <> largest").select("node").distinct()
        left = ranked.join(odd, "node", "left_semi").toDF("x", "shingle", "x_n", "x_nth", "x_component")
        right = ranked.toDF("y", "shingle", "y_n", "y_nth", "y_component")
        # at the first shingle that two sets share, what follows in either bounds all they share
        shared_at_most = 1 + F.least(F.col("x_n") - F.col("x_nth"), F.col("y_n") - F.col("y_nth"))
        enough = (100 + percent) * shared_at_most >= percent * (F.col("x_n") + F.col("y_n"))
        pairs = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("x_component") != F.col("y_component")) & enough)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        last = compared(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"))
        links = links.union(last.where("linked").select("a", "b"))
        found = components(links)
    tops = found.join(classes.select("node", "head"), "node").groupBy("component").agg(F.min("head").alias("top"))
    heads = classes.select("digest", "node", "head").join(found.join(tops, "component").select("node", "top"), "node", "left")
    return signed, heads.select("digest", F.coalesce("top", "head").alias("component"))


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept`` (the id is that of its
    component).  Rows without shingles are their own component."""
    signed, heads = near_duplicates(docs, id_col, text_col, k, percent)
    component = F.coalesce(F.col("component.id"), F.col("id"))
    null = F.lit(-(2**63))
    return signed.join(heads, "digest", "left").select(
        F.when(F.col("id") != null, F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(component != null, component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the rows of its least id and, where
    texts differ, least text mark stay, and of rows that repeat an id and a text one (the first by its other
    columns as JSON).  Texts without words are linked with nothing."""
    signed, heads = near_duplicates(docs, id_col, text_col, k, percent)
    gone = signed.join(heads, "digest").where((F.col("id") != F.col("component.id")) | (F.col("mark") != F.col("component.mark")))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _rank(id_col).alias("row_id"), _mark(text_col).alias("row_mark"))
    kept = rows.join(gone, (F.col("row_id") == F.col("gone_id")) & (F.col("row_mark") == F.col("gone_mark")), "left_anti")
    order = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != text_col.lower()]))
    return kept.groupBy("row_id", "row_mark").agg(F.min_by("row", order).alias("row")).select("row.*")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its set size, component and whether it is kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_duplicates(docs, k=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS s
  FROM w
), x AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT a AS doc_id, a AS c FROM p
  UNION
  SELECT r.doc_id, p.b AS c FROM r JOIN p ON r.c = p.a
), c AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
       coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""
