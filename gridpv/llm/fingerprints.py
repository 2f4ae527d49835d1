"""Document fingerprints by randomised edit embedding.

Method: a walk over the characters, shared by all documents.  Step ``j`` reads the current
character and by a random bit of (step, character) either stays or moves on, so that texts
that differ by edits fall into step again and edit distance becomes Hamming distance between the
walks.  A fingerprint keeps random bits of (step, character) at sampled steps: every step up to
``DENSE``, then ``DENSE`` steps of each octave, so short and long texts are compared at their own
scale.  Fingerprints are then bucketed by bands of sampled bits, and pairs that meet are verified.
Bands get wider with the number of fingerprints, so that strangers seldom meet, and more, so that a pair
at the threshold is still missed in no more than ``MISSED`` of cases if its differing bits are spread evenly.

``likeness`` weighs each sampled step with the stretch of the walk that it stands for; where only one
text goes on, steps count as different.  Equal random bits by chance are discounted, so unrelated
texts are near 0 and equal ones at 1.

A null text is an empty one; its fingerprint is "0:".  The next document is that of the next id (null first; rows of equal id by a hash of the text);
the last is followed by the first, and a lone document by itself.
Documents of equal fingerprints are a class, named by its least id; null where none has an id.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import add_columns, checkpoint, read_table, slices, stored
from gridpv.llm.minhash_dedup import components

DENSE = 128
SEED = 8
#: Character classes of the walk (code points modulo this); a further one marks the end of a text.
CLASSES = 251
#: Bands of sampled bits, and bits of a band.
BANDS, BAND_BITS = 16, 16
#: Up to so many texts walk one by one; for more, a step of all at once is faster.
FEW = 48
#: Steps whose random bits are drawn at once.
BLOCK = 1024


@functools.cache
def _octave_steps(low: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([SEED, 1, low]))
    return low + np.sort(rng.choice(low, DENSE, replace=False))


def sampled_steps(limit: int) -> np.ndarray:
    """The sampled steps below ``limit``: all up to DENSE, then DENSE random ones in each octave."""
    out, low = [np.arange(min(DENSE, limit))], DENSE
    while low < limit:
        out.append(_octave_steps(low))
        low *= 2
    steps = np.concatenate(out)
    return steps[steps < limit]


@functools.lru_cache(4096)
def step_spans(n: int) -> np.ndarray:
    """The stretch of the walk that each of the first ``n`` sampled steps stands for."""
    at = np.arange(n)
    spans = np.where(at < DENSE, 1.0, 2.0 ** np.maximum(at // DENSE - 1, 0))
    spans.flags.writeable = False  # shared by all callers
    return spans


def _random_bits(block: int, kind: int) -> np.ndarray:
    """Bits of (step in the block, class), drawn alike everywhere."""
    rng = np.random.Generator(np.random.PCG64([SEED, 2 + kind, block]))
    return rng.integers(0, 2, (BLOCK, CLASSES + 1), dtype=np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: "n:bits", the number of sampled steps of its walk and their
    bits in hex.  All texts walk in step, and those that are through leave."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # every text is followed by one end mark, on which the walk stays
    data = np.full(int(sizes.sum()) + len(texts), CLASSES, np.uint8)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    for start, text in zip(first.tolist(), texts, strict=True):
        data[start : start + len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32) % CLASSES
    at, end = first.copy(), first + sizes
    alive = np.flatnonzero(sizes > 0)
    kept: list[list[np.ndarray]] = [[] for _ in texts]
    block = 0
    plain = b""  # the data as bytes, once few texts are left
    while len(alive):
        moves, bits = _random_bits(block, 0), _random_bits(block, 1)
        moves[:, CLASSES] = 0
        bits[:, CLASSES] = 2
        steps = sampled_steps((block + 1) * BLOCK) - block * BLOCK
        steps = steps[steps >= 0].tolist()
        if len(alive) > FEW:
            wanted = set(steps)
            shifts = moves.astype(np.int64)
            now = at[alive]
            samples = []
            for j in range(BLOCK):
                char = data.take(now)
                if j in wanted:
                    samples.append(bits[j].take(char))
                now += shifts[j].take(char)
            at[alive] = now
            if samples:
                for i, row in zip(alive.tolist(), np.stack(samples, axis=1), strict=True):
                    kept[i].append(row[row < 2])
        else:
            plain = plain or data.tobytes()
            rows = [r.tobytes() for r in moves]
            for i in alive.tolist():
                place, seen, j = int(at[i]), [], 0
                for step in steps:
                    for row in rows[j:step]:
                        place += row[plain[place]]
                    seen.append(plain[place])
                    j = step
                for row in rows[j:]:
                    place += row[plain[place]]
                at[i] = place
                row = bits[steps, seen]
                kept[i].append(row[row < 2])
        alive = alive[at[alive] < end[alive]]
        block += 1
    out = []
    for parts in kept:
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        out.append(f"{len(bits)}:{np.packbits(bits).tobytes().hex()}")
    return out


def parse(fingerprint: str) -> np.ndarray:
    """The sampled bits."""
    n, _, digits = fingerprint.partition(":")
    return np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8))[: int(n)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of the walks that agree, less what agrees by chance."""
    most, n = max(len(a), len(b)), min(len(a), len(b))
    if not most:
        return 1.0
    spans = step_spans(most)
    same = a[:n] == b[:n]
    return max(float(spans[:n] @ np.where(same, 1.0, -1.0)), 0.0) / float(spans.sum())


@functools.cache
def _band_picks(octave: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, 4, octave])).integers(0, octave * DENSE, (BANDS, BAND_BITS))


def bands(bits: np.ndarray) -> list[tuple[int, int, int]]:
    """Keys (octave, band, value) of sampled bits: at the octave that the walk has just filled and
    the one below, so that texts of similar length meet."""
    full = len(bits) // DENSE
    out = []
    for octave in {max(full, 1), max(full - 1, 1)}:
        have = bits[: octave * DENSE]
        if len(have) < octave * DENSE:  # a short text: its missing steps read as 0
            have = np.concatenate([have, np.zeros(octave * DENSE - len(have), np.uint8)])
        values = have[_band_picks(octave)] @ (1 << np.arange(BAND_BITS))
        out += [(octave, i, int(v)) for i, v in enumerate(values)]
    return out


#: Share of pairs at the threshold that may meet in no bucket.
MISSED = 0.02
#: A band has so many bits more than it takes to number the fingerprints.
SPARE_BITS = 6


def band_plan(n: int, least: float) -> tuple[int, int]:
    """Bits of a band and bands for ``n`` fingerprints, to meet at a likeness of ``least``."""
    width = min(max(math.ceil(math.log2(max(n, 2))) + SPARE_BITS, 8), 40)
    meet = ((1 + least) / 2) ** width
    count = 1 if meet >= 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-meet)))
    if count > 4096:
        raise ValueError("the threshold is too low for this many fingerprints")
    return width, count


@functools.cache
def _levels(least: float, most: int) -> tuple[list[int], list[float]]:
    """Numbers of steps at which walks are bucketed, the last one beyond ``most``, and the stretches
    of the walk up to them: finely graded below DENSE, then whole octaves."""
    steps = [1]
    while steps[-1] < DENSE:
        steps.append(min(max(steps[-1] + 1, int(steps[-1] / max(least, 0.5))), DENSE))
    while steps[-1] <= most:
        steps.append(steps[-1] + DENSE)
    spans = np.concatenate([[0.0], np.cumsum(step_spans(steps[-1]))])
    return steps, spans[steps].tolist()


@functools.cache
def _picks(steps: int, width: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, 5, steps])).integers(0, steps, (count, width))


def buckets(bits: np.ndarray, least: float, width: int, count: int) -> list[int]:
    """Bucket numbers of sampled bits, at each level that a walk which is like it to ``least`` can have filled."""
    n = len(bits)
    steps, spans = _levels(least, -(-(n + 1) // DENSE) * DENSE)
    if not n:
        return []
    own = sum(x <= n for x in steps) - 1
    need = least * float(step_spans(n).sum())
    out: list[int] = []
    for level in range(own, -1, -1):
        if level < own and spans[level + 1] <= need:
            break
        values = bits[_picks(steps[level], width, count)] @ (1 << np.arange(width, dtype=np.int64))
        out += ((np.arange(count) + (level << 12) << 40) + values).tolist()
    return out


#: Bytes of text that walk together: a step costs as much for few walks as for hundreds.
TOGETHER = 1 << 25
#: Bytes of text that are compressed at once.
DEALT = 1 << 23


def add_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col``."""

    def run(batch):
        for part in slices(batch, text_col, TOGETHER):
            yield part, (fingerprints([t or "" for t in part.column(text_col).to_pylist()]),)

    return add_columns(docs, f"`{out_col}` string", run)


def classes(marked: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """Each fingerprint (print) with the least id (id) and the number (n) of its documents: equal fingerprints are a class."""
    return marked.groupBy(F.col(print_col).alias("print")).agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("n"))


def linked_pairs(ids: list[int], parts: list[int], prints: list[str], least: float) -> list[tuple[int, int, float]]:
    """Pairs (a, b, likeness) of fingerprints of different ``parts`` that are like to ``least``: enough of them to join all
    that any such pair would join, at most one per part.  All against all by one product of matrices."""
    bits = [parse(x) for x in prints]
    sizes = np.array([len(x) for x in bits])
    signs = np.zeros((len(bits), max(sizes.max(initial=0), 1)), np.float32)
    for row, x in zip(signs, bits, strict=True):
        row[: len(x)] = x * np.float32(2) - np.float32(1)
    spans = step_spans(signs.shape[1])
    total = np.concatenate([[0.0], np.cumsum(spans)])
    _, label = np.unique(np.array(parts, np.int64), return_inverse=True)
    up = list(range(len(bits)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    # spans are powers of two: sums are exact in single precision while walks are shorter than that holds
    kind = np.float32 if total[-1] < 1 << 24 else np.float64
    signs = signs.astype(kind, copy=False)
    weighed = signs * spans.astype(kind)
    found = []
    for at in range(0, len(bits), 256):
        same = (weighed[at : at + 256] @ signs.T).astype(np.float64)
        whole = total[np.maximum(sizes[at : at + 256, None], sizes[None, :])]
        like = np.maximum(same, 0.0) / np.maximum(whole, 1.0)
        apart = label[at : at + 256, None] != label[None, :]
        for i, j in np.argwhere((like >= least) & apart & (np.arange(len(bits)) > np.arange(at, at + len(same))[:, None])).tolist():
            x, y = top(label[at + i]), top(label[j])
            if x != y:
                up[x] = y
                found.append((min(ids[at + i], ids[j]), max(ids[at + i], ids[j]), float(like[i, j])))
    return found


#: Blocks of up to so many members are compared together, larger ones one by one.
SMALL = 32
#: Members of blocks, and pairs of them, that are held at once.
HELD, PAIRS = 1 << 13, 1 << 16


def _packed(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of sampled bits, and the bits as rows of 64-bit words with zeros behind."""
    cut = [x.partition(":") for x in prints]
    sizes = np.array([int(n) for n, _, _ in cut], np.int64)
    wide = (int(sizes.max(initial=0)) + 63) // 64 * 16
    raw = bytes.fromhex("".join(digits.ljust(wide, "0") for _, _, digits in cut))
    return sizes, np.frombuffer(raw, np.uint64).reshape(len(prints), wide // 16)


def linked_in_blocks(starts: np.ndarray, ids: list[int], parts: list[int], prints: list[str], least: float) -> list[tuple[int, int, float]]:
    """``linked_pairs`` of each of the small blocks that begin at ``starts``; all their pairs are compared together."""
    sizes, words = _packed(prints)
    total = np.concatenate([[0.0], np.cumsum(step_spans(max(int(sizes.max(initial=0)), 1)))])
    spans = step_spans(max(words.shape[1], 1) * 64)[::64]
    lengths, which = np.unique(sizes, return_inverse=True)
    masks = np.zeros((len(lengths), words.shape[1] * 8), np.uint8)
    for row, n in zip(masks, lengths.tolist(), strict=True):
        row[: (n + 7) // 8] = np.packbits(np.ones(n, np.uint8))
    masks = masks.view(np.uint64)
    label = np.unique(np.array(parts, np.int64), return_inverse=True)[1]
    members = np.diff(np.append(starts, len(prints)))
    a, b = [], []
    for size in np.unique(members[members > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        first = starts[members == size][:, None]
        a.append((first + i).ravel())
        b.append((first + j).ravel())
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    short, long = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    # the longer one's further steps count as different, so some are too long for any other
    worth = (label[a] != label[b]) & (total[short] >= least * total[long] * (1 - 1e-9))
    a, b = a[worth], b[worth]
    hits = []
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        ends = which[np.where(sizes[x] <= sizes[y], x, y)]
        apart = np.bitwise_count((words[x] ^ words[y]) & masks[ends]).astype(np.float64) @ spans[: words.shape[1]]
        same = total[np.minimum(sizes[x], sizes[y])] - 2 * apart
        like = np.maximum(same, 0.0) / np.maximum(total[np.maximum(sizes[x], sizes[y])], 1.0)
        hits += [(int(x[k]), int(y[k]), float(like[k])) for k in np.flatnonzero(like >= least)]
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def top(key):
        while (above := up.get(key, key)) != key:
            key = above
        return key

    block = np.repeat(np.arange(len(starts)), members)
    found = []
    for i, j, like in sorted(hits):
        x, y = top((int(block[i]), int(label[i]))), top((int(block[j]), int(label[j])))
        if x != y:
            up[x] = y
            found.append((min(ids[i], ids[j]), max(ids[i], ids[j]), like))
    return found


#: Members of a bucket that are compared at once with as many others.
BLOCK_MEMBERS = 1024


def near_documents(
    marked: DataFrame, least: float = 0.8, id_col: str = "doc_id", print_col: str = "fingerprint"
) -> DataFrame:
    """Verified pairs (a, b, likeness) that link documents which meet in a band: enough of them to join all that any
    such pairs would join (``components`` of them are the near-duplicate groups), not every pair of a group.

    First each document is compared to one other, the least of a bucket that it meets most often.  Buckets whose members
    are then in one component are done.  In the others all members of different components are compared, inside the
    tasks and without a row per pair: a bucket is dealt to blocks of at most about ``2 * BLOCK_MEMBERS`` members, so that each two
    members meet in one, and of a block only the pairs that join its components come out.  Equal fingerprints
    count as one document, that of the least id (``classes`` has the others); rows without id are left out."""
    known = classes(marked.where(F.col(id_col).isNotNull()), id_col, print_col)
    return near_prints(checkpoint(known.select("id", "print")), least)


def near_prints(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """``near_documents`` of the classes (id, print)."""
    width, count = band_plan(prints.count(), least)

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [buckets(parse(x), least, width, count) for x in part.column("print").to_pylist()]
                ids = np.repeat(part.column("id").to_numpy(), [len(r) for r in rows])
                values = np.array([v for r in rows for v in r], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values)], names=["id", "bucket"])

    def verify(batches):
        for batch in batches:
            pairs = zip(batch.column("a_print").to_pylist(), batch.column("b_print").to_pylist(), strict=True)
            found = pa.array([likeness(parse(x), parse(y)) for x, y in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), found], names=["a", "b", "likeness"])

    def links_of(rows):
        """The pairs that the blocks of ``rows`` join."""
        keys = [rows.column(n).to_numpy() for n in ("bucket", "i", "j")]
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, rows.num_rows))
        found = []
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            found += linked_pairs(*(rows.column(n).slice(start, size).to_pylist() for n in ("id", "component", "print")), least)
        few = (sizes > 1) & (sizes <= SMALL)
        if few.any():
            kept = rows.filter(pa.array(np.repeat(few, sizes)))
            firsts = np.cumsum(sizes[few]) - sizes[few]
            found += linked_in_blocks(firsts, *(kept.column(n).to_pylist() for n in ("id", "component", "print")), least)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "likeness"])

    def compare(batches):
        """Of rows sorted by block, the pairs that each block joins.  Whole blocks are held until there are many."""
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held.num_rows < HELD:
                continue
            last = [held.column(n)[-1].as_py() for n in ("bucket", "i", "j")]
            own = [held.column(n).to_numpy() == v for n, v in zip(("bucket", "i", "j"), last, strict=True)]
            whole = int(np.argmax(np.logical_and.reduce(own)))  # the last block may go on
            if whole:
                yield links_of(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield links_of(held)

    members = prints.mapInArrow(keys, "id long, bucket long").repartition("bucket")  # one shuffle for both uses
    firsts = members.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = stored(members.join(firsts, "bucket").select("bucket", "id", "first"))
    met = members.where("id > first").groupBy("id", "first").agg(F.count("*").alias("times"))
    nearest = met.groupBy("id").agg(F.max(F.struct("times", (-F.col("first")).alias("other"))).alias("best"))
    pairs = nearest.select((-F.col("best.other")).alias("a"), F.col("id").alias("b"))
    pairs = pairs.join(prints.select(F.col("id").alias("a"), F.col("print").alias("a_print")), "a")
    pairs = pairs.join(prints.select(F.col("id").alias("b"), F.col("print").alias("b_print")), "b")
    done = checkpoint(pairs.select("a", "b", "a_print", "b_print").mapInArrow(verify, "a long, b long, likeness double"))
    links = done.where(F.col("likeness") >= least)

    parts = components(links)
    rest = members.join(parts, members["id"] == parts["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    spread = rest.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    spread = spread.where("low < high").select("bucket", F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    rest = rest.join(spread, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rest = rest.select("bucket", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = rest.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component")
    rest = rest.join(prints, "id").select("bucket", "i", "j", "id", "component", "print")
    rest = rest.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    more = rest.mapInArrow(compare, "a long, b long, likeness double").dropDuplicates(["a", "b"])
    return checkpoint(links.union(more))


def neighbours(docs: DataFrame, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """Streams ``docs`` (id, text) in order of the id: ``make(ids, texts)`` gets runs of rows, of which
    each but the last is followed by its next one, and returns arrays for all but the last.

    Ranges of ids are dealt to partitions; the first row of each range also goes to the range before
    it (that of the first to the last).  Only the ranges' first ids come to the driver.  Texts are shuffled
    compressed, and unpacked in runs of bounded size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("id").repartitionByRange(wanted, "id").groupBy(F.spark_partition_id()).agg(F.min("id"))
    starts = np.array(sorted(r[1] for r in ranges.collect()), np.int64)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in slices(batch, "text", DEALT):
                texts = [t.encode() for t in piece.column("text").to_pylist()]
                own = np.searchsorted(starts, piece.column("id").to_numpy(), side="right") - 1
                packed = pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.astype(np.int32)),
                        pa.array([False] * len(texts), pa.bool_()),
                        piece.column("id"),
                        pa.array([hashlib.blake2b(t, digest_size=8).digest() for t in texts], pa.binary()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([pack.compress(t) for t in texts], pa.binary()),
                    ],
                    names=["part", "ahead", "id", "hash", "size", "packed"],
                )
                yield packed
                leads = packed.take(pa.array(np.flatnonzero(starts[own] == piece.column("id").to_numpy())))
                before = (leads.column("part").to_numpy() - 1) % len(starts)
                leads = leads.set_column(0, "part", pa.array(before.astype(np.int32)))
                yield leads.set_column(1, "ahead", pa.array([True] * len(before), pa.bool_()))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # the last row, which waits for its next one
        for batch in batches:
            for piece in slices(batch, "size", TOGETHER):
                texts = [unpack.decompress(t).decode() for t in piece.column("packed").to_pylist()]
                got = zip(*(piece.column(c).to_pylist() for c in ("part", "ahead", "id")), texts, strict=True)
                runs: list[list[tuple]] = [held]
                for row in got:
                    last = runs[-1][-1] if runs[-1] else None
                    if last and last[1] and last[0] == row[0]:
                        continue  # a further row of the id that leads the next range
                    if last and last[0] != row[0]:
                        runs.append([])
                    runs[-1].append(row)
                held = runs[-1][-1:]
                for part in runs:
                    if len(part) > 1:
                        yield make([r[2] for r in part[:-1]], [r[3] for r in part])

    dealt = rows.mapInArrow(deal, "part int, ahead boolean, id long, hash binary, size long, packed binary")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "ahead", "id", "hash", "packed")
    return ordered.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much of the start of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: the fingerprints of its text and its edited text, and the likeness
    of the first to the second and to that of the next document; then the bands shared with each.  Last its class, the
    class's documents, how many verified links of the search (likeness of 0.8 or more) lead to other classes, and the
    near-duplicate group that the links make: its least id and its documents.  Rows of a class without id are a
    group of their own."""

    def make(ids, texts):
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        prints = fingerprints(texts + changed)
        own, altered = prints[: len(texts)], prints[len(texts) :]
        bits = [parse(p) for p in prints]
        keys = [set(bands(b)) for b in bits]
        n = len(ids)
        near = lambda other: [likeness(bits[i], bits[other(i)]) for i in range(n)]
        shared = lambda other: [len(keys[i] & keys[other(i)]) for i in range(n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == -(2**63) else i for i in ids], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(own[:-1]),
                pa.array(altered),
                pa.array(near(lambda i: n + 1 + i), pa.float64()),
                pa.array(near(lambda i: i + 1), pa.float64()),
                pa.array(shared(lambda i: n + 1 + i), pa.int64()),
                pa.array(shared(lambda i: i + 1), pa.int64()),
            ],
            names=[f.split()[0] for f in fields],
        )

    fields = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, bands_edited long, bands_next long"
    ).split(", ")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = stored(neighbours(docs, "doc_id", "text", make, ", ".join(fields)))
    known = checkpoint(classes(marked))  # a class has an id if any of its rows has one
    pairs = near_prints(known.where("id IS NOT NULL").select("id", "print"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = components(pairs).join(links.withColumnRenamed("id", "node"), "node")
    linked = known.join(linked, F.col("id") == F.col("node")).select("print", "id", "n", "n_links", "component")
    totals = linked.groupBy("component").agg(F.sum("n").alias("total"))
    linked = linked.join(totals, "component").select("print", "n_links", "component", "total")
    known = known.join(linked, "print", "left").select(
        "print",
        F.col("id").alias("class_id"),
        F.col("n").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("total", "n").alias("component_size"),
    )
    return marked.join(known, F.col("fingerprint") == F.col("print")).drop("print")
