"""Substring dedup: remove words covered by a window of words that also starts earlier.

Method: a compressed FM-index per shard.  Backward search over a wavelet matrix computes the
matching statistics of the streamed texts, and the intervals that reach the threshold are
reported together with the earliest place where they occur.

A window is ``window`` consecutive words of one document.  Its *route* is the least hash of the
``GRAM``-word grams inside it, so equal windows have equal routes.  Consecutive windows with the
same route form a segment.  Only routes that occur twice or more in the corpus can hold a
repeated window; segments of those are dealt to shards by route, and each shard builds an index
over its distinct segments and searches them in it.  Routes with more than ``HOT`` occurrences
are dealt by the hash of each single window instead, so that no shard grows with a hot passage.
Before the shuffle, each batch keeps only the earliest of equal segments; the others are
certain to be repeats already.  Whole documents equal to an earlier one take no part in the
search: every window of theirs is a repeat.

Order: (document id, start).  A null id sorts first.  Rows that repeat an id have the same rank,
so they are never earlier than each other.  A null or empty text has no words.  Words are
compared by 64-bit hashes, whole documents by SHA-256.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import Texts, add_columns, checkpoint, gram_hashes, read_table, slices, sliding

#: Words of a gram from which routes are made.
GRAM = 6
#: Occurrences beyond which a route's windows are dealt one by one.
HOT = 16384
#: Windows of a segment at most; longer ones are cut (their windows stay whole).
SEGMENT = 128
#: Segments that a shard holds on average.
SHARD = 16384


# ----------------------------------------------------------------------------- the index


class BitVector:
    """Bits packed in 64-bit words with a count before each word; ``rank`` counts ones."""

    def __init__(self, bits: np.ndarray):
        pad = (-len(bits)) % 64 + 64
        packed = np.packbits(np.concatenate([bits, np.zeros(pad, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol before any position, in one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift) & 1 == 1
            self.levels.append((shift, BitVector(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, up to a constant of the symbol: where its
        run begins after the last level.  Ranks of one symbol differ as their counts do."""
        for shift, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """An index of token sequences for patterns of up to ``depth`` tokens.

    Suffixes are sorted by their first ``depth`` tokens only (a bounded-context transform),
    which keeps backward search exact for patterns of that length.  ``tokens`` holds the
    sequences, each ended by the token 0; the others are 1 and up.
    """

    def __init__(self, tokens: np.ndarray, depth: int):
        n = len(tokens)
        self.depth = depth
        by: dict[int, np.ndarray] = {1: tokens.astype(np.int64)}
        size = 1
        while size < depth:
            step = min(size, depth - size)
            while step not in by:
                step -= 1
            follow = np.zeros(n, np.int64)
            follow[: n - size] = by[step][size:]
            key = by[size] * (int(follow.max()) + 1) + follow
            size += step
            by[size] = np.unique(key, return_inverse=True)[1]
        self.order = np.argsort(by[depth], kind="stable")
        ranks = by[depth][self.order]
        self.block = np.concatenate([[0], np.flatnonzero(np.diff(ranks)) + 1])
        self.block_of = ranks
        sigma = int(tokens.max()) + 1
        self.wavelet = WaveletMatrix(tokens[self.order - 1].astype(np.int64), max(1, (sigma - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=sigma))])
        self.zero = self.wavelet.rank(np.arange(sigma), np.zeros(sigma, np.int64))
        self.tokens = tokens
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def shared(self) -> np.ndarray:
        """Tokens that each suffix in order shares with the one before it, up to ``depth``."""
        n = len(self.tokens)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(n, np.int64)
        equal = np.ones(n - 1, bool)
        for _ in range(self.depth):
            equal &= self.tokens[np.minimum(a, n - 1)] == self.tokens[np.minimum(b, n - 1)]
            equal &= (a < n) & (b < n)
            if not equal.any():
                break
            out[1:] += equal
            a += 1
            b += 1
        return out

    def widen(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix in order, the range of those with the same first ``depth`` tokens."""
        if depth not in self._blocks:
            n = len(self.tokens)
            starts = np.flatnonzero(self.shared < depth)
            sizes = np.diff(np.append(starts, n))
            self._blocks[depth] = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        return self._blocks[depth]

    def extend(self, low: np.ndarray, high: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the ranges of the patterns with ``token`` before them."""
        m = len(low)
        ranks = self.wavelet.rank(np.concatenate([token, token]), np.concatenate([low, high]))
        base = self.smaller[token] - self.zero[token]
        return ranks[:m] + base, ranks[m:] + base

    def search(self, queries: np.ndarray, first: np.ndarray):
        """Matching statistics of queries (``queries[first[i]:first[i + 1]]``), capped at
        ``depth``: yields (positions, match lengths, ranges) from each query's end to its start.
        Tokens that the index lacks have to be given as -1."""
        lengths = np.diff(first)
        rows = np.argsort(-lengths, kind="stable")
        ordered = -lengths[rows]
        n = len(self.tokens)
        low = np.zeros(len(rows), np.int64)
        high = np.full(len(rows), n, np.int64)
        depth = np.zeros(len(rows), np.int64)
        for t in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(ordered, -t))  # queries longer than t
            at = first[rows[:m] + 1] - 1 - t
            token = queries[at]
            todo = np.arange(m)
            full = todo[depth[:m] == self.depth]
            self._shrink(full, low, high, depth)
            lost = token < 0
            low[:m][lost], high[:m][lost], depth[:m][lost] = 0, n, 0
            todo = todo[~lost]
            while len(todo):
                a, b = self.extend(low[todo], high[todo], token[todo])
                good = b > a
                done = todo[good]
                low[done], high[done] = a[good], b[good]
                depth[done] += 1
                todo = todo[~good]
                todo = todo[depth[todo] > 0]  # a token that occurs is found from depth 0
                self._shrink(todo, low, high, depth)
            yield at, depth[:m].copy(), low[:m].copy(), high[:m].copy()

    def _shrink(self, rows, low, high, depth) -> None:
        """Drop the last token of the patterns of ``rows``."""
        for d in np.unique(depth[rows]):
            some = rows[depth[rows] == d]
            lows, highs = self.widen(int(d) - 1)
            low[some], high[some] = lows[low[some]], highs[low[some]]
            depth[some] -= 1


# ----------------------------------------------------------------------------- routes and segments


def routes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The route of each window, and the grams (with repeats) that are the route of some window."""
    gram = min(GRAM, window)
    grams = gram_hashes(words, gram)
    width = window - gram + 1
    least = sliding(grams, width)
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return least, grams[most == grams]


def _route_counts(window: int):
    def run(batches):
        for batch in batches:
            found = []
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                words = texts.hashes()
                for a, b in zip(texts.first[:-1], texts.first[1:], strict=True):
                    if b - a >= window:
                        found.append(routes(words[a:b], window)[1])
            if found:
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["route", "times"])

    return run


def _route_places(window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                words = texts.hashes()
                found, rows = [], []
                for i, (a, b) in enumerate(zip(texts.first[:-1], texts.first[1:], strict=True)):
                    if b - a >= window:
                        found.append(np.unique(routes(words[a:b], window)[0]))
                        rows.append(np.full(len(found[-1]), i))
                if found:
                    ids = part.column("id").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), ids], names=["route", "id"])

    return run


def _segments(window: int, text_col: str):
    """Rows (route, id, digest, start, stop, segment): the segments on repeated routes, and with
    a null segment the spans that are repeats within the batch."""

    def run(batches):
        for batch in batches:
            kept: dict[bytes, tuple] = {}
            ties: list[tuple] = []
            spans: list[tuple] = []
            batch = batch.append_column("_sd_text", batch.column("_sd_row").field(text_col))
            for part in slices(batch, "_sd_text"):
                texts = Texts(part.column("_sd_text"))
                words = texts.hashes()
                ids = part.column("_sd_id").to_pylist()
                digests = part.column("_sd_digest").to_pylist()
                known = part.column("routes").to_pylist()
                copies = part.column("copies").to_pylist()
                for i, (a, b) in enumerate(zip(texts.first[:-1], texts.first[1:], strict=True)):
                    if b - a < window or digests[i] in (copies[i] or ()):
                        continue
                    route, _ = routes(words[a:b], window)
                    repeated = np.array([x["route"] for x in known[i]], np.int64).view(np.uint64)
                    hot = np.array([x["hot"] for x in known[i]], bool)
                    order = np.argsort(repeated)
                    repeated, hot = repeated[order], hot[order]
                    where = np.minimum(np.searchsorted(repeated, route), len(repeated) - 1)
                    hit = repeated[where] == route
                    cut = np.flatnonzero((route[1:] != route[:-1]) | (hit[1:] != hit[:-1])) + 1
                    lows = np.concatenate([[0], cut])
                    highs = np.append(cut, len(route))
                    whole = None
                    for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                        if not hit[low]:
                            continue
                        if hot[where[low]]:
                            if whole is None:
                                whole = gram_hashes(words[a:b], window).view(np.int64)
                            pieces = [(x, x + window, int(whole[x])) for x in range(low, high)]
                        else:
                            key = int(route[low].view(np.int64))
                            pieces = [(x, min(x + SEGMENT, high) + window - 1, key) for x in range(low, high, SEGMENT)]
                        for start, stop, key in pieces:
                            text = texts.span(a + start, a + stop)
                            row = (key, ids[i], digests[i], start, stop)
                            old = kept.get(text)
                            if old is None or row[1] < old[1] or row[1] == old[1] and start < old[3]:
                                kept[text] = row
                                row = old
                            elif row[1] == old[1] and start == old[3]:
                                ties.append((*row, text))
                                row = None
                            if row is not None:
                                spans.append(row)
            rows = [(*v, k) for k, v in kept.items()] + ties + [(*r, None) for r in spans]
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _SEGMENT_TYPES, strict=True)], names=_SEGMENT_NAMES
                )

    return run


_SEGMENT_NAMES = ["route", "id", "digest", "start", "stop", "segment"]
_SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_SEGMENT_DDL = "route long, id long, digest long, start int, stop int, segment binary"


def repeats(segments: list[bytes], order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words (segment, from, to) covered by windows that also start earlier.

    ``segments`` are distinct texts; ``order[i]`` ranks the place where segment ``i`` starts, and
    a window ``j`` words further on has rank ``order[i] + j``.
    """
    texts = Texts(pa.array(segments, pa.large_binary()).cast(pa.large_string()))
    words = np.unique(texts.hashes(), return_inverse=True)[1] + 1
    lengths = np.diff(texts.first)
    n = len(segments)
    # each sequence is followed by the token 0
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    tokens = np.zeros(first[-1], np.int64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(n), lengths)] = words
    index = FMIndex(tokens, window)
    place = np.arange(len(tokens)) - np.repeat(first[:-1], lengths + 1) + np.repeat(order, lengths + 1)
    earliest = np.minimum.reduceat(place[index.order], index.block)
    flags = np.zeros(len(tokens) + 1, bool)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    shift = np.repeat(np.arange(n), lengths)  # from a position in ``words`` to one in ``tokens``
    for at, depth, low, _high in index.search(words, begin):
        hit = depth == window
        at = at[hit] + shift[at[hit]]
        flags[at] = earliest[index.block_of[low[hit]]] < place[at]
    edges = np.diff(np.concatenate([[False], flags]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    which = np.searchsorted(first, begins, side="right") - 1
    return which, begins - first[which], ends - first[which] + window - 1


def _shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        passed = table.filter(pa.compute.is_null(table.column("segment")))
        table = table.filter(pa.compute.is_valid(table.column("segment")))
        out = [passed.select(["id", "digest", "start", "stop"])]
        if table.num_rows:
            coded = table.column("segment").combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy()
            ids = table.column("id").to_numpy()
            start = table.column("start").to_numpy()
            stop = table.column("stop").to_numpy()
            rank = (np.unique(ids, return_inverse=True)[1].astype(np.int64) << 32) + start
            least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(least, code, rank)
            which, low, high = repeats(coded.dictionary.to_pylist(), least, window)
            is_first = rank == least[code]
            later = np.flatnonzero(~is_first)  # each window of theirs starts earlier elsewhere
            firsts = np.flatnonzero(is_first)
            begin = np.searchsorted(which, code[firsts], side="left")
            count = np.searchsorted(which, code[firsts], side="right") - begin
            row = np.repeat(firsts, count)
            span = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            rows = np.concatenate([later, row])
            picked = table.select(["id", "digest"]).take(pa.array(rows))
            out.append(
                picked.append_column("start", pa.array(np.concatenate([start[later], start[row] + low[span]]).astype(np.int32)))
                .append_column("stop", pa.array(np.concatenate([stop[later], start[row] + high[span]]).astype(np.int32)))
            )
        return pa.concat_tables([x.cast(_SPAN_SCHEMA) for x in out])

    return run


_SPAN_SCHEMA = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


# ----------------------------------------------------------------------------- the operator


def _rank(column: str) -> Column:
    """The id as a rank; a null sorts first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_removed`` (long) and ``kept_text``: the words not
    covered by an earlier window, joined by one space.  See the module for the rules.

    Whole rows travel as one struct next to their id, so the two joins that need the texts share
    one exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(_rank(id_col).alias("id"), text.alias("text"))
    counts = plain.select("text").mapInArrow(_route_counts(window), "route long, times long")
    repeated = checkpoint(counts.groupBy("route").agg(F.sum("times").alias("times")).where("times > 1"))
    total = repeated.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    places = plain.mapInArrow(_route_places(window), "route long, id long")
    known = (
        places.join(repeated, "route")
        .groupBy(F.col("id").alias("_sd_id"))
        .agg(F.collect_set(F.struct("route", (F.col("times") > HOT).alias("hot"))).alias("routes"))
    )
    hashed = plain.select("id", F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("whole"))
    firsts = hashed.groupBy("whole").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copied = hashed.join(firsts.select("whole", "least"), "whole").where("id > least")
    copies = copied.groupBy(F.col("id").alias("_sd_id")).agg(F.collect_set("digest").alias("copies"))

    keyed = docs.select(F.struct("*").alias("_sd_row"), _rank(id_col).alias("_sd_id"), F.xxhash64(text).alias("_sd_digest"))
    dealt = (
        keyed.join(known, "_sd_id")
        .join(copies, "_sd_id", "left")
        .mapInArrow(_segments(window, text_col), _SEGMENT_DDL)
        # spans that are certain already pass through; they are spread by their document
        .withColumn("dealt", F.when(F.col("segment").isNull(), F.xxhash64("id", "digest")).otherwise(F.col("route")))
        .select(F.pmod("dealt", F.lit(shards)).alias("shard"), "id", "digest", "start", "stop", "segment")
    )
    spans = dealt.groupBy("shard").applyInArrow(_shard(window), "id long, digest long, start int, stop int")
    removed = spans.groupBy(F.col("id").alias("_sd_id")).agg(
        F.collect_set(F.struct("digest", "start", "stop")).alias("_sd_spans")
    )

    def kept(batch):
        batch = batch.append_column("_sd_text", batch.column("_sd_row").field(text_col))
        for part in slices(batch, "_sd_text"):
            texts = Texts(part.column("_sd_text"))
            spans = part.column("_sd_spans").to_pylist()
            copies = part.column("copies").to_pylist()
            digests = part.column("_sd_digest").to_pylist()
            total, gone, out = [], [], []
            for i, (a, b) in enumerate(zip(texts.first[:-1], texts.first[1:], strict=True)):
                n = int(b - a)
                mask = np.zeros(n, bool)
                for s in spans[i] or ():
                    if s["digest"] == digests[i]:
                        mask[s["start"] : s["stop"]] = True
                if n >= window and digests[i] in (copies[i] or ()):
                    mask[:] = True  # equal to an earlier document
                words = texts.buf[texts.offs[i] : texts.offs[i + 1]].tobytes().split()  # at the same six separators
                if mask.any():
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                total.append(n)
                gone.append(int(mask.sum()))
                out.append(b" ".join(words).decode())
            yield part, (total, gone, out)

    joined = keyed.join(removed, "_sd_id", "left").join(copies, "_sd_id", "left")
    added = ["n_words", "n_removed", "kept_text"]
    out = add_columns(
        joined, "n_words long, n_removed long, kept_text string", kept, drop=("_sd_id", "_sd_digest", "_sd_spans", "copies")
    )
    names = [c for c in docs.columns if c.lower() not in added]
    return out.select(*[F.col("_sd_row").getField(c).alias(c) for c in names], *added)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: words, words removed, digest of the kept words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, CAST(w[i:i + 19] AS VARCHAR[]) AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) r
), f AS (
  SELECT win, min((doc_id, i)) AS least FROM s GROUP BY win
), r AS (
  SELECT s.doc_id, s.i FROM s JOIN f ON s.win = f.win WHERE (s.doc_id, s.i) <> f.least
), c AS (
  SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 20)) AS j) o
), x AS (
  SELECT d.doc_id, u.p, u.word
  FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p) u
), k AS (
  SELECT x.doc_id, count(*) AS n_kept, string_agg(x.word, ' ' ORDER BY x.p) AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p
  WHERE c.p IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
