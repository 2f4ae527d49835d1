"""Phrase collocation mining: the highest-scoring phrases of 2 to ``longest`` words of each language.

Texts are lower-cased from A to Z only and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words
``[^\\x20\\x09]+``.  Within a language (null: ``und``) n counts words, f(phrase) its occurrences within pieces,
overlaps included.  A candidate has a = f >= ``least``; cut after its first k words it scores
``1000 * a * n div (l * r)`` with l and r the counts of both parts; the lowest-scoring cut counts (ties:
smallest k).  A candidate inside a longer candidate that is as frequent is dropped.

Method: best-first branch-and-bound growth.  A phrase is grown word by word from its first word.  As
a <= r, no extension of a prefix P scores over ``1000 * n div f(P)``, and a count never rises
as a phrase grows, so the bound of a branch is that of its first word, the rarer the better.  The frontier is
expanded in bands of first words, best bounds first; each band is grown a word at a time, and only
below prefixes that reach ``least``.  After each band the ``top``-th score of the survivors bounds what
is left: prefixes with a lower bound are not expanded (equal ones are), and the search ends when
none remain.

A parent phrase q of p that is as frequent implies one that is a single word longer, so p is dropped if all
its occurrences have the same word before them, or the same after them.

Words that occur less than ``least`` times can be in no candidate: after the words are counted,
the corpus is written once more as arrays of 64-bit word hashes (language included), where other words and
the ends of pieces are 0.  Counts are added up within a task before they are shuffled.  Which prefixes to grow is
sent to the workers as a bitmap of 2 ** ``FILTER_BITS`` bits, whatever the number of prefixes; phrases that pass
by chance are removed by the join with the frontier.  Phrases are told apart by 64-bit hashes.

A null text is empty; rows need no id, and repeated rows count repeatedly.  An empty table has no phrases.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpv.llm.common import _LOWER, checkpoint, mix, read_table, slices, span_hashes

LEAST, TOP, LONGEST = 100, 2000, 5
#: The first band takes words up to this many times ``least``; each further one reaches as many times further.
BAND = 16
FILTER_BITS = 26
#: Distinct words or phrases that a worker adds up before it passes them on, and bytes of words.
HELD, HELD_BYTES = 200_000, 1 << 25
#: Positions that are sorted at once.
BLOCK = 1 << 20

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def fold(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its prefix and its last word."""
    return mix(prefix * _FOLD + word)


class Pieces:
    """The words of some texts: byte spans in ``buf``, hashes with the language, and where a piece begins."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        buffers = texts.buffers()
        offs = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.buf = _LOWER[data[offs[0] : offs[-1]]]
        offs = offs - offs[0]
        inside = np.zeros(len(self.buf) + 2, dtype=bool)
        inside[1:-1] = ~_BETWEEN[self.buf]
        # a text's first byte starts a word even if the text before ends in one
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.buf))]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        cut = edges[inside[edges + 1] & inside[edges]]
        if len(cut):
            cut = np.unique(cut)
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        self.starts, self.ends = starts, ends
        self.row = np.searchsorted(offs, starts, side="right") - 1
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.buf])])
        self.fresh = np.ones(len(starts), dtype=bool)
        self.fresh[1:] = (breaks[starts[1:]] != breaks[ends[:-1]]) | (self.row[1:] != self.row[:-1])
        coded = langs.fill_null("und").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[self.row]
        hashes = mix(span_hashes(self.buf, starts, ends) ^ np.array(seeds, np.uint64)[self.lang]) if len(starts) else np.zeros(0, np.uint64)
        self.hashes = np.where(hashes == 0, np.uint64(1), hashes)

    def word(self, i: int) -> str:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode()


def _count_words(batches):
    """Rows (lang, word, h, c): words with their counts, added up over what the worker holds."""
    counts: dict[int, int] = {}
    words: dict[int, tuple[str, str]] = {}
    size = 0

    def out():
        keys = list(counts)
        columns = [[words[k][0] for k in keys], [words[k][1] for k in keys], np.array(keys, np.uint64).view(np.int64), list(counts.values())]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["lang", "word", "h", "c"])

    for batch in batches:
        for part in slices(batch, "text"):
            p = Pieces(part.column("text"), part.column("lang"))
            found, first, times = np.unique(p.hashes, return_index=True, return_counts=True)
            for h, i, c in zip(found.tolist(), first.tolist(), times.tolist(), strict=True):
                if h in counts:
                    counts[h] += c
                else:
                    counts[h] = c
                    words[h] = p.langs[p.lang[i]], (w := p.word(i))
                    size += len(w)
            if len(counts) > HELD or size > HELD_BYTES:
                yield out()
                counts.clear()
                words.clear()
                size = 0
    if counts:
        yield out()


class Bitmap:
    """A fixed-size set of 64-bit hashes that may hold others by chance."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.shift = np.uint64(64 - 6 - (len(slots) - 1).bit_length())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.slots[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bitmap(rows: DataFrame, bits: int = FILTER_BITS) -> Bitmap:
    """The bitmap of column ``h``; the driver gets at most ``2 ** (bits - 6)`` rows."""
    at = f"shiftrightunsigned(h, {64 - bits})"
    packed = rows.selectExpr(f"shiftright({at}, 6) AS slot", f"shiftleft(1L, CAST({at} & 63 AS INT)) AS bit")
    packed = packed.groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    slots = np.zeros(1 << (bits - 6), np.uint64)
    slots[packed.column("slot").to_numpy()] = packed.column("bit").to_numpy().view(np.uint64)
    return Bitmap(slots)


def _encode(known):
    """Rows (seq): the hashes of a text's frequent words; 0 for all others, between pieces and at the end."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = Pieces(part.column("text"), part.column("lang"))
                kept = known.value.has(p.hashes) if len(p.hashes) else np.zeros(0, bool)
                # a word not kept is a break before the next one; breaks in a row count once
                apart = p.fresh.copy()
                apart[1:] |= ~kept[:-1]
                at = np.flatnonzero(kept)
                if not len(at):
                    continue
                # a word alone between breaks is in no phrase
                last = np.append(apart[at[1:]] | (at[1:] != at[:-1] + 1), True)
                first = np.append(True, last[:-1])
                some = ~(first & last)
                at, first = at[some], first[some]
                if not len(at):
                    continue
                row = p.row[at]
                where = np.arange(len(at)) + np.cumsum(first)
                values = np.zeros(where[-1] + 2, np.uint64)
                values[where] = p.hashes[at]
                begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                offsets = np.append(where[begins] - 1, len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))], names=["seq"]
                )

    return run


def _sequences(batches) -> Iterator[np.ndarray]:
    """The encoded corpus in blocks; each begins and ends with 0."""
    for batch in batches:
        column = batch.column("seq")
        sizes = np.asarray(column.value_lengths())
        total = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + BLOCK, side="right")))
            yield np.append(column.slice(at, to - at).flatten().to_numpy().view(np.uint64), np.uint64(0))
            at = to


def _grow(frontier, size: int):
    """Rows (h, prefix, word, c): phrases of ``size`` words below the prefixes of the frontier."""

    def run(batches):
        for w in _sequences(batches):
            at = np.flatnonzero(w)
            at = at[frontier.value.has(w[at])]
            g = w[at]
            for j in range(1, size - 1):
                more = w[at + j]
                g = fold(g, more)
                ok = more != 0
                ok[ok] = frontier.value.has(g[ok])
                at, g = at[ok], g[ok]
            more = w[at + size - 1]
            g, more = g[more != 0], more[more != 0]
            if not len(g):
                continue
            h, first, c = np.unique(fold(g, more), return_index=True, return_counts=True)
            arrays = [pa.array(x.view(np.int64)) for x in (h, g[first], more[first])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(c.astype(np.int64))], names=["h", "prefix", "word", "c"])

    return run


def _neighbours(wanted, longest: int):
    """Rows (h, c, before_min, before_max, after_min, after_max): wanted phrases of 2 to ``longest - 1`` words,
    counted, with the least and greatest hash of the word before and after them (0: none)."""
    names = ["h", "c", "before_min", "before_max", "after_min", "after_max"]

    def run(batches):
        for w in _sequences(batches):
            at = np.flatnonzero(w)
            g = w[at]
            for size in range(2, longest):
                more = w[at + size - 1]
                ok = more != 0
                at, g = at[ok], fold(g[ok], more[ok])
                hit = wanted.value.has(g)
                here, found = at[hit], g[hit]
                if not len(here):
                    continue
                order = np.argsort(found, kind="stable")
                here, found = here[order], found[order]
                starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                before, after = w[here - 1].view(np.int64), w[here + size].view(np.int64)
                columns = [found[starts].view(np.int64), np.diff(np.append(starts, len(found))).astype(np.int64)]
                columns += [f.reduceat(x, starts) for x in (before, after) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return run


def _suffixes(batches):
    """Rows (h, k, l, rest) of each cut of a candidate: the first part's count and the hash of the rest."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for h, words, counts in zip(*(batch.column(c).to_pylist() for c in ("h", "words", "prefix_counts")), strict=True):
            w = np.array(words, np.int64).view(np.uint64)
            for k in range(1, len(w)):
                g = w[k : k + 1]
                for j in range(k + 1, len(w)):
                    g = fold(g, w[j : j + 1])
                out.append((h, k, counts[k - 1], int(g.view(np.int64)[0])))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "k", "l", "rest"])


def _first_of(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; a language is ranked in 64 parts first, of which
    ``top`` rows each go on."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("part", F.pmod("h", F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def _grown(corpus: DataFrame, band: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame | None:
    """The candidates that begin with the words of ``band``, grown a word at a time; None if there are none."""
    sc = corpus.sparkSession.sparkContext
    spelled = words.select(F.col("h").alias("word"), F.col("word").alias("spelling"))
    frontier, grown = band, []
    alive = band.select("h")
    for size in range(2, longest + 1):
        sent = sc.broadcast(bitmap(alive))
        counted = corpus.mapInArrow(_grow(sent, size), "h long, prefix long, word long, c long")
        counted = counted.groupBy("h", "prefix", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
        parents = frontier.select(
            F.col("h").alias("prefix"), "lang", "n", "words", F.col("phrase").alias("stem"), "prefix_counts", F.col("a").alias("stem_a")
        )
        found = counted.join(parents, "prefix").join(spelled, "word")
        found = found.select(
            "lang", "n", "h", F.concat_ws(" ", "stem", "spelling").alias("phrase"), F.array_append("words", F.col("word")).alias("words"),
            F.array_append("prefix_counts", F.col("stem_a")).alias("prefix_counts"), "a",
        )
        found = checkpoint(found)
        if found.isEmpty():
            break
        grown.append(found)
        frontier = found
        alive = alive.union(found.select("h"))
    out = None
    for found in grown:
        out = found if out is None else out.union(found)
    return out


def _scored(corpus: DataFrame, candidates: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """The candidates that survive, with l, r and score of their lowest cut."""
    cuts = candidates.select("h", "words", "prefix_counts").mapInArrow(_suffixes, "h long, k long, l long, rest long")
    short = candidates.where(F.size("words") < longest).select("h")
    wanted = corpus.sparkSession.sparkContext.broadcast(bitmap(short.union(cuts.select("rest"))))
    fields = "h long, c long, before_min long, before_max long, after_min long, after_max long"
    seen = corpus.mapInArrow(_neighbours(wanted, longest), fields)
    ends = [F.min(f"{x}_min").alias(f"{x}_min") for x in ("before", "after")] + [F.max(f"{x}_max").alias(f"{x}_max") for x in ("before", "after")]
    seen = checkpoint(seen.groupBy("h").agg(F.sum("c").alias("c"), *ends))
    counts = words.select(F.col("h").alias("rest"), F.col("a").alias("r")).union(seen.select("h", "c"))
    one = lambda x: (F.col(f"{x}_min") == F.col(f"{x}_max")) & (F.col(f"{x}_min") != 0)
    gone = seen.where(one("before") | one("after")).select("h")
    # a phrase of the full length is inside no longer candidate
    kept = candidates.join(gone, "h", "left_anti").unionByName(candidates.where(F.size("words") == longest).join(gone, "h", "left_semi"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scores = kept.select("lang", "n", "h", "phrase", "a").join(cuts, "h").join(counts, "rest")
    scores = scores.withColumn("_above", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).withColumn("_below", wide("l") * wide("r"))
    scores = scores.withColumn("score", F.expr("_above div _below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scores.groupBy("lang", "n", "h", "phrase", "a").agg(lowest).select("lang", "n", "h", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, longest: int = LONGEST, band: int = BAND
) -> DataFrame:
    """The first ``top`` phrases of each language by score and count descending, then phrase ascending (UTF-8
    bytes): lang, rank (from 1), phrase, a, l, r, n, score.  ``longest`` is 2 or more.

    The encoded corpus is written to the folder that ``spark.checkpoint.dir`` names.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more, and occur once or more")
    spark = docs.sparkSession
    sc = spark.sparkContext
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    counted = plain.mapInArrow(_count_words, "lang string, word string, h long, c long")
    counted = checkpoint(counted.groupBy("lang", "word", "h").agg(F.sum("c").alias("a")))
    totals = checkpoint(counted.groupBy("lang").agg(F.sum("a").alias("n"), F.max("a").alias("most")))
    words = checkpoint(counted.where(F.col("a") >= least))

    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or sc.getCheckpointDir()).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    plain.mapInArrow(_encode(sc.broadcast(bitmap(words))), "seq array<long>").write.parquet(folder)
    corpus = spark.read.schema("seq array<long>").parquet(folder)

    survivors = spark.createDataFrame([], "lang string, n long, h long, phrase string, a long, l long, r long, score long")
    # prefixes that occur at most ``reached`` times are expanded; those beyond ``limit`` need not be
    state = totals.select("lang", "n", "most", F.lit(0).cast("long").alias("reached"), F.col("most").alias("limit"))
    step = least * band
    while not (open_langs := state.where("reached < limit")).isEmpty():
        reach = F.least("limit", F.greatest(F.lit(step), F.col("reached")))
        bounds = open_langs.select("lang", "n", "reached", reach.alias("reach"))
        firsts = words.join(bounds, "lang").where("a > reached AND a <= reach")
        firsts = checkpoint(
            firsts.select(
                "lang", "n", "h", F.col("word").alias("phrase"), F.array("h").alias("words"), F.array().cast("array<long>").alias("prefix_counts"), "a"
            )
        )
        settled = None
        if not firsts.isEmpty() and (candidates := _grown(corpus, firsts, words, least, longest)) is not None:
            survivors = checkpoint(survivors.unionByName(_scored(corpus, candidates, words, longest)))
            settled = _first_of(survivors, top).where(F.col("rank") == top).select("lang", F.col("score").alias("least_score"))
        state = state.withColumn("reached", F.greatest("reached", F.least("limit", F.lit(step))))
        if settled is not None:
            # a prefix is worth expanding while 1000 n div f >= the score of the last one: f <= 1000 n / score
            still = F.expr("CAST(CAST(n AS DECIMAL(19,0)) * 1000 div least_score AS BIGINT)")
            state = state.join(settled, "lang", "left").withColumn("limit", F.coalesce(F.least("limit", still), "limit")).drop("least_score")
        state = checkpoint(state)
        step *= band
    out = _first_of(survivors, top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents``."""
    return mine(read_table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0
), t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)] for m in range(1, 6)])) AS g FROM w
), f AS MATERIALIZED (
  SELECT lang, g, string_split(g, ' ') AS s, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100
), c AS (
  SELECT f.lang, f.g, f.f AS a, f.s, unnest(range(1, len(f.s))) AS k FROM f WHERE len(f.s) > 1
), x AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, t.n, 1000 * c.a * t.n // (l.f * r.f) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.s[1:c.k], ' ')
         JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.s[c.k + 1:], ' ')
         JOIN t ON t.lang = c.lang
), best AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, f, unnest([[array_to_string(s[i:i + m - 1], ' ') for i in range(1, len(s) - m + 2)] for m in range(2, len(s))]) AS inner_ FROM f WHERE len(s) > 2
), gone AS (
  SELECT DISTINCT f.lang, f.g FROM (SELECT lang, f, unnest(inner_) AS g FROM longer) q JOIN f ON f.lang = q.lang AND f.g = q.g AND q.f >= f.f
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN gone USING (lang, g) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) <= 2000
"""
