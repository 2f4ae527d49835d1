"""Toxicity: maximum-scoring segments over token log-odds.

Method.  (1) Token weights are log-odds ratios between toxic and other labelled documents with an
informative Dirichlet prior (the token's own counts times ``PRIOR``); tokens count once
per distinct document, and only weights beyond ``MIN_Z`` standard errors are used.  A word that has
no weight takes that of its first ``STEM`` characters, which are tokens too; all others
score ``DEFAULT``.  (2) A linear-time scan finds every maximal-scoring segment of a document.
(3) Extreme-value calibration: the decay rate solves ``sum p * exp(rate * score) = 1`` over
the scores of the other documents' tokens and the scale factor follows from their best segments;
a segment of score S in m tokens has the E-value ``scale * m * exp(-rate * S)``.  (4) The joint
significance of a document's best segments (the sum statistic of extreme values) and the share
of tokens in significant segments go through a logistic fit.

The classifier is fitted on a bounded sample: the ``TRAIN`` training rows whose ids have the least
hash, which are few enough to be picked by a broadcast join.  The model keeps every weight beyond ``MIN_Z``
(so only the sample bounds it), and the calibration uses ``SAMPLE`` of the sample.  Scoring covers all rows.
Labels, language, source and id are never inputs of a score.  A null or empty text has no tokens and
scores as a document without findings.  Labels that repeat an id count as toxic if one is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import add_columns, checkpoint, read_table, slices

PRIOR = 0.05
MIN_Z = 2.5
STEM = 4
DEFAULT = -0.25
CLIP = (-1.0, 6.0)
TRAIN = 30_000
SAMPLE = 10_000
#: Tasks that score the sample.
SAMPLE_PARTS = 32
SIGNIFICANT = 0.01
MEMO = 500_000
TOKEN = r"\w+"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _features(word: str) -> tuple[str, str]:
    word = word.lower()
    return word, "^" + word[:STEM]


def _count(batches):
    """Per batch: token, documents that are toxic, others, and occurrences in the others."""
    find = re.compile(TOKEN).findall
    for batch in batches:
        toxic, other, times = Counter(), Counter(), Counter()
        documents = [0, 0]
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = Counter(find(text or ""))
            features: Counter = Counter()
            for word, n in words.items():
                for f in set(_features(word)):
                    features[f] += n
            (toxic if label else other).update(features.keys())
            documents[0 if label else 1] += 1
            if not label:
                times.update(features)
        tokens = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*tokens, ""], pa.string()),
                pa.array([*(toxic[t] for t in tokens), documents[0]], pa.int64()),
                pa.array([*(other[t] for t in tokens), documents[1]], pa.int64()),
                pa.array([*(times[t] for t in tokens), 0], pa.int64()),
            ],
            names=["token", "toxic", "other", "times"],
        )


def token_weights(rows: DataFrame) -> tuple[dict[str, float], dict[str, int], int]:
    """Weights, occurrences in the other documents, and all occurrences there, of ``rows`` (text, toxic)."""
    counts = (
        rows.mapInArrow(_count, "token string, toxic long, other long, times long")
        .groupBy("token")
        .agg(*[F.sum(c).alias(c) for c in ("toxic", "other", "times")])
    )
    counts = counts.where("token = '' OR toxic + other > 1")
    sums = counts.agg(
        *[F.sum(F.when(F.col("token") != "", F.col(c)).otherwise(0)).alias(c) for c in ("toxic", "other")],
        F.sum(F.when(~F.col("token").startswith("^"), F.col("times")).otherwise(0)).alias("times"),
    )
    y1, y0 = F.col("toxic").cast("double"), F.col("other").cast("double")
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    prior = F.lit(PRIOR) * (y1 + y0)
    odds = lambda y, n: F.log((y + prior) / (n + F.lit(PRIOR) * (n1 + n0) - y - prior))
    scored = (
        counts.where("token <> ''")
        .crossJoin(F.broadcast(sums.selectExpr("toxic AS n1", "other AS n0", "times AS total")))  # one row
        .withColumn("weight", odds(y1, n1) - odds(y0, n0))
        .withColumn("z", F.col("weight") / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)))
        .where(F.abs("z") >= MIN_Z)
    )
    top = sorted(scored.select("token", "weight", "times", "total").collect())  # of the bounded sample
    weights = {r["token"]: min(max(r["weight"], CLIP[0]), CLIP[1]) for r in top}
    return weights, {r["token"]: r["times"] for r in top}, top[0]["total"] if top else 0


def decay_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive rate at which ``sum(shares * exp(rate * scores))`` is 1."""
    if not len(scores) or scores.max() <= 0 or float(scores @ shares) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float(shares @ np.exp(x * scores)) - 1
    while f(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), found in linear time.

    Candidates keep the running total before and after them, and each one points to the nearest
    earlier candidate whose total before it is less, so the search back skips what cannot join.
    """
    totals = np.cumsum(scores)
    found: list[tuple[int, int, float, float, int]] = []  # first, end, before, after, pointer
    for i in np.flatnonzero(scores > 0).tolist():
        first, before, after = i, float(totals[i] - scores[i]), float(totals[i])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= before:
                at = found[at][4]
            if at < 0 or found[at][3] >= after:
                found.append((first, i + 1, before, after, at))
                break
            first, before = found[at][0], found[at][2]
            pointer = found[at][4]
            del found[at:]
            at = pointer
    return [(a, b, after - before) for a, b, before, after, _ in found]


class Scorer:
    """Finds significant segments with token weights and a calibration; ``state`` is what tasks need."""

    def __init__(self, weights: dict[str, float], rate: float = 1.0, scale: float = 1.0, fit: tuple = (0.0, 1.0, 0.0)):
        self.weights, self.rate, self.scale, self.fit = weights, rate, scale, fit
        self.memo: dict[str, float] = {}
        self.pattern = re.compile(TOKEN)

    @property
    def state(self) -> tuple:
        return self.weights, self.rate, self.scale, self.fit

    def _score(self, word: str) -> float:
        whole, stem = _features(word)
        own = self.weights.get(whole)
        return own if own is not None else self.weights.get(stem, DEFAULT)

    def tokens(self, text: str) -> np.ndarray:
        words = self.pattern.findall(text)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self._score(w)
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def evidence(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float]]]:
        """-ln of the joint significance of the segments, the share of tokens in significant
        segments, and those segments as (first token, end token, E-value).

        The joint significance is that of the sum of the ``r`` best normalised scores, for the best
        ``r``: exp(-T) * T^(r-1) / (r! (r-1)!).
        """
        scores = self.tokens(text or "")
        m = max(len(scores), 1)
        base = math.log(self.scale * m)
        normal, inside, out = [], 0, []
        for a, b, score in segments(scores):
            normal.append(self.rate * score - base)
            if normal[-1] >= -math.log(SIGNIFICANT):
                inside += b - a
                out.append((a, b, math.exp(-normal[-1])))
        normal.sort(reverse=True)
        strength, total = normal[0] if normal else -base, 0.0
        for r, value in enumerate(normal, 1):
            total += value
            if total < r:
                break
            strength = max(strength, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return strength, inside / m, out

    def probability(self, strength: float, share: float) -> float:
        x = self.fit[0] + self.fit[1] * max(min(strength, 50.0), -20.0) + self.fit[2] * share
        return 1 / (1 + math.exp(-max(min(x, 30.0), -30.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Coefficients (constant first) by Newton steps with a ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(rows: DataFrame) -> tuple[Scorer, DataFrame]:
    """A scorer without its logistic fit from labelled ``rows`` (doc_id, text, toxic), and the rows
    for that fit.  Equal texts count once."""
    rows = rows.where("toxic IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = rows.withColumn("whole", F.sha2("text", 256))
    firsts = rows.groupBy("whole").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(firsts.select("doc_id").distinct(), "doc_id", "left_semi")
    weights, times, total = token_weights(rows.select("text", "toxic"))
    own = [t for t in weights if not t.startswith("^")]
    scores = np.array([weights[t] for t in own] + [DEFAULT])
    share = np.array([times[t] + 0.5 for t in own])
    share = np.append(share, max(total - share.sum(), 1.0)) / max(total, share.sum() + 1.0)
    rate = decay_rate(scores, share)

    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def best(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            found = []
            for text in batch.column("text").to_pylist():
                tokens = scorer.tokens(text)
                found.append((max((s for _, _, s in segments(tokens)), default=0.0), len(tokens)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array(labels, pa.int32())],
                names=["best", "n", "toxic"],
            )

    # ids and digests are ordered and cut; the texts come by a join and stay in many partitions
    picked = rows.select("doc_id", "whole").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "whole").limit(SAMPLE)
    sample = rows.join(F.broadcast(picked), ["doc_id", "whole"], "left_semi").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = checkpoint(sample.repartition(SAMPLE_PARTS))
    points = sorted(sample.mapInArrow(best, "best double, n long, toxic int").collect())
    clean = [(r["best"], max(r["n"], 1)) for r in points if not r["toxic"] and r["best"] > 0]
    scale = 1.0
    if clean:
        # the mean of a Gumbel variable is its location and Euler's constant
        scale = math.exp(np.mean([rate * s - math.log(m) for s, m in clean]) - 0.5772156649)
        scale = min(max(scale, 1e-6), 1.0)
    scorer = Scorer(weights, rate, scale)
    return scorer, sample


def fitted(rows: DataFrame) -> Scorer:
    """``train`` and the logistic fit on the sample."""
    scorer, sample = train(rows)
    sent = sample.sparkSession.sparkContext.broadcast(scorer.state)

    def points(batches):
        own = Scorer(*sent.value)
        for batch in batches:
            found = [own.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column("toxic")],
                names=["strength", "share", "toxic"],
            )

    got = sorted(sample.mapInArrow(points, "strength double, share double, toxic int").collect())
    y = np.array([r["toxic"] for r in got], float)
    if 0 < y.sum() < len(y):
        x = np.array([[max(min(r["strength"], 50.0), -20.0), r["share"]] for r in got])
        scorer.fit = logistic(x, y)
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages``: the significant segments as character
    spans of the text with their E-values."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer.state)
    own: list[Scorer] = []

    def run(batch):
        if not own:
            own.append(Scorer(*sent.value))
        scorer = own[0]
        for part in slices(batch, text_col):
            scores, passages = [], []
            for text in part.column(text_col).to_pylist():
                strength, share, found = scorer.evidence(text)
                scores.append(scorer.probability(strength, share))
                if found:
                    at = [m.span() for m in scorer.pattern.finditer(text)]
                    found = [{"start": at[a][0], "end": at[b - 1][1], "e_value": e} for a, b, e in found]
                passages.append(found)
            yield part, (scores, passages)

    return add_columns(docs, "score double, passages array<struct<start:int,end:int,e_value:double>>", run)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN) -> DataFrame:
    """At most ``limit`` labelled documents that are not held out."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return checkpoint(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))  # at most `limit` ids are sent


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fitted(training_rows(docs, read_table(spark, sf_dir, "labels")))
    return score_documents(docs, scorer).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
