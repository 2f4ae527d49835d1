import random
import zlib

import numpy as np
from edge import SCHEMA, edge_docs, empty_docs, prose, with_clashes

from gridpv.llm import toxicity as tx


def quadratic(scores):
    """All maximal segments by their definition: the best one, then the same on both sides."""
    best, place = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, place = total, (a, b + 1)
    if place is None:
        return []
    a, b = place
    left = quadratic(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in quadratic(scores[b:])]
    return left + [(a, b, best)] + right


def test_linear_scan_finds_the_maximal_segments():
    rnd = random.Random(2)
    for _ in range(300):
        scores = np.array([rnd.choice([-3.1, -1.7, -0.3, 1.13, 2.71, 4.37]) * (1 + rnd.random() / 100) for _ in range(rnd.randint(0, 14))])
        got = [(a, b, round(s, 6)) for a, b, s in tx.segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in quadratic(scores.tolist())]


def test_decay_rate_solves_its_equation():
    scores, shares = np.array([3.0, -0.5]), np.array([0.05, 0.95])
    rate = tx.decay_rate(scores, shares)
    assert abs(float(shares @ np.exp(rate * scores)) - 1) < 1e-6


def corpus(spark):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        words = prose(i, rnd.randint(30, 200)).split()
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rnd.randint(3, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(["grumph", "SNARK!", "blorpest", "blorping", "zonked"])
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, SCHEMA),
        spark.createDataFrame(labels + [labels[0], (None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int"),
    )


def test_held_out_documents_are_told_apart(spark, tmp_path):
    docs, labels = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = tx.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 700
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    wrong = sum(r["predicted"] != int(r["doc_id"] % 7 == 0) for r in rows if r["held_out"])
    assert wrong <= 2
    scorer = tx.fitted(tx.training_rows(docs, labels))
    found = tx.score_documents(with_clashes(docs), scorer).where("size(passages) > 0").first()
    at = found["passages"][0]
    assert any(w in found["text"][at["start"] : at["end"]].lower() for w in ("grumph", "snark", "blorp", "zonk"))


def test_sample_is_spread_and_its_fit_does_not_depend_on_partitions(spark):
    docs, labels = corpus(spark)
    rows = tx.training_rows(docs, labels)
    scorer, sample = tx.train(rows)
    sizes = sample.rdd.glom().map(len).collect()
    assert len(sizes) == tx.SAMPLE_PARTS and max(sizes) <= 2 * -(-sum(sizes) // len(sizes))
    again, _ = tx.train(rows.repartition(5))
    assert again.state == scorer.state


def test_weights_match_plain_python(spark):
    docs, labels = corpus(spark)
    rows = tx.training_rows(docs, labels).select("text", "toxic")
    got, times, total = tx.token_weights(rows)
    counts: dict = {}
    for text, toxic in rows.collect():
        words = tx.re.findall(tx.TOKEN, text)
        for word in words:
            for token in {word.lower(), "^" + word.lower()[: tx.STEM]}:
                at = counts.setdefault(token, [set(), set(), 0])
                at[0 if toxic else 1].add(text)
                at[2] += 0 if toxic else 1
    assert len({r["text"] for r in rows.collect()}) == rows.count()
    counts = {t: (len(a), len(b), n) for t, (a, b, n) in counts.items() if len(a) + len(b) > 1}
    n1, n0 = (sum(c[i] for c in counts.values()) for i in (0, 1))
    want = {}
    for token, (y1, y0, _) in counts.items():
        prior = tx.PRIOR * (y1 + y0)
        odds = [np.log((y + prior) / (n + tx.PRIOR * (n1 + n0) - y - prior)) for y, n in ((y1, n1), (y0, n0))]
        if abs(odds[0] - odds[1]) / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)) >= tx.MIN_Z:
            want[token] = min(max(odds[0] - odds[1], tx.CLIP[0]), tx.CLIP[1])
    assert got.keys() == want.keys() and got
    assert all(abs(got[t] - w) < 1e-9 for t, w in want.items())
    assert times == {t: counts[t][2] for t in want}
    assert total == sum(n for t, (_, _, n) in counts.items() if not t.startswith("^"))


def test_edges(spark):
    docs, labels = corpus(spark)
    scorer = tx.fitted(tx.training_rows(docs, labels))
    rows = tx.score_documents(with_clashes(edge_docs(spark)), scorer).collect()
    assert len(rows) == 16 and all(r["score"] < 0.5 and r["passages"] == [] for r in rows)
    nothing = tx.fitted(tx.training_rows(empty_docs(spark), labels))
    assert tx.score_documents(empty_docs(spark), nothing).count() == 0
