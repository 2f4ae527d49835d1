import random
import re
from collections import Counter

import numpy as np
import pytest
from edge import SCHEMA, edge_docs, edge_rows, empty_docs, with_clashes

from gridpv.llm import phrases as ph

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least, top, longest=5):
    """rows: (lang, text) -> sorted (lang, rank, phrase, a, l, r, n, score), by counting every phrase."""
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = (lang, words[i : i + m])
                if a >= candidates[inner]:
                    gone.add(inner)
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            n = total[lang]
            cuts = [(1000 * a * n // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            row = (" ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n, score)
            found.setdefault(lang, []).append(row)
    out = []
    for lang, held in found.items():
        held.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(held[:top], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string")
    return sorted(tuple(r) for r in ph.mine(docs, **more).collect())


def corpus(seed, docs=120, words=60):
    """Texts of words of very different frequency, with set phrases, ends of pieces and two languages."""
    rnd = random.Random(seed)
    stock = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    fixed = ["Ab cd ef", "w0 q1 q2 q3 q4 q5", "w1 Zz", "zz w1", "x x x x"]
    out = []
    for _ in range(docs):
        text = rnd.choices(stock, weights, k=words)
        for _ in range(4):
            text.insert(rnd.randrange(len(text)), rnd.choice(fixed))
        text = "".join(w + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in text)
        out.append((rnd.choice(["en", "en", "fr", None]), text))
    return out


@pytest.mark.parametrize(("seed", "least", "top", "band"), [(1, 5, 40, 2), (2, 3, 7, 2), (3, 8, 2000, 16), (4, 2, 25, 3)])
def test_matches_brute_force(spark, seed, least, top, band):
    rows = corpus(seed)
    assert mined(spark, rows, least=least, top=top, band=band) == brute(rows, least, top)


def test_bounds_close_the_search(spark, monkeypatch):
    """Frequent first words are never expanded once the scores of rarer ones are settled, and the result is whole."""
    rows = [("en", "rare one. " * 5), ("en", "odd two. " * 6)] + [("en", "the of the of and the. " * 300)]
    reached = []
    grown = ph._grown
    monkeypatch.setattr(ph, "_grown", lambda c, band, *a: reached.append(band.agg({"a": "max"}).first()[0]) or grown(c, band, *a))
    got = mined(spark, rows, least=5, top=2, band=2)
    assert got == brute(rows, 5, 2) and [r[2] for r in got] == ["rare one", "odd two"]
    assert max(reached) <= 10
    # with a third place to fill, the search goes on to the frequent ones
    assert mined(spark, rows, least=5, top=3, band=2) == brute(rows, 5, 3)


def test_ties_at_the_last_place_go_by_count_and_phrase(spark):
    rows = [("en", ". ".join(f"{a}a {a}b" for a in "dcbéaz") + ". ")] * 3
    got = mined(spark, rows, least=3, top=4)
    assert got == brute(rows, 3, 4) and [r[2] for r in got] == ["aa ab", "ba bb", "ca cb", "da db"]


def test_equally_frequent_longer_phrases_drop_the_shorter(spark):
    rows = [("en", "the united nations. the cat. the a b c d e f. ")] * 4
    got = mined(spark, rows, least=4, top=100)
    assert got == brute(rows, 4, 100)
    assert "united nations" not in {r[2] for r in got} and "the united nations" in {r[2] for r in got}


def test_two_word_phrases_only(spark):
    rows = corpus(5, docs=40)
    assert mined(spark, rows, least=4, top=50, longest=2) == brute(rows, 4, 50, longest=2)


def test_edge_rows_and_clashing_names(spark):
    rows = [(lang, text) for _, text, lang, _, _ in edge_rows()]
    got = sorted(tuple(r) for r in ph.mine(with_clashes(edge_docs(spark)), least=3, top=60).collect())
    assert got == brute(rows, 3, 60) and got


def test_empty_table_and_tables_without_phrases(spark):
    assert ph.mine(empty_docs(spark)).count() == 0
    assert mined(spark, [("en", None), (None, ""), ("en", "..,")], least=1) == []


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame([(t, x) for x, t in corpus(6, docs=60)], "text string, lang string")
    rows = [sorted(map(tuple, ph.mine(x, least=3, top=30).collect())) for x in (docs.coalesce(1), docs.repartition(11))]
    assert rows[0] == rows[1]


def test_scores_beyond_64_bits_are_exact(spark):
    """1000 a n and l r of some 1e22 and 1e20: the decimals of the score keep every digit."""
    a, n, left, right = 9_876_543_211, 1_234_567_890_123, 98_765_432_110, 9_876_543_219
    row = spark.sql(f"SELECT (CAST({a}L * 1000 AS DECIMAL(19,0)) * CAST({n}L AS DECIMAL(19,0))) div (CAST({left}L AS DECIMAL(19,0)) * CAST({right}L AS DECIMAL(19,0))) AS s")
    assert row.first()["s"] == 1000 * a * n // (left * right)


def test_bitmap_holds_all_of_its_hashes(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    held = ph.bitmap(spark.createDataFrame([(int(h),) for h in hashes], "h long"), bits=20)
    assert held.has(hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**64, 100_000, dtype=np.uint64)
    assert held.has(others).mean() < 0.02


def test_query_reads_documents(spark, tmp_path):
    rows = [(i, "Alpha beta, gamma. " * 30 if i % 3 else None, None if i % 2 else "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in ph.op11_phrases(spark, str(tmp_path)).collect())
    assert got == brute([(r[2], r[1]) for r in rows], 100, 2000) and {r[0] for r in got} == {"en", "und"}
