import hashlib
import random
import re

import numpy as np
import pytest

from gridpv.llm import substring_dedup as sd
from gridpv.llm.common import Texts
from edge import SCHEMA, edge_docs, edge_rows, empty_docs, with_clashes


def brute(rows, window):
    """(id, text) -> kept words, from all windows held in one dictionary."""
    split = [(-(2**63) if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or ""), i, t) for i, t in rows]
    first: dict = {}
    for key, words, _, _ in split:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, (key, s)), (key, s))
    out = []
    for key, words, i, t in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (key, s):
                gone.update(range(s, s + window))
        out.append((i, t, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=repr)


def test_edge_rows_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert result(sd.remove_repeats(with_clashes(edge_docs(spark)))) == brute(rows, 20)
    assert sd.remove_repeats(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("hot", [10**9, 3])
def test_random_copies_match_brute_force(spark, monkeypatch, hot):
    """Passages copied with edits; with a low limit most routes are dealt window by window."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD", 40)
    monkeypatch.setattr(sd, "SEGMENT", 7)
    rnd = random.Random(7)
    stock = [[f"w{rnd.randint(0, 30)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(stock)
            a = rnd.randint(0, 30)
            words += p[a : a + rnd.randint(5, 40)] + [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 6))]
        rows.append((rnd.randint(0, 10**6), " ".join(words)))
    rows.append((5, "z " * 90))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    assert result(sd.remove_repeats(docs, window=8)) == brute(rows, 8)


def test_matching_statistics_against_direct_search():
    rnd = np.random.default_rng(3)
    tokens = np.append(rnd.integers(1, 5, 400), 0)
    index = sd.FMIndex(tokens, 6)
    queries = rnd.integers(1, 6, 300)
    queries[queries == 5] = -1
    first = np.array([0, 120, 120, 300])
    text = tokens.tolist()
    grams = {tuple(text[i : i + n]) for n in range(1, 7) for i in range(len(text) - n + 1)}
    seen = 0
    for at, depth, low, high in index.search(queries, first):
        for p, d, a, b in zip(at.tolist(), depth.tolist(), low.tolist(), high.tolist(), strict=True):
            end = first[np.searchsorted(first, p, side="right")]
            best = 0
            while best < 6 and p + best < end and tuple(queries[p : p + best + 1].tolist()) in grams:
                best += 1
            assert d == best
            if d:
                places = [i for i in range(len(text)) if text[i : i + d] == queries[p : p + d].tolist()]
                assert sorted(index.order[a:b].tolist()) == places
            seen += 1
    assert seen == 300


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [r[1] for r in edge_rows()] + ["a\x0bb\x0cc\rd", " lead", "trail "]
    found = Texts(pa.array(texts))
    for i, t in enumerate(texts):
        words = [found.word(j).decode() for j in range(found.first[i], found.first[i + 1])]
        assert words == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_query_columns(spark, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in sd.op2_substring_dedup(spark, str(tmp_path)).collect()}
    want = brute([(r[0], r[1]) for r in edge_rows()], 20)
    assert got == {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, _, n, g, k in want}
