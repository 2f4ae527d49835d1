import random
import re

import pyarrow as pa
import pytest

from gridpv.llm import minhash_dedup as md
from gridpv.llm.common import Texts
from edge import SCHEMA, edge_docs, edge_rows, empty_docs, prose, with_clashes


def sets(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, percent):
    key = lambda i: -(2**63) if i is None else i
    nodes = [(key(i), sets(t, k)) for i, t in rows]
    top = {i: i for i, _ in nodes}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, x) in enumerate(nodes):
        for j, y in nodes[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    null = lambda i: None if i == -(2**63) else i
    return sorted(((null(i), len(x), null(find(i)), find(i) == i) for i, x in nodes), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_edge_rows_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert result(md.mark_duplicates(with_clashes(edge_docs(spark)), k=3, percent=85)) == brute(rows, 3, 85)
    assert md.mark_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_chains_of_edits_match_brute_force(spark, k, percent):
    """Copies of a few texts with edits of all strengths, so that stars and the filter both matter."""
    rnd = random.Random(k)
    rows = []
    for g in range(6):
        base = prose(100 + g, 150).split()
        for _ in range(45):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 6, 8, 12, 20])):
                words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 10**6)}"
            words = words[: rnd.choice([150, 150, 140, 125])]
            rows.append((rnd.randint(0, 10**9), " ".join(words)))
            if rnd.random() < 0.3:  # an edit of an edit
                base = words + base[len(words) :]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    assert result(md.mark_duplicates(docs, k=k, percent=percent)) == brute(rows, k, percent)


def test_densification_fills_every_bin_alike():
    make = md.Signatures()
    for text in ("a", "a b c d", prose(1, 30), prose(2, 3000)):
        one = md.shingles(Texts(pa.array([text])), 3)[0]
        x, y = make.signature(one), make.signature(one.copy())
        assert (x == y).all() and len(x) == 128


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    rows = {r["node"]: r["component"] for r in md.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert md.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_repeat_an_id_are_compared_by_their_own_texts(spark):
    a, b, c = prose(50, 100), prose(51, 100), prose(52, 100)
    rows = [(3, a), (5, a + " more"), (5, b), (7, c), (7, c), (8, b + " more"), (9, ""), (9, " "), (None, c + " end"), (None, prose(53, 60))]
    docs = with_clashes(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)).repartition(5)
    out = md.keep_one(docs)
    assert out.columns == docs.columns
    want = [(None, c + " end"), (None, prose(53, 60)), (3, a), (5, b), (9, ""), (9, " ")]
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == sorted(want, key=repr)
    marked = {(r["doc_id"], r["component_id"], r["kept"]) for r in md.mark_duplicates(docs).collect()}
    assert {(5, 3, False), (5, 5, True), (8, 5, False), (7, None, False)} <= marked
    # two unrelated texts of one id both stay, two near ones of one id leave one; other columns decide on equal texts
    rows = [(1, a, "en", "z"), (1, b, "en", "z"), (2, c, "en", "y"), (2, c, "en", "x"), (2, c + " more", "en", "x")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    left = [(r["doc_id"], r["text"], r["source"]) for r in md.keep_one(docs).collect()]
    assert len(left) == 3 and {(1, a, "z"), (1, b, "z")} <= set(left)
    assert [r for r in left if r[0] == 2] == [r for r in [(2, c, "x"), (2, c + " more", "x")] if r in left]
    assert sorted(left) == sorted((r["doc_id"], r["text"], r["source"]) for r in md.keep_one(docs.repartition(7)).collect())
    assert md.keep_one(empty_docs(spark)).count() == 0


def test_components_take_tasks_by_their_edges(spark, monkeypatch):
    """A chain takes several steps; each runs in as many tasks as its edges need, not in all shuffle partitions."""
    tasks, real = [], md.checkpoint

    def counted(df):
        out = real(df)
        tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(md, "checkpoint", counted)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    edges = [(i, i + 1) for i in range(0, 24)] + [(i, i + 1) for i in range(100, 110)] + [(200, 201)]
    try:
        spark.conf.set(names[0], "13")
        spark.conf.set(names[1], "false")
        got = {}
        for most in (100_000, 10):
            tasks.clear()
            monkeypatch.setattr(md, "TASK_EDGES", most)
            got[most] = {r["node"]: r["component"] for r in md.components(spark.createDataFrame(edges, "a long, b long")).collect()}
            assert len(tasks) >= 3 and max(tasks[1:]) == len(edges) // most + 1
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    want = {i: 0 for i in range(25)} | {i: 100 for i in range(100, 111)} | {200: 200, 201: 200}
    assert got == {100_000: want, 10: want}
