import hashlib
import random
import zlib

import pytest
from edge import SCHEMA, edge_docs, edge_rows, empty_docs, with_clashes

from gridpv.llm import merkle_manifest as mm

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in doc))


def levels_of(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def path_of(levels, place, fanout):
    """[(digests before, digests after)] of each level up to the root."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % fanout
        out.append((nodes[first:place], nodes[place + 1 : first + fanout]))
        place //= fanout
    return out


def brute(docs, fanout):
    """docs: (doc_id, source, lang, n_chars, text) -> root and a list of (doc, leaf, subroot, path)."""
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    sources = sorted({d[1] for d in docs}, key=key)
    trees = {s: sorted(((d, leaf_of(d)) for d in docs if d[1] == s), key=lambda x: (key(x[0][0]), x[1])) for s in sources}
    levels = {s: levels_of([leaf for _, leaf in trees[s]], fanout) for s in sources}
    crown = levels_of([levels[s][-1][0] for s in sources], fanout)
    rows = []
    for nth, s in enumerate(sources):
        for place, (doc, leaf) in enumerate(trees[s]):
            path = path_of(levels[s], place, fanout) + path_of(crown, nth, fanout)
            rows.append((doc, leaf, levels[s][-1][0], path))
    return crown[-1][0], rows


def fold(leaf, path):
    for before, after in path:
        leaf = sha("".join([*before, leaf, *after]))
    return leaf


def documents(n_by_source, seed=1):
    rnd = random.Random(seed)
    ids = rnd.sample(range(10**6), sum(n_by_source.values()))
    out = []
    for source, n in n_by_source.items():
        for _ in range(n):
            text = rnd.choice([None, "", "Ünï", "Ab c", "x" * rnd.randint(0, 50)])
            out.append((ids.pop(), source, rnd.choice(["en", None]), rnd.choice([None, 5, -3]), text))
    return out


def check(manifest, docs, fanout):
    root, rows = brute(docs, fanout)
    assert manifest.root == root
    want = sorted((str(d[0]), leaf, subroot, "".join("".join(a + b) for a, b in path)) for d, leaf, subroot, path in rows)
    got = manifest.leaves.collect()
    assert want == sorted((str(r["doc_id"]), r["leaf"].hex(), r["subroot"].hex(), r["proof"].hex()) for r in got)
    for r in got:
        assert mm.fold(bytes(r["leaf"]), bytes(r["shape"]), bytes(r["proof"])).hex() == root
    for r in got[:5]:
        assert mm.fold(hashlib.sha256(b"other").digest(), bytes(r["shape"]), bytes(r["proof"])).hex() != root


def built(docs, columns=COLUMNS, **more):
    leaves = mm.leaf_digests(docs, {"leaf": columns})
    return mm.build(leaves.select("doc_id", "source", "leaf"), "source", "doc_id", **more)


@pytest.mark.parametrize(("fanout", "depth"), [(2, 1), (3, 2), (16, 3)])
def test_trees_of_every_height_match_brute_force(spark, fanout, depth):
    """Sizes at and beside whole subtrees, a null source, a lone leaf, a source with most rows."""
    sizes = {None: 3, "": 1, "a": fanout, "b": fanout**2, "B": fanout + 1, "é": 300, "z": fanout**depth}
    docs = documents(sizes)
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    check(built(frame, fanout=fanout, depth=depth), docs, fanout)


def test_many_sources(spark):
    docs = documents({f"s{i}": 1 + i % 3 for i in range(70)})
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    check(built(frame, fanout=4, depth=2), docs, 4)


def test_one_document_is_the_root(spark):
    docs = documents({"a": 1})
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = built(frame)
    assert manifest.root == leaf_of(docs[0])
    row = manifest.leaves.first()
    assert row["proof"] == b"" and row["shape"] == b""


def test_edge_rows_and_clashing_names(spark):
    docs = [(i, s, lang, n, t) for i, t, lang, s, n in edge_rows()]
    check(built(with_clashes(edge_docs(spark))), docs, 16)
    # any further column is carried along, whatever its name
    wide = mm.leaf_digests(edge_docs(spark), {"leaf": COLUMNS}).selectExpr("doc_id", "source", "leaf", "1 AS order", "2 AS block", "3 AS digest")
    assert {(r["order"], r["block"], r["digest"]) for r in mm.build(wide, "source", "doc_id").leaves.collect()} == {(1, 2, 3)}


def test_empty_table(spark):
    manifest = built(empty_docs(spark))
    assert manifest.root is None and manifest.leaves.count() == 0 and manifest.trees.count() == 0


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame(documents({"a": 400, "b": 100}), "doc_id long, source string, lang string, n_chars long, text string")
    rows = [sorted(map(str, built(x, fanout=3, depth=2).leaves.collect())) for x in (docs.coalesce(1), docs.repartition(13))]
    assert rows[0] == rows[1]


def test_query_tells_changed_rows(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["ABC d", "abc", None, ""]), "en", rnd.choice(["a", "b", None]), 1) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [(i, s, lang, n, t) for i, t, lang, s, n in rows]
    root, want = brute(docs, 16)
    want = {d[0]: (d, leaf, subroot, path) for d, leaf, subroot, path in want}
    got = mm.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and any(not r["verified"] for r in got)
    for r in got:
        doc, leaf, subroot, path = want[r["doc_id"]]
        found = leaf
        if zlib.crc32(str(doc[0]).encode()) % 5 == 0 and doc[4] is not None:
            found = leaf_of((*doc[:4], doc[4].lower()))
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == sha("".join("".join(a + b) for a, b in path))
        assert r["folded_root"] == fold(found, path) and r["verified"] == (found == leaf)
