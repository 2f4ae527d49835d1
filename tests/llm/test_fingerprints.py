import hashlib

import numpy as np
from edge import SCHEMA, edge_docs, edge_rows, empty_docs, prose, with_clashes

from gridpv.llm import fingerprints as fp


def walk(text):
    """The sampled bits of one text, step by step."""
    steps = set(fp.sampled_steps(4096 * fp.BLOCK // 1024).tolist())
    out, at, j = [], 0, 0
    while at < len(text):
        block, row = divmod(j, fp.BLOCK)
        c = ord(text[at]) % fp.CLASSES
        if j in steps:
            out.append(int(fp._random_bits(block, 1)[row][c]))
        at += int(fp._random_bits(block, 0)[row][c])
        j += 1
    return out


def test_walks_match_one_by_one():
    texts = ["", "a", "hello world", prose(1, 60), "x" * 300, "é中😀" * 20]
    for text, found in zip(texts, fp.fingerprints(texts), strict=True):
        assert fp.parse(found).tolist() == walk(text)


def test_likeness_follows_edits():
    base = prose(5, 600)
    words = base.split()
    few, many = list(words), list(words)
    for i in range(0, 600, 120):
        few[i] = "edit"
    for i in range(0, 600, 6):
        many[i] = "edit"
    prints = [fp.parse(p) for p in fp.fingerprints([base, " ".join(few), " ".join(many), prose(6, 600), base])]
    near, far, other = (fp.likeness(prints[0], p) for p in prints[1:4])
    assert near > 0.6 and near > far > other - 0.05 and other < 0.2
    assert fp.likeness(prints[0], prints[4]) == 1.0 and fp.likeness(fp.parse("0:"), fp.parse("0:")) == 1.0


def test_query_follows_the_order_of_ids(spark, tmp_path):
    rows = [r for r in edge_rows() if r[0] != 5]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fp.op8_fingerprints(spark, str(tmp_path)).collect()}
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        prints = fp.fingerprints([text, changed, following])
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == prints[:2]
        assert got[i]["near_next"] == fp.likeness(fp.parse(prints[0]), fp.parse(prints[2]))


def test_repeated_ids_single_and_empty_tables(spark, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert fp.op8_fingerprints(spark, f"{tmp_path}/a").count() == 16
    edge_docs(spark).where("doc_id = 1").write.parquet(f"{tmp_path}/b/documents.parquet")
    only = fp.op8_fingerprints(spark, f"{tmp_path}/b").collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
    empty_docs(spark).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert fp.op8_fingerprints(spark, f"{tmp_path}/c").count() == 0


def test_near_documents_meet_in_bands_and_are_verified(spark):
    rows = []
    for g in range(8):
        words = prose(40 + g, 300).split()
        rows.append((10 * g, " ".join(words)))
        for e in (1, 2):
            words = list(words)
            words[150 * e - 20] = "edit"
            rows.append((10 * g + e, " ".join(words)))
    docs = with_clashes(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    pairs = {(r["a"], r["b"]) for r in fp.near_documents(fp.add_fingerprints(docs), least=0.5).collect()}
    # equal fingerprints are one document; the others of a family are found next to its first one
    prints = dict(zip([i for i, _ in rows], fp.fingerprints([t for _, t in rows]), strict=True))
    alike = {(10 * g, 10 * g + e) for g in range(8) for e in (1, 2) if prints[10 * g + e] not in {prints[10 * g + i] for i in range(e)}}
    assert all(fp.likeness(fp.parse(prints[a]), fp.parse(prints[b])) >= 0.8 for a, b in alike)
    assert len(alike) >= 4 and alike <= pairs
    assert all(a // 10 == b // 10 for a, b in pairs)
    assert np.all([a < b for a, b in pairs])


def components(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    return {x: top(x) for x in list(up)}


def test_alike_members_meet_beside_a_stranger_of_least_id(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, 640)
    flipped = lambda bits, share: bits ^ (rng.random(640) < share)
    rows = []
    for _ in range(300):  # strangers share many bits, so pairs meet in buckets of many others
        stranger = flipped(base, 0.08)
        rows += [stranger, flipped(stranger, 0.03)]
    spans = fp.step_spans(640)
    signs = np.where(np.array(rows), 1.0, -1.0)
    alike = np.argwhere(np.triu((signs * spans) @ signs.T >= 0.8 * spans.sum(), 1))
    true = set(map(tuple, alike.tolist()))
    prints = [f"640:{np.packbits(r.astype(np.uint8)).tobytes().hex()}" for r in rows]
    marked = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    found = {(r["a"], r["b"]) for r in fp.near_documents(marked).collect()}
    assert len(true) >= 250 and found <= true
    joined = components(found)
    assert sum(a in joined and joined[a] == joined.get(b) for a, b in true) >= 0.97 * len(true)


def test_query_names_classes_and_counts_links(spark, tmp_path):
    words = prose(8, 400).split()
    near = " ".join([*words[:370], *["edit"] * 10, *words[380:]])
    rows = [(1, prose(9, 400)), (2, " ".join(words)), (3, near), (4, " ".join(words)), (None, " ".join(words)), (None, "alone, quite"), (7, near + " end")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    prints = fp.fingerprints([t for _, t in rows])
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least[p] = min((x for x in (i, least.get(p)) if x is not None), default=None)
    links = {p: sum(q != p and least[q] is not None and fp.likeness(fp.parse(p), fp.parse(q)) >= 0.8 for q in least) for p in least}
    rows_got = fp.op8_fingerprints(spark, str(tmp_path)).collect()
    got = [(r["doc_id"], r["fingerprint"], r["class_id"], r["class_size"], r["n_links"]) for r in rows_got]
    want = [(i, p, least[p], prints.count(p), links[p]) for (i, _), p in zip(rows, prints, strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(links.values()) >= 1 and max(map(prints.count, prints)) >= 3
    # 2, 4 and the equal text without id are a class, 3 and 7 another, and the two a group
    groups = {(r["doc_id"], r["component_id"], r["component_size"]) for r in rows_got}
    assert groups == {(1, 1, 1), (2, 2, 5), (4, 2, 5), (None, 2, 5), (3, 2, 5), (7, 2, 5), (None, None, 1)}


def test_comparisons_grow_as_the_group(spark, monkeypatch):
    """m near copies of one text, among strangers: the pairs compared for 5 m grow as m."""
    compared = []
    real = fp.checkpoint

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b", "likeness"]:
            compared.append(out.count())
        return out

    monkeypatch.setattr(fp, "checkpoint", counted)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 640)
    pairs = {}
    for m in (60, 300):
        rows = [base ^ (rng.random(640) < 0.02) for _ in range(m)] + [rng.integers(0, 2, 640) for _ in range(m)]
        prints = [f"640:{np.packbits(r.astype(np.uint8)).tobytes().hex()}" for r in rows]
        compared.clear()
        found = fp.near_documents(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()
        joined = components((r["a"], r["b"]) for r in found)
        assert len({joined[i] for i in range(m)}) == 1 and not any(i in joined for i in range(m, 2 * m))
        pairs[m] = max(compared)
    assert pairs[300] <= 7 * pairs[60] and pairs[300] <= 2 * 300


def test_neighbours_of_compressible_and_repeated_rows(spark):
    rows = [(i, c * n) for i, (c, n) in enumerate([("x", 200_000), ("yz", 0), ("ü😀", 50_000), ("x", 200_000), ("a b ", 3)] * 3)] + [(3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def make(ids, texts):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "text": texts[:-1], "following": texts[1:]})

    got = fp.neighbours(docs, "doc_id", "text", make, "id long, text string, following string").collect()
    one = {r["id"]: (r["text"], r["following"]) for r in got if r["id"] not in (2, 3)}
    text = dict(rows[:15])
    assert one == {i: (text[i], text[(i + 1) % 15]) for i in text if i not in (2, 3)}
    same = [(r["text"], r["following"]) for r in got if r["id"] == 3]
    assert sorted(t for t, _ in same) == sorted([text[3], "other"]) and {text[4]} < {f for _, f in same} <= {text[3], "other", text[4]}
    assert len(got) == 16


def test_blocks_give_the_likeness_of_the_pairs():
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 2, 900) for _ in range(3)]
    bits = [(bases[k % 3] ^ (rng.random(900) < 0.02 * (k % 5)))[: int(rng.integers(500, 900))] for k in range(90)]
    prints = [f"{len(b)}:{np.packbits(b.astype(np.uint8)).tobytes().hex()}" for b in bits]
    parts = [0, 0, 0, *range(3, 90)]
    found = fp.linked_pairs(list(range(100, 190)), parts, prints, 0.6)
    assert all(like == fp.likeness(bits[a - 100], bits[b - 100]) >= 0.6 and a < b for a, b, like in found)
    true = [(i, j) for i in range(90) for j in range(i) if fp.likeness(bits[i], bits[j]) >= 0.6]
    want, got = (components([(0, 1), (1, 2), *p]) for p in (true, [(a - 100, b - 100) for a, b, _ in found]))
    same = lambda c: {frozenset(x for x in c if c[x] == t) for t in c.values()}
    assert len(true) > 200 > len(found) and same(want) == same(got)


def test_members_below_the_threshold_make_no_row_per_pair(spark, monkeypatch):
    """Many that meet in buckets and are not alike enough: all are compared, in blocks, and only links come out."""
    rows, real = [], fp.checkpoint

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b", "likeness"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(fp, "checkpoint", counted)
    monkeypatch.setattr(fp, "BLOCK_MEMBERS", 16)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, 640)
    members = [base ^ (rng.random(640) < 0.09) for _ in range(400)]
    members += [members[0] ^ (rng.random(640) < 0.02), members[399] ^ (rng.random(640) < 0.02)]
    prints = [f"640:{np.packbits(r.astype(np.uint8)).tobytes().hex()}" for r in members]
    found = fp.near_documents(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()
    true = {(i, j) for j in range(402) for i in range(j) if fp.likeness(members[i], members[j]) >= 0.8}
    assert {(r["a"], r["b"]) for r in found} <= true and {(0, 400), (399, 401)} <= true
    joined = components((r["a"], r["b"]) for r in found)
    assert sum(a in joined and joined[a] == joined.get(b) for a, b in true) >= 0.97 * len(true)
    assert sum(rows) <= 2 * len(members)


def test_small_blocks_are_compared_together_with_the_same_links(spark, monkeypatch):
    """Many small blocks give what each gives by itself, and are not compared one by one."""
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 2, 1000) for _ in range(4)]
    bits = [(base[k % 4] ^ (rng.random(1000) < 0.03 * (k % 4)))[: int(rng.integers(1, 1000))] for k in range(300)]
    prints = [f"{len(b)}:{np.packbits(b.astype(np.uint8)).tobytes().hex()}" for b in bits]
    ids, parts = list(range(300)), rng.integers(0, 120, 300).tolist()
    starts = np.unique(np.concatenate([[0], rng.integers(1, 300, 40)]))
    ends = [*starts[1:].tolist(), 300]
    alone = [x for s, e in zip(starts.tolist(), ends, strict=True) for x in fp.linked_pairs(ids[s:e], parts[s:e], prints[s:e], 0.5)]
    assert len(alone) > 20 and fp.linked_in_blocks(starts, ids, parts, prints, 0.5) == alone

    def refused(*_):
        raise AssertionError("a small block was compared by itself")

    monkeypatch.setattr(fp, "linked_pairs", refused)
    monkeypatch.setattr(fp, "HELD", 8)
    one = rng.integers(0, 2, 640)
    near = [one ^ (rng.random(640) < 0.07) for _ in range(20)]
    rows = [f"640:{np.packbits(r.astype(np.uint8)).tobytes().hex()}" for r in near]
    found = fp.near_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, fingerprint string"), 0.7).collect()
    assert all(r["likeness"] == fp.likeness(near[r["a"]], near[r["b"]]) >= 0.7 for r in found)


def test_bands_draw_their_bits_once(monkeypatch):
    bits = [np.random.default_rng(k).integers(0, 2, 700) for k in range(5)]
    want = [fp.bands(b) for b in bits]
    monkeypatch.setattr(fp.np.random, "Generator", None)
    assert [fp.bands(b) for b in bits] == want
