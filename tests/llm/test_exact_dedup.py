import hashlib
from collections import defaultdict

import pytest
from edge import SCHEMA, edge_docs, edge_rows, empty_docs, prose, with_clashes

from gridpv.llm import exact_dedup as ed

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def digest(text):
    return hashlib.sha256((text or "").translate(_LOWER).encode()).digest()


def rank(i):
    return float("-inf") if i is None else i


def brute(rows):
    """digest -> (largest id, size) of one load."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[digest(text)].append(i)
    return {d: (max(ids, key=rank), len(ids)) for d, ids in groups.items()}


@pytest.fixture
def index(spark):
    return ed.DigestIndex(spark, ed.shared_folder(spark), 4)


def check(rows, got):
    """One row per loaded row, the keeper and size of its group, and one kept row per group."""
    groups = brute(rows)
    assert sorted(((rank(i), digest(t)) for i, t in rows)) == sorted((rank(r["id"]), bytes(r["digest"])) for r in got)
    kept = defaultdict(list)
    for r in got:
        d = bytes(r["digest"])
        assert (r["keep_id"], r["group_size"]) == groups[d]
        if r["kept"]:
            kept[d].append(r["id"])
    assert dict(kept) == {d: [top] for d, (top, _) in groups.items()}


def test_edge_rows_and_clashing_names(spark, index):
    index.add(with_clashes(edge_docs(spark)))
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = index.verdicts().collect()
    check(rows, got)
    assert sum(1 for r in got if r["id"] == 5) == 2  # the repeated row is there twice, and kept once
    assert digest("ÉTÉ") != digest("été")


def test_empty_table(spark, index):
    index.add(empty_docs(spark))
    assert index.verdicts().count() == 0 and index.digests().count() == 0


def test_loads_append_only_new_digests_and_the_earlier_load_stays(spark, index):
    first = [(20, "A b"), (21, "c"), (22, "c")]
    second = [(1, "a B"), (30, "a b"), (2, "d"), (3, "D")]
    for rows in (first, second):
        index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    entries = {bytes(r["digest"]): (r["keep_id"], r["load"]) for r in index.digests().collect()}
    assert entries == {digest("a b"): (20, 1), digest("c"): (22, 1), digest("d"): (3, 2)}
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.verdicts().collect()}
    assert got == {
        20: (20, 3, True), 1: (20, 3, False), 30: (20, 3, False), 21: (22, 2, False), 22: (22, 2, True), 2: (3, 2, False), 3: (3, 2, True)
    }


def test_index_persists_and_a_failed_load_is_ignored(spark, index):
    index.add(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    # a load that wrote its entries but no commit
    spark.createDataFrame([(9, digest("y"))], "id long, digest binary").selectExpr("id", "digest", "0L AS row").write.parquet(f"{index.path}/rows/load=2")
    spark.sql(f"INSERT INTO {index.table} SELECT unhex('{digest('y').hex()}'), 9L, 0L, 2")
    spark.sql(f"DROP TABLE {index.table}")  # the folder stays: another session knows no table
    again = ed.DigestIndex(spark, index.path, 4)
    assert again.loads() == [1] and again.digests().count() == 1 and again.rows().count() == 1
    assert again.add(spark.createDataFrame([(2, "Y"), (3, "X")], "doc_id long, text string")) == 3
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in again.verdicts().collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_hot_group_and_buckets(spark):
    """A group with a third of all rows goes by broadcast, the others by the shuffled join."""
    rows = [(i, "Hot one" if i % 3 == 0 else prose(i // 2, 5)) for i in range(3000)]
    index = ed.DigestIndex(spark, ed.shared_folder(spark), 4)
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    check(rows, index.verdicts().collect())
    files = spark.read.parquet(f"{index.path}/digests").inputFiles()
    buckets = {f.split("_")[-1].split(".")[0] for f in files}
    assert len(buckets) == 4
    # the file of a bucket is sorted by digest
    held = [bytes(r["digest"]) for r in spark.read.parquet(files[0]).collect()]
    assert held == sorted(held)


def test_anti_join_neither_shuffles_nor_broadcasts_the_index(spark):
    index = ed.DigestIndex(spark, ed.shared_folder(spark), 8)
    index.add(spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string"))
    groups = index.rows().groupBy("digest").count()
    joined = groups.join(index.digests().hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 8 out of 8" in plan


def test_query_matches_brute_force(spark, tmp_path):
    rows = [(i, prose(i % 7, 20).upper() if i % 2 else prose(i % 7, 20)) for i in range(-5, 40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = ed.op12_exact_dedup(spark, str(tmp_path)).collect()
    groups = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        top, size = groups[bytes.fromhex(r["text_sha256"])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, size, r["doc_id"] == top)
