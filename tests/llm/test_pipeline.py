import random
import re
from collections import Counter

import corpus_pipeline as cp
from edge import SCHEMA, empty_docs, prose, with_clashes
from test_minhash_dedup import brute as near
from test_substring_dedup import brute as cut

from gridpv.llm import quality_rules as qr


def documents():
    rnd = random.Random(9)
    common = qr.COMMON_WORDS["en"]
    sentence = lambda s, n: " ".join(rnd.choice(common) if rnd.random() < 0.35 else w for w in prose(s, n).split())
    rows, toxic = [], set()
    passage = sentence(1000, 60)
    for i in range(260):
        text = sentence(i, rnd.randint(60, 200))
        if i % 6 == 0:
            words = text.split()
            for _ in range(5):
                words[rnd.randrange(len(words))] = rnd.choice(["grumph", "snark", "zonked"])
            text = " ".join(words)
            toxic.add(i)
        elif i % 10 == 1:
            text += "\n" + passage
        elif i % 20 == 3:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text))
    rows += [(300 + i, rows[i][1]) for i in (1, 2, 5)] + [(400, rows[2][1] + " more"), (5, rows[5][1]), (401, None), (402, ""), (403, "few words")]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], toxic


def test_stages_match_plain_python(spark, tmp_path):
    rows, toxic = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    get = lambda df: sorted((r["doc_id"], r["text"]) for r in df.where("text IS NOT NULL").collect())
    first = get(kept["toxicity"])
    assert not toxic & {i for i, _ in first}
    assert {i for i, *_ in rows} - toxic - {i for i, _ in first} <= {401}
    second = get(kept["quality_rules"])
    assert {i for i, t in first if "$$$" not in t and len(re.findall(qr.WORD, t)) >= 50} == {i for i, _ in second}
    third = get(kept["minhash_dedup"])
    assert [i for i, _ in third] == sorted({c[2] for c in near(second, 5, 80)})
    fourth = get(kept["substring_dedup"])
    assert fourth == sorted((i, k if g else t) for i, t, n, g, k in cut(third, 20) if g < n)
    pieces = kept["best_fit_packing"].collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in fourth}
    final = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in cp.run(spark, str(tmp_path)).collect())
    assert final == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pieces)


def test_empty_tables_and_extra_columns(spark, tmp_path):
    empty_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    docs = with_clashes(spark.createDataFrame(documents()[0][:30], SCHEMA))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() > 0


def test_repeated_ids_with_other_texts_lose_nothing(spark, tmp_path):
    a, b, c = prose(60, 100), prose(61, 100), prose(62, 100)
    rows = [(3, a), (5, a + " more"), (5, b), (7, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = cp.near_dedup_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, a), (5, b), (7, c)]
