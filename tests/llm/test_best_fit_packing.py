import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from edge import edge_docs, edge_rows, empty_docs, with_clashes
from tokenizers import Tokenizer

from gridpv.llm import best_fit_packing as bp

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_fullest_combination_is_optimal():
    rnd = random.Random(3)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(0, 6))}
        room = rnd.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        combo = bp.fullest(counts, room)
        assert all(0 < combo[k] <= counts[k] for k in combo)
        assert sum(k * n for k, n in combo.items()) == max(s for s in sums if s <= room)


def test_bins_use_each_piece_once_and_few_bins():
    rnd = random.Random(4)
    lengths = [min(2048, int(rnd.lognormvariate(5.5, 1)) + 1) for _ in range(20_000)]
    bins = bp.minimum_bin_slack(Counter(lengths), 2048)
    used = Counter()
    for copies, combo in bins:
        assert sum(k * n for k, n in combo.items()) <= 2048
        for k, n in combo.items():
            used[k] += n * copies
    assert used == Counter(lengths)
    assert sum(c for c, _ in bins) <= 1.01 * (sum(lengths) / 2048) + 1


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, used in enumerate(bins):
            if used + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_cut_and_packed_whole(spark):
    rows = bp.pack_documents(with_clashes(edge_docs(spark)), PATH).collect()
    check_places(rows, 2048)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    want = Counter()
    for i, text, *_ in edge_rows():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        edges = [0, *range(head, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_common_lengths_are_ranked_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bp, "CHUNK_ROWS", 7)
    rows = [(i, 3 if i % 3 else i % 10 + 1) for i in range(500)] + [(1, 4)] * 5
    got = bp.pack(spark.createDataFrame(rows, "k long, length long").repartition(5), ["k"], 10).collect()
    assert Counter((r["k"], r["length"]) for r in got) == Counter(rows)
    assert check_places(got, 10) <= first_fit_decreasing([n for _, n in rows], 10)


def test_empty_table_and_ids(spark):
    assert bp.pack_documents(empty_docs(spark), PATH).count() == 0
    row = bp.token_pieces(edge_docs(spark).where("doc_id = 6"), PATH, with_ids=True).first()
    assert row["ids"][-1] == 0 and len(row["ids"]) == row["length"]
