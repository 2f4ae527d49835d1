"""Best-fit packing: put token pieces into as few sequences of fixed capacity as possible.

Method: minimum bin slack.  Each bin starts with the longest length that is left; a subset-sum
dynamic program over the available lengths, held as a bitset of reachable fills, finds the
fullest feasible combination, which is then removed.

The program works on the histogram of lengths, which has at most ``capacity`` entries however
many pieces there are; a combination is used as often as the counts allow before the next one
is looked for.  What it returns is a schedule of length ranks, bounded in the same way and sent
to all tasks.  Pieces get their rank within their length from counts per (length, chunk), so no
length, however common, is numbered in one task.

A document is its token ids and one end id.  A null or empty text is the end id alone.  Documents
beyond the capacity are cut into full pieces, of which the first may be shorter; nothing else
is cut or dropped.  Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpv.llm.byte_bpe import read_ranks
from gridpv.llm.common import add_columns, checkpoint, read_table, slices

#: Rows of a (length, chunk) group on average; rarer lengths have one chunk.
CHUNK_ROWS = 1_000


def token_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of the documents: id, piece, start, length, ids_crc32 (of little-endian unsigned
    32-bit ids), and with ``with_ids`` the ids themselves.

    ``path`` is a rank file; its ids are those of the JSON file of the same vocabulary, with special tokens in
    texts taken as ordinary text (``encode_special_tokens``).
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    pattern = public_tokenizers.PATTERN
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ranks = {t: i for i, t in enumerate(sent.value)}
        encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for key, text in zip(part.column("id"), part.column("text").to_pylist(), strict=True):
                    # whole texts at once: faster than a memo of chunks, which each task would have to fill
                    data = (encoding.encode_to_numpy(text, disallowed_special=()).tobytes() if text else b"") + end
                    total = len(data) // 4
                    head = total % capacity or capacity
                    edges = [0, *range(head, total + 1, capacity)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        own = data[4 * a : 4 * b]
                        rows.append((key.as_py(), i, a, b - a, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names
                )

    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: len(names)]
    ddl = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best (length: times).

    Bit ``x`` of ``reach`` says that a fill of ``x`` can be made from the lengths seen so far,
    longest first; multiples of a length are added in powers of two.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            grown = (reach | reach << (length * take)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> room:
            break
    fill, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            out[length] = out.get(length, 0) + take
            fill -= length * take
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations (copies, {length: times}) that use up ``counts``, each as full as can be."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        combo = fullest(left, capacity - seed)
        left[seed] += 1
        combo[seed] = combo.get(seed, 0) + 1
        copies = min(left[k] // times for k, times in combo.items())
        for k, times in combo.items():
            left[k] -= copies * times
            if not left[k]:
                del left[k]
        out.append((copies, combo))
    return out


def schedule(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: where its pieces go."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for copies, combo in bins:
        offset = 0
        for length, times in sorted(combo.items(), reverse=True):
            rows.append((length, used.get(length, 0), times, base, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * times
        base += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, order: list[str], capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long).  ``order`` names columns that tell
    pieces apart (equal rows are exchangeable).  Lengths have to be from 1 to ``capacity``."""
    pieces = checkpoint(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most `capacity` rows
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError("a length is outside 1 to the capacity")
    plan = schedule(minimum_bin_slack(counts, capacity))
    length = F.col(length_col)
    common = {k: -(-n // CHUNK_ROWS) for k, n in counts.items() if n > CHUNK_ROWS}
    chunks = F.lit(1)
    if common:
        chunks = F.coalesce(F.create_map(*[F.lit(x) for pair in common.items() for x in pair])[length], chunks)
    keyed = pieces.withColumns({"_p_length": length, "_p_chunk": F.pmod(F.xxhash64(*order), chunks)})
    per = keyed.groupBy("_p_length", "_p_chunk").agg(F.count("*").alias("_p_n"))
    before = Window.partitionBy("_p_length").orderBy("_p_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_p_length", "_p_chunk", F.coalesce(F.sum("_p_n").over(before), F.lit(0)).alias("_p_before"))
    inner = Window.partitionBy("_p_length", "_p_chunk").orderBy(*order)
    ranked = keyed.withColumn("_p_inner", F.row_number().over(inner)).join(per, ["_p_length", "_p_chunk"])
    sent = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batch):
        p = sent.value
        own = batch.column("_p_length").to_numpy(zero_copy_only=False)
        rank = batch.column("_p_before").to_numpy(zero_copy_only=False) + batch.column("_p_inner").to_numpy(zero_copy_only=False) - 1
        row = np.searchsorted((p["length"] << 44) + p["rank"], (own << 44) + rank, side="right") - 1
        nth = rank - p["rank"][row]
        times = p["times"][row]
        yield batch, (pa.array(p["sequence"][row] + nth // times), pa.array(p["offset"][row] + nth % times * own))

    out = add_columns(ranked, "sequence_id long, offset long", place, drop=("_p_length", "_p_chunk", "_p_before", "_p_inner"))
    return out.select(*[c for c in pieces.columns if c.lower() not in {"sequence_id", "offset"}], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """The packed pieces of ``docs`` (doc_id, text)."""
    return pack(token_pieces(docs, path, capacity), ["doc_id", "piece", "ids_crc32"], capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its place in a sequence of at most 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
