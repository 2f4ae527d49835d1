"""Shared helpers of the text operators: words, word hashes, bounded slices of Arrow batches.

A word is a maximal run of characters other than space and the controls U+0009..U+000D.
UTF-8 continuation bytes never collide with those separators, so words are found on the
encoded bytes of a whole Arrow column at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The word pattern of the contracts, as a regular expression for Spark, Python and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The context's folder of checkpoints, set to that of ``spark.checkpoint.dir`` if it has none yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that ``spark.checkpoint.dir`` names.

    Raises if neither the session nor the context names one: only the deployment knows
    which folder all executors share.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``checkpoint`` for large tables: written as compressed Parquet to the same folder and read again, which takes
    less than half of a checkpoint's disk."""
    path = f"{_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial."""
    size = len(buf)
    up, down = _powers(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    values = buf.astype(np.uint64)
    values += np.uint64(1)
    values *= up[:size]
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """The texts of one Arrow slice as bytes, with the spans of their words.

    ``starts``/``ends`` are byte positions of the words in ``buf``; the words of text ``i``
    are ``first[i]:first[i + 1]``.  A null text is an empty one.
    """

    def __init__(self, array: pa.Array):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        array = array.cast(pa.large_string()).fill_null("")
        n = len(array)
        buffers = array.buffers()
        offs = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.buf = data[offs[0] : offs[-1]]
        self.offs = offs - offs[0]
        self.n = n
        size = len(self.buf)
        if size == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            inside = ~_SEPARATOR[self.buf]
            before = np.zeros(size, dtype=bool)
            before[1:] = inside[:-1]
            at = self.offs[:-1]
            before[at[at < size]] = False
            after = np.zeros(size, dtype=bool)
            after[:-1] = inside[1:]
            at = self.offs[1:] - 1
            after[at[at >= 0]] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offs)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` maps A-Z to a-z first."""
        return span_hashes(_LOWER[self.buf] if lower else self.buf, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def span(self, a: int, b: int) -> bytes:
        """The bytes from the start of word ``a`` to the end of word ``b - 1``."""
        return self.buf[self.starts[a] : self.ends[b - 1]].tobytes()


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position (the last ``k - 1`` positions have none)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    factor = 0x2545F4914F6CDD1D
    for j in range(k):
        out += words[j : len(words) - k + 1 + j] * np.uint64(factor)
        factor = factor * 0x5851F42D4C957F2D % (1 << 64) | 1
    return mix(out)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes at most (or, in
    whole numbers, sums up to that); one longer text makes a run of its own, so memory follows the longest text."""
    sizes = batch.column(column)
    sizes = sizes if pa.types.is_integer(sizes.type) else pa.compute.binary_length(sizes)
    sizes = sizes.fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def add_columns(df: DataFrame, fields: str, fn, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that ``fn`` makes for each bounded slice of its rows.

    ``fields`` is DDL.  ``fn(batch)`` gets a ``pyarrow.RecordBatch`` and yields pairs of a slice
    of it and one list or array per field.  An input column of the same name (in any case)
    is replaced; those in ``drop`` are left out.
    """
    new = T.StructType.fromDDL(fields)
    gone = {f.name.lower() for f in new.fields} | {x.lower() for x in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType(kept + new.fields)
    target = to_arrow_schema(T.StructType(new.fields))
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in fn(batch):
                rows, values = part
                arrays = [rows.column(n) for n in names]
                for field, value in zip(target, values, strict=True):
                    value = value if isinstance(value, pa.Array) else pa.array(value, type=field.type)
                    arrays.append(value if value.type == field.type else value.cast(field.type))
                yield pa.RecordBatch.from_arrays(arrays, names=names + target.names)

    return df.mapInArrow(run, schema)
