"""Exact dedup against a persistent index of digests.

Method: the index is a Parquet table bucketed and sorted by digest.  A load of documents is hashed,
grouped by digest, and joined to the index by a sort-merge anti-join, for which the index is neither
shuffled nor broadcast; digests that are not there yet are appended with the document that stays.

Texts are equal when identical after lower-casing A-Z only; their digest is the SHA-256 of that text
in UTF-8.  A null text counts as empty.  Of equal texts within a load the row with the largest id stays (null
ids come before all others; of rows that repeat the largest id, one stays).  Of equal texts in two loads, the one
of the earlier load stays: it may have been handed out already.  So rows loaded in descending
ranges of ids keep the largest id over all loads.

A load counts once its commit is written.  What a failed load left behind is ignored, and the load can be
repeated.  Groups of copies are counted by partial sums; the rows of groups that hold more than one in
``HOT`` of all rows (fewer than ``HOT`` groups, by their size) get their keeper by a broadcast join, so no key of
the other join holds more than that share.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import read_table, slices

#: A group is hot when it holds more than one in so many of all rows; there are fewer than this many.
HOT = 1000
#: Rows of a bucket that ``buckets_for`` aims at.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int) -> int:
    """Buckets of an index that will hold about ``rows`` digests."""
    return max(16, -(-rows // BUCKET_ROWS))


def _hash_texts(batches):
    """Rows (id, text) to (id, digest)."""
    for batch in batches:
        for part in slices(batch, "text"):
            lowered = pc.ascii_lower(part.column("text").fill_null("")).cast(pa.large_binary())
            digests = [hashlib.sha256(text.as_buffer()).digest() for text in lowered]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary())], names=["id", "digest"])


class DigestIndex:
    """A persistent index in the folder ``path``, which all executors share; opened again by its path.

    ``buckets`` holds for the life of the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = f"gridpv_digests_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, load INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{self.path}/digests'"
        )
        # an empty commit, so that the folder can be listed before the first load
        self._note(0)

    def _note(self, load: int) -> None:
        self.spark.range(1, numPartitions=1).select(F.lit(load).alias("done")).write.mode("overwrite").parquet(f"{self.path}/commits/load={load}")

    def loads(self) -> list[int]:
        """The numbers of the loads that count."""
        done = self.spark.read.schema("done int").parquet(f"{self.path}/commits")
        return sorted(r["done"] for r in done.where("done > 0").collect())

    def digests(self) -> DataFrame:
        """The index: digest, keep_id, keep_row and load of the document that stays."""
        return self.spark.table(self.table).where(F.col("load").isin(self.loads()))

    def rows(self) -> DataFrame:
        """Every loaded row: id, digest, row (its number in the load) and load."""
        schema = "id long, digest binary, row long, load int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("load").isin(self.loads()))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Load documents (ids are whole numbers); the number of the load."""
        taken = self.spark.table(self.table).agg(F.max("load")).first()[0] or 0
        load = max([taken, *self.loads()]) + 1
        plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        hashed = plain.mapInArrow(_hash_texts, "id long, digest binary").withColumn("row", F.monotonically_increasing_id())
        folder = f"{self.path}/rows/load={load}"
        hashed.write.mode("overwrite").parquet(folder)
        rows = self.spark.read.schema("id long, digest binary, row long").parquet(folder)
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"))
        fresh = groups.join(self.digests().hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.lit(load).alias("load"))
        fresh.write.insertInto(self.table)
        self._note(load)
        return load

    def verdicts(self) -> DataFrame:
        """Per loaded row: id, load, digest, keep_id (of the row that stays), group_size (rows of equal text in
        all loads) and kept."""
        rows = self.rows()
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        entries = self.digests().select("digest", "keep_id", "keep_row", F.col("load").alias("keep_load"))
        entries = entries.hint("merge").join(sizes, "digest")
        limit = rows.count() / HOT
        hot = F.broadcast(entries.where(F.col("group_size") > limit))
        judged = rows.join(hot, "digest").unionByName(
            rows.join(hot, "digest", "left_anti").join(entries.where(F.col("group_size") <= limit), "digest")
        )
        kept = (F.col("load") == F.col("keep_load")) & (F.col("row") == F.col("keep_row"))
        return judged.select("id", "load", "digest", "keep_id", "group_size", kept.alias("kept"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/digests-{uuid.uuid4().hex}"


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: the row that stays for its text.

    The table is loaded into a new index in two loads, the upper half of the range of ids first, so that the
    second load meets an index with entries and the largest id stays.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    index = DigestIndex(spark, shared_folder(spark), buckets_for(ends["n"]))
    middle = 0 if ends["low"] is None else (ends["low"] + ends["high"]) // 2
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index.add(docs.where(upper))
    index.add(docs.where(~upper))
    return index.verdicts().select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, s AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
"""
