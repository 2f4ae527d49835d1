"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  Its result is written as Parquet to
the folder that ``spark.checkpoint.dir`` names, and the next stage reads it from there, so a lost
executor costs at most the stage that runs.  All but the last return the columns of ``documents``.

1. toxicity: a scorer is trained on labelled documents among the stage's input that are not held out;
   documents with a score of 0.5 or more go.
2. quality rules: documents that fail a base rule or diverge from their language's references go.
3. MinHash near-dedup: of each group of documents linked by a Jaccard similarity of 0.8 or more
   on 5-word shingles, the one with the least id stays.  Rows that repeat an id with other texts are
   documents of their own; of rows that repeat an id and a text one stays.
4. substring dedup: words covered by a 20-word window that also starts earlier are cut; a
   document that is left without words goes.  A text without such words stays as it is.
5. best-fit packing: token pieces of at most 2048 tokens with their sequence and offset.

A null text is an empty one; stage 2 rejects it for its length.  A row without id sorts before all others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm import best_fit_packing, minhash_dedup, quality_rules, substring_dedup, toxicity
from gridpv.llm.common import read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.5.  Without labels of both kinds nothing is rejected."""
    labels = read_table(spark, sf_dir, "labels")
    scorer = toxicity.fitted(toxicity.training_rows(docs, labels))
    return toxicity.score_documents(docs, scorer).where("score < 0.5").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.judge(docs, quality_rules.references(docs)).where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that also start earlier."""
    cut = substring_dedup.remove_repeats(docs)
    some = cut.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = some.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(
        *[F.col(f.name).cast(f.dataType) for f in docs.schema.fields]
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents."""
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("minhash_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Training, the component search and packing are not SQL; tests compare run() to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
