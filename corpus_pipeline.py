"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import mixing, pieces, simhash, templates, toxicity
from shardloom.llm.common import checkpoint_dir


# Every stage but the last returns the columns of its input, whatever further columns that has; no rows give no rows, repeated
# rows and nulls in any column are taken as said, and texts are read whole.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. A null text is scored like an empty one; repeated rows stay or go together."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier document has; ``n_chars`` follows the text.

    No document goes, one that loses all its lines has an empty text; null texts stay null, repeated rows are one document.
    """
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns) if c in ("n_lines", "n_dropped")}
    out = templates.without_recurring_lines(docs.withColumnsRenamed(names))
    out = out.withColumn("n_chars", F.when(out["n_dropped"] > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, one row of it. Null, empty and blank texts are
    near-duplicates of each other; rows without id only stay if no row with one is alike."""
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Documents without words are never taken; null is a source like any other."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of every row; a null text has null ids."""
    return pieces.encode(docs).select("doc_id", "ids", "n_ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("simhash", drop_near_duplicates), ("mixing", mix_sources), ("encoding", encode)]

#: Toxicity, fingerprints and encoding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next, after which it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{before}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = name
    return docs
