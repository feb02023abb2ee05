"""The corpus pipeline: reject, deduplicate, decontaminate, mix and shard documents.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept and returns
the columns of documents; the last adds ``slot`` and ``shard``.  Stages that hand whole texts to Python
set the session's batches to ``session.BATCH_ROWS`` rows, and leave them so, as they are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontaminate, jaccard, mixing, quality_rules, sharding
from claimloom.llm.queries import SHARDS, table
from claimloom.session import new_folder, remove, scratch, small_batches


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target asks for."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.place(docs, SHARDS)


STAGES = [("quality rules", rules), ("n-gram jaccard join", deduplicate), ("decontamination", clean), ("mixing", mix), ("sharding", shard)]

#: The compression bands and edit distances have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage is written as Parquet and read again.

    What a stage wrote on its way goes when it is done, and its result when the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{k}")
        with scratch(spark) as folder:
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for done in (folder, before):
            if done is not None:
                remove(spark, done)
        before = path
    return docs
