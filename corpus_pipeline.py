"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents; the last adds shard, slot and cell.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blobloom.llm import common, decontam, language_id, mixing, sharding, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null and empty texts, texts without letters, texts of no language.

    Rows are kept or go by (doc_id, text), so repeated rows fare alike.
    """
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, a null id last, then by text hash.

    Null and wordless texts are one group; of repeated rows one stays.
    """
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and wordless texts have none, and stay."""
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them: not at all, once or twice.

    A null source is a source; null and wordless texts have no words and count for nothing.
    """
    return mixing.mix(docs, keep=True)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, their place in it and their cell, dealt to files: each in one shard, in order.

    Each row has a slot of its own, repeated rows as well; nulls come last in order.
    """
    return sharding.shard(docs, keep=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Fitted language models and similarity components have no SQL form; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder until the next one is written.

    With a ``run_id``, stages that an earlier call with it has finished are not done again.
    No documents give no rows; columns of documents beyond those used are kept.
    """
    docs = common.read(spark, sf_dir, "documents")
    at = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{common.shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    tables = [f"{folder}/{name}" for name, _ in STAGES]
    done = [fs.exists(at(f"{t}/_SUCCESS")) for t in tables]
    first = max((k + 1 for k, there in enumerate(done) if there), default=0)
    if first:
        docs = spark.read.parquet(tables[first - 1])
    for k, (_, stage) in enumerate(STAGES[first:], first):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(tables[k])
        docs = spark.read.parquet(tables[k])
        if k:
            fs.delete(at(tables[k - 1]), True)
    return docs
