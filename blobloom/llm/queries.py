"""Contract queries: thin digests of the operators' results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, language_id, line_dedup, mixing, quality, sharding, simhash, substring_dedup, token_rollup, topk
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per removed span; documents without one have no row."""
    spans = substring_dedup.repeats(read(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start", "stop", "n_words", "kept_doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(read(spark, sf_dir, "pages"))
    return cleaned.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after inserts, revisions and deletes that come and go, each batch committed twice.

    Every text is encoded once, to signed counts of its key; revisions count each
    document's source as revised text of one token more and take that back.
    """
    docs = read(spark, sf_dir, "documents")
    rollup = token_rollup.fresh(spark)
    load = common.cut(token_rollup.counted(docs))
    revised = load.withColumn("n_tokens", F.col("n_tokens") + F.col("n_docs"))
    signed = lambda df, k: df.withColumns({c: F.col(c) * k for c in ("n_docs", "n_tokens")})
    for name, changes in (
        ("load-1", load), ("revise-1", signed(load, -1).unionByName(revised)), ("delete-1", signed(revised, -1)),
        ("load-2", revised), ("revise-2", signed(revised, -1).unionByName(load)),
    ):
        rollup.commit(name, changes)
        rollup.commit(name, changes)
    rollup.compact()
    totals = common.cut(rollup.totals())
    rollup.drop()
    return totals


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(language_id.of_documents(read(spark, sf_dir, "documents")), ["doc_id"])
    return found.select("doc_id", "lang", F.round("probability", 6).alias("probability"), "declared", "rejected")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages, which declare a markup language and have hosts and suffixes."""
    found = language_id.identify(language_id.of_pages(read(spark, sf_dir, "pages")), ["page_id"])
    return found.select("page_id", "lang", F.round("probability", 6).alias("probability"), "declared", "rejected")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(read(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing, op2_decontamination, op3_quality, op4_substring_dedup, op5_line_dedup, op6_token_counts,
        op7_language_id, op8_top_k, op9_simhash, op10_sharding, language_id_pages,
    )
    return {f.__name__: f for f in found}
