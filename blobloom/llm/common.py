"""Shared helpers: text columns, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, dealt, shared_folder  # noqa: F401

KEYS = {"documents": ["doc_id"], "pages": ["page_id"]}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows up to which a narrow table (a few dozen bytes a row) may be broadcast.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; small documents and pages, which lie in one row group, are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return dealt(df, *KEYS[table]) if table in KEYS else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` has a fast path for pure ASCII, where both agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``rows`` (counted by the caller) is within ``bound``, else the table as it is."""
    return F.broadcast(df) if rows <= bound else df


#: A key is hot if it has more than this share of a table's rows; there are fewer than 1 / HOT of them.
HOT = 1 / 500


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], fact_key: str | list[str], copies: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one fact for each key, whatever share of the rows a key has.

    ``copies`` of ``facts`` is how many of the ``total`` rows have the key. Facts of
    hot keys, fewer than 1 / HOT by arithmetic, are broadcast, so that their rows
    stay where they are; the others meet by shuffle.
    """
    keys, of = ([key], [fact_key]) if isinstance(key, str) else (key, fact_key)
    hot = F.col(copies) > F.lit(total * HOT)
    few = F.broadcast(facts.filter(hot))
    there = rows.join(few, [F.col(a) == F.col(b) for a, b in zip(keys, of, strict=True)])
    named = few.select(*[F.col(b).alias(f"_hot{n}") for n, b in enumerate(of)])
    rest = rows.join(named, [F.col(a) == F.col(f"_hot{n}") for n, a in enumerate(keys)], "left_anti")
    return there.union(rest.join(facts.filter(~hot), [F.col(a) == F.col(b) for a, b in zip(keys, of, strict=True)]))


def row_key(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text)


def drop_keys(docs: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """``docs`` without rows whose (doc_id, text) is among ``keys(k_id, k_text)``; columns stay as they are.

    Up to ``BROADCAST_ROWS`` keys go to all executors, so that no text is shuffled.
    """
    same = docs["doc_id"].eqNullSafe(keys["k_id"]) & (row_key(docs["text"]) == keys["k_text"])
    return docs.join(small(keys, rows), same, "left_anti")
