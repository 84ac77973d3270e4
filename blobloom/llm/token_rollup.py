"""Token counts as delta-maintained rollups.

A change is a signed row: an insert counts +1 document and its tokens, a delete
-1 and its tokens negated, a revision both. Changes of a batch are summed by
source, language and tokenizer version before anything is stored, so a batch is
a few rows. Batches live in one folder, one Parquet directory each; a batch is
written beside it and renamed into place, and a batch id that is already there is
not applied again, so a retried or repeated commit changes nothing. Totals are
sums over batches; ``compact`` folds batches into one and keeps their ids.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A BPE vocabulary in rank format, the default of ``path``: a file that is there on every machine under this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such a vocabulary cuts text before merging (fixed value, published with it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


def counted(docs: DataFrame, path: str = VOCABULARY, version: str | None = None, sign: int = 1) -> DataFrame:
    """Changes (source, lang, tokenizer, n_docs, n_tokens) that insert (or with ``sign`` -1 delete) rows of ``docs``.

    Null and empty texts have no tokens; null sources and languages are values of
    their own; repeated rows count each; texts are encoded whole, however long; no
    rows give no changes; columns other than source, lang and text are ignored.
    """

    def tally(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:  # sums of a batch of rows are all that leaves Python
            g = g.assign(n=[count_tokens(t, path) for t in g["text"]])
            yield g.groupby(["source", "lang"], dropna=False, as_index=False).agg(n_docs=("n", "size"), n_tokens=("n", "sum"))

    rows = docs.select(docs["source"].alias("source"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    sums = rows.mapInPandas(tally, "source string, lang string, n_docs bigint, n_tokens bigint")
    return sums.select(
        "source", "lang", F.lit(version or Path(path).stem).alias("tokenizer"), (F.col("n_docs") * sign).alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens")
    )


class Rollup:
    """Totals kept in ``folder`` (any path that Hadoop's file systems know), shared by all executors."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def batches(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in names if n.startswith(("batch=", "base=")))

    def _folded(self) -> set[str]:
        """Names of the batches and earlier bases that some base already holds."""
        bases = [n for n in self.batches() if n.startswith("base=")]
        return {s.getPath().getName() for n in bases for s in self._fs.listStatus(self._at(f"{n}/_ids"))}

    def committed(self, batch_id: str) -> bool:
        name = f"batch={batch_id}"
        return self._fs.exists(self._at(name)) or name in self._folded()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies ``changes`` once; False if the batch is already there."""
        if not batch_id or any(c in batch_id for c in "/=."):
            raise ValueError(f"bad batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        # how many files: a batch has a row per key at most
        sums.filter("n_docs <> 0 or n_tokens <> 0").coalesce(1).write.parquet(str(draft.toString()))
        place = self._at(f"batch={batch_id}")
        # a rename onto a directory that is there by now fails, or puts the draft inside it
        lost = self._at(f"batch={batch_id}/{draft.getName()}")
        if self._fs.exists(place) or not self._fs.rename(draft, place) or self._fs.exists(lost):
            self._fs.delete(draft, True)
            self._fs.delete(lost, True)
            return False
        return True

    def drop(self) -> None:
        """Deletes the rollup with all its batches."""
        self._fs.delete(self._path(self.folder), True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); keys whose counts have gone to zero are left out."""
        folded = self._folded()
        live = [n for n in self.batches() if n not in folded]
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in live])
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all batches into one base; a crash at any point leaves totals as they were."""
        held = {*self.batches(), *self._folded()}
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        self.totals().coalesce(1).write.parquet(str(draft.toString()))
        self._fs.mkdirs(self._path(draft, "_ids"))
        for n in held:
            self._fs.create(self._path(draft, f"_ids/{n}")).close()
        self._fs.rename(draft, self._at(f"base={uuid.uuid4().hex}"))  # from here on the new base stands for all it holds
        for n in held:
            self._fs.delete(self._at(n), True)


def delta(old: DataFrame, new: DataFrame, path: str = VOCABULARY, version: str | None = None) -> DataFrame:
    """Changes that turn counts of ``old`` rows into counts of ``new`` rows: deletes, inserts and revisions alike.

    Either may be empty; rows are treated as by ``counted``.
    """
    return counted(old, path, version, -1).unionByName(counted(new, path, version, 1))


def fresh(spark: SparkSession) -> Rollup:
    return Rollup(spark, f"{common.shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
