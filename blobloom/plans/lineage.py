"""Cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="blobloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder; its rows, partitions and their order are fixed from there on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of input for each core up to which a table is dealt out anew before costly work.
DEALT_BYTES = 8 << 20


def dealt(df: DataFrame, *keys: str, per_core: int = DEALT_BYTES) -> DataFrame:
    """``df``, of few row groups, dealt out by ``keys`` so that all cores have work; a table over the bound stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    total, files = 0, df.inputFiles()
    if len(files) > 4 * cores:
        return df
    for f in files:
        total += path(f).getFileSystem(conf).getFileStatus(path(f)).getLen()
    return df.repartition(cores, *keys) if total <= cores * per_core else df
