"""Blocks of files of any size, read in ranges: no row holds more than a block and a line.

Spark's text source cuts files at any byte into splits, reads the lines that begin
in its split, and keeps their bytes as they are. Lines are put in their places by
running sums, within a split and over the splits of a file, and cut where blocks end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import lineage


def blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, seq, data) of the files at ``path``: bytes ``seq * size`` and on, ``size`` of them or what is left.

    Bytes between two line feeds travel as one row: files without any are for ``binaryFile``.
    """
    at = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        at["file_path"].alias("path"), at["file_block_start"].alias("split"), at["file_size"].alias("total"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"),
    )
    lines = lineage.cut(lines)  # rows and their numbers are fixed from here on
    n = F.octet_length("line").cast("long") + 1
    sums = lines.groupBy("path", "split").agg(F.sum(n).alias("n"))
    over = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)  # a row a split
    sums = sums.select(F.col("path").alias("s_path"), F.col("split").alias("s_split"), (F.sum("n").over(over) - F.col("n")).alias("before"))
    within = Window.partitionBy("path", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("end", F.sum(n).over(within))
    placed = placed.join(sums, (F.col("path") == F.col("s_path")) & (F.col("split") == F.col("s_split")))
    start = F.col("before") + F.col("end") - n
    # the last line may lack its line feed
    placed = placed.select("path", start.alias("start"), F.when(start + n > F.col("total"), F.col("line")).otherwise(F.concat("line", F.lit(b"\n"))).alias("data"))
    last = F.col("start") + F.octet_length("data") - 1
    pieces = placed.filter(F.octet_length("data") > 0).select("path", "start", "data", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))).alias("seq"))
    lead = F.greatest(F.col("seq") * size - F.col("start"), F.lit(0))
    upto = F.least((F.col("seq") + 1) * size - F.col("start"), F.octet_length("data").cast("long"))
    pieces = pieces.select("path", F.col("seq").cast("int").alias("seq"), (F.col("start") + lead).alias("place"), F.substring("data", (lead + 1).cast("int"), (upto - lead).cast("int")).alias("data"))
    return pieces.groupBy("path", "seq").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY place)").alias("data"))
