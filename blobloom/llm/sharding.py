"""Sharding along a Hilbert curve over quantised metadata.

Dimensions: source and language by equi-depth rank of their order, size by its
logarithm. Rows are ordered by curve index, then by a hash of their id, and the
order is cut into runs whose row counts differ by one at most, so that a file's
min/max statistics are narrow in all three dimensions.

No task gets a whole cell: a cell is dealt into buckets by a hash of id, text and
size, counts of (cell, bucket) give each bucket's first position, and only rows of
one bucket are numbered together; rows that are equal in all these are counted
before they are.

With ``keep``, rows are dealt to files as they are numbered: a file lies in one
shard and holds one run of slots, in order, so that readers can skip files by
shard, slot, cell, source, language or size.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 4
SHARDS = 8
#: Hex digits of the MD5 that deals a cell into buckets.
BUCKET_DIGITS = 3
#: Bytes of text in a file of a shard, about.
FILE_BYTES = 128 << 20


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a cell on the Hilbert curve (Skilling, 2004)."""
    x = list(point)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fold, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            fold ^= q - 1
        q >>= 1
    x = [v ^ fold for v in x]
    index = 0
    for b in reversed(range(bits)):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


@cache
def curve(dims: int, bits: int) -> tuple[int, ...]:
    """Curve index of each cell; at most 65,536 cells."""
    if dims * bits > 16:
        raise ValueError("a curve table has at most 16 bits")
    side = (1 << bits) - 1
    return tuple(
        hilbert_index(tuple(c >> bits * (dims - 1 - k) & side for k in range(dims)), bits)
        for c in range(1 << dims * bits)
    )


def equi_depth(docs: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, quantile): order-keeping quantile of each distinct value, nulls last.

    One row per distinct value is numbered in one task: for metadata of bounded
    cardinality (sources, languages), not for keys.
    """
    order = Window.orderBy(F.col("value").asc_nulls_last())
    counts = docs.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.select("value", F.expr("n").alias("n"), before.alias("b"), total.alias("t")).select(
        "value", F.floor(F.col("b") * (1 << bits) / F.col("t")).cast("int").alias("quantile")
    )


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def bucket(doc_id: Column, crc: Column, size: Column) -> Column:
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(crc.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, BUCKET_DIGITS), 16, 10).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, keep: bool = False) -> DataFrame:
    """Deals rows (doc_id, text, lang, source, ...) into ``shards`` runs of the curve.

    Returns doc_id, size, text_crc32, law ("rows"), cell, shard, slot and
    grown_shard (null), or with ``keep`` the columns of ``docs`` (first of each
    name among the needed ones) and shard, slot, cell, dealt to files. A null text
    has no bytes, so its size is 1, and a null CRC; null ids, sources and languages
    are values of their own, last in order; repeated rows each get a slot; texts
    may be of any length; no rows give no rows.
    """
    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("s_source"),
        docs["lang"].alias("s_lang"),
        text_size(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        bucket(docs["doc_id"], F.crc32(text.cast("binary")), text_size(text)).alias("bucket"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []),
    )
    src = equi_depth(docs.select(docs["source"].alias("v")), "v", bits).select(
        F.col("value").alias("src_value"), F.col("quantile").alias("src_q")
    )
    lng = equi_depth(docs.select(docs["lang"].alias("v")), "v", bits).select(
        F.col("value").alias("lang_value"), F.col("quantile").alias("lang_q")
    )
    # a row a value; counted, so that rows with their texts aren't shuffled to find out
    src, lng = common.cut(src), common.cut(lng)
    src, lng = common.small(src, src.count()), common.small(lng, lng.count())
    rows = rows.join(src, rows["s_source"].eqNullSafe(src["src_value"]), "left")
    rows = rows.join(lng, rows["s_lang"].eqNullSafe(lng["lang_value"]), "left")
    size_q = F.least(F.length(F.bin("size")) - 1, F.lit((1 << bits) - 1)).cast("int")  # whole part of log2
    code = (F.col("src_q") * (1 << bits) + F.col("lang_q")) * (1 << bits) + size_q
    table = F.array(*[F.lit(i) for i in curve(3, bits)])
    rows = rows.withColumn("cell", F.element_at(table, (code + 1).cast("int"))).drop(
        "src_value", "src_q", "lang_value", "lang_q", "s_source", "s_lang"
    )

    # first position of each (cell, bucket), and the number of rows
    counts = common.cut(rows.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    in_cell = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = counts.select("cell", "bucket", (F.sum("n").over(in_cell) - F.col("n")).alias("b"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # one row a cell: 4,096 at most
    cells = cells.select(
        F.col("cell").alias("c_cell"),
        (F.sum("n").over(along) - F.col("n")).alias("c"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    first = buckets.join(F.broadcast(cells), F.col("cell") == F.col("c_cell")).select(
        F.col("cell").alias("f_cell"), F.col("bucket").alias("f_bucket"), (F.col("b") + F.col("c")).alias("first"), "total"
    )
    in_bucket = Window.partitionBy("cell", "bucket").orderBy("doc_id", "text_crc32", "size")
    if keep:
        ranked = rows.withColumn("at", F.row_number().over(in_bucket) - 1)
    else:
        alike = rows.groupBy("cell", "bucket", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("k"))
        before = F.sum("k").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
        ranked = alike.withColumn("before", before).withColumn("at", F.explode(F.expr("sequence(before, before + k - 1)")))
    ranked = ranked.join(first, (F.col("cell") == F.col("f_cell")) & (F.col("bucket") == F.col("f_bucket")))
    ranked = ranked.withColumn("pos", (F.col("first") + F.col("at")).cast("long"))
    ranked = ranked.withColumn("shard", F.expr(f"cast(pos * {shards} div total as int)"))
    slot = F.col("pos") - F.expr(f"(shard * total + {shards - 1}) div {shards}")
    if not keep:
        return ranked.select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "cell", "shard", slot.cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    names = list(dict.fromkeys(docs.columns))
    own = [F.col("row").getField(c).alias(c) for c in names if c not in ("shard", "slot", "cell")]
    of_bytes = counts.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-of_bytes // (shards * FILE_BYTES)))
    # a file is a range of positions within a shard: its number is the partition's
    nth = F.expr(f"cast(pos * {shards * files} div total as int)") if files > 1 else F.col("shard")
    ranked = ranked.select(*own, "shard", slot.cast("long").alias("slot"), "cell", nth.alias("_file"))
    return ranked.repartitionById(shards * files, F.col("_file")).sortWithinPartitions("slot").drop("_file")
