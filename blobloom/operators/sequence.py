"""Sequence transforms over blobs and over long symbol tables.

Long form is ``(key..., pos, sym)``, one row a symbol, pos from 0. Windows
partition by blob, so their groups are bounded by the block size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits
from . import kernels


def chunk(df: DataFrame, block: int, data: str = "data", seq: str = "seq") -> DataFrame:
    """One row per block of ``block`` bytes of ``data``: a tumbling window over the byte offset. Empty data has no block."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1))
    others = [c for c in df.columns if c != data]
    return df.select(*others, data, F.explode(starts).alias(seq)).select(
        *others, seq, F.substring(data, F.col(seq) * block + 1, F.lit(block)).alias(data)
    )


def symbols(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Long form of a binary column."""
    return df.select(*keys, F.posexplode(bits.byte_values(F.col(data))).alias("pos", "sym"))


def collect_symbols(df: DataFrame, keys: list[str], value: str = "sym") -> DataFrame:
    """Binary ``data`` of long-form rows, in order of pos."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("s"))
    hex_ = F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x[value]), 2, "0")), "")
    return rows.select(*keys, F.unhex(hex_).alias("data"))


def bwt_columns(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """BWT by sorting the suffixes of a blob where it lies: (keys, data, bw_index). For small blocks: an array of suffixes is quadratic in the block."""
    n = F.octet_length(data)
    rows = df.filter(n > 0).select(*keys, F.col(data).alias("b"))
    n = F.octet_length("b")
    # suffixes differ in length, so that this tells where each begins; only that leaves the expression
    suffixes = F.sort_array(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("b", i, n)))
    rows = rows.select(*keys, "b", F.transform(suffixes, lambda x: n - F.octet_length(x)).alias("at"))
    # the text's last symbol first, then the symbol before each suffix, but for the whole text
    before = F.transform("at", lambda i: F.hex(F.substring("b", i, F.least(i, F.lit(1)))))
    last = F.hex(F.substring("b", -1, 1))
    return rows.select(*keys, F.unhex(F.concat(last, F.array_join(before, ""))).alias("data"), F.array_position("at", F.lit(0)).cast("long").alias("bw_index"))


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("bw_index", T.LongType())]))
def bwt_udf(data: pd.Series) -> pd.DataFrame:
    got = [kernels.bwt(bytes(b)) if b is not None else (None, None) for b in data]
    return pd.DataFrame({"data": [x[0] for x in got], "bw_index": pd.array([x[1] for x in got], dtype="Int64")})


@F.pandas_udf(T.BinaryType())
def unbwt_udf(data: pd.Series, index: pd.Series) -> pd.Series:
    return pd.Series([kernels.unbwt(bytes(b), int(i)) if b is not None else None for b, i in zip(data, index, strict=True)])


@F.pandas_udf(T.BinaryType())
def mtf_udf(data: pd.Series) -> pd.Series:
    return pd.Series([kernels.mtf(bytes(b)) if b is not None else None for b in data])


@F.pandas_udf(T.BinaryType())
def unmtf_udf(data: pd.Series) -> pd.Series:
    return pd.Series([kernels.unmtf(bytes(b)) if b is not None else None for b in data])


def bwt(df: DataFrame, data: str = "data") -> DataFrame:
    """BWT of each blob, of any size: replaces ``data`` and adds bw_index."""
    return df.withColumn("_b", bwt_udf(data)).withColumns({data: F.col("_b.data"), "bw_index": F.col("_b.bw_index")}).drop("_b")


def inverse_bwt(df: DataFrame, data: str = "data") -> DataFrame:
    return df.withColumn(data, unbwt_udf(data, "bw_index")).drop("bw_index")


def mtf_columns(syms: DataFrame, keys: list[str]) -> DataFrame:
    """Move-to-front in closed form on long rows: adds ``rank``.

    A symbol seen before moves by the distinct symbols since; a new one stands at
    its own number plus the seen symbols above it. Distinct symbols since are the
    places in between that don't come again before here.
    """
    w = Window.partitionBy(*keys, "sym").orderBy("pos")
    a = syms.withColumns({"pp": F.lag("pos").over(w), "np": F.lead("pos").over(w)})
    run = Window.partitionBy(*keys).orderBy("pos")
    # symbols so far, most recent last, one place each: bounded by the alphabet
    last = F.collect_list(F.struct("pos", "sym", "np")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    here = F.filter(last, lambda t: t["np"].isNull() | (t["np"] >= F.col("pos")))
    since = F.size(F.filter(here, lambda t: t["pos"] > F.col("pp")))
    above = F.size(F.filter(here, lambda t: t["sym"] > F.col("sym")))
    rank = F.when(F.col("pp").isNotNull(), since).otherwise(F.col("sym") + above)
    return a.withColumn("rank", rank).drop("pp", "np")


def delta(keys: list[str], order: list[str], value: str) -> Column:
    """Difference to the value before, wrapped to 32 bits; the first is kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return wrap32(F.col(value).cast("long") - F.coalesce(F.lag(F.col(value).cast("long")).over(w), F.lit(0)))


def undelta(keys: list[str], order: list[str], value: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return wrap32(F.sum(F.col(value).cast("long")).over(w))


def wrap32(n: Column) -> Column:
    half, whole = F.lit(1 << 31), F.lit(1 << 32)
    return (F.pmod(n + half, whole) - half).cast("long")


def zigzag_order(x: Column, y: Column) -> list[Column]:
    """Sort keys that put cells of a grid in zig-zag order: by anti-diagonal, odd ones downwards, even ones upwards."""
    return [x + y, F.when((x + y) % 2 == 1, y).otherwise(x)]


def zigzag(grids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, at) of each cell of grids (keys, w, h): its place in the scan, from 0."""
    cells = grids.filter("w > 0 and h > 0").select(*keys, "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    cells = cells.select(*keys, "w", "h", "x", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    # closed form: cells of earlier anti-diagonals, then the place on this one
    s = F.col("x") + F.col("y")
    lo, hi = F.least("w", "h"), F.greatest("w", "h")
    full = F.col("w") * F.col("h")
    rest = F.col("w") + F.col("h") - 1 - s
    before = F.when(s <= lo, (s * (s + 1) / 2)).when(s <= hi, lo * (lo + 1) / 2 + (s - lo) * lo).otherwise(full - rest * (rest + 1) / 2)
    down = F.col("y") - F.greatest(F.lit(0), s - F.col("w") + 1)
    up = F.col("x") - F.greatest(F.lit(0), s - F.col("h") + 1)
    return cells.select(*keys, "x", "y", (before + F.when(s % 2 == 1, down).otherwise(up)).cast("long").alias("at"))
