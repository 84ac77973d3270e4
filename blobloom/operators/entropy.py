"""rANS over sequences of instructions held in arrays: as a column expression, and in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, lanes


def _words(ls: list[np.ndarray], bs: list[np.ndarray]) -> list[np.ndarray]:
    """Words of several sequences, coded in step."""
    sizes = np.array([len(x) for x in ls], np.int64)
    flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (ls, bs)]
    return [w.astype("int64") for w in lanes.rans_encode(*flat, np.cumsum(sizes) - sizes, sizes)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def encode_udf(ls: pd.Series, bs: pd.Series) -> pd.Series:
    """Words of arrays of frequencies and cumulative frequencies; for long or many sequences."""
    there = [i for i, x in enumerate(ls) if x is not None]
    out: list = [None] * len(ls)
    for i, w in zip(there, _words([ls.iloc[i] for i in there], [bs.iloc[i] for i in there]), strict=True):
        out[i] = w
    return pd.Series(out)


#: Bytes coded together at most; a single blob may have more.
SLICE = 1 << 20


def encode_blocks(df: DataFrame, keys: list[str], data: str, block: int) -> DataFrame:
    """(keys, seq, w): words of each block of ``block`` bytes of ``data`` under the order-0 frequencies of the whole of it.

    Blobs are coded some at a time, and their words leave as they come: a worker
    holds the instructions of ``SLICE`` bytes, or of one blob, whatever a batch has.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = pc.binary_length(batch.column(len(keys))).fill_null(0).to_numpy(zero_copy_only=False)
            slices = np.cumsum(sizes) // SLICE
            for at in (np.flatnonzero(slices == k) for k in np.unique(slices)):
                part = batch.slice(int(at[0]), len(at))
                ls, bs, owner, seq, length = [], [], [], [], []
                for i, d in enumerate(part.column(len(keys))):
                    if not d.is_valid or not (n := len(d.as_buffer())):
                        continue
                    s = np.frombuffer(d.as_buffer(), np.uint8)
                    f = kernels.frequency_table(np.bincount(s, minlength=kernels.ALPHABET))
                    ls.append(f.astype(np.int32)[s])
                    bs.append((np.cumsum(f) - f).astype(np.int32)[s])
                    blocks = -(-n // block)
                    owner.append(np.full(blocks, i))
                    seq.append(np.arange(blocks, dtype=np.int32))
                    length.append(np.minimum(block, n - seq[-1].astype(np.int64) * block))
                if not ls:
                    continue
                size = np.concatenate(length)
                words = lanes.rans_encode(np.concatenate(ls), np.concatenate(bs), np.cumsum(size) - size, size)
                ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words).astype(np.int64)))
                took = pa.array(np.concatenate(owner))
                columns = [*[part.column(k).take(took) for k in range(len(keys))], pa.array(np.concatenate(seq)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "seq", "w"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return df.select(*keys, data).mapInArrow(run, f"{schema}, seq int, w array<bigint>")


def encode(instructions: Column) -> Column:
    """Array of 32-bit words of an array of (ls, bs) structs; coded from the end, two words of state first."""
    start = F.struct(F.lit(1 << 31).cast("long").alias("x"), F.array().cast("array<bigint>").alias("w"))

    def step(acc: Column, i: Column) -> Column:
        ls, bs = i["ls"].cast("long"), i["bs"].cast("long")
        full = acc["x"] >= F.shiftleft(ls, 39)
        x = F.when(full, F.shiftright(acc["x"], 32)).otherwise(acc["x"])
        w = F.when(full, F.array_append(acc["w"], acc["x"].bitwiseAND(F.lit((1 << 32) - 1)))).otherwise(acc["w"])
        return F.struct((_div(x, ls) * (1 << 24) + bs + x % ls).alias("x"), w.alias("w"))

    def finish(acc: Column) -> Column:
        tail = F.array(F.shiftright(acc["x"], 32), acc["x"].bitwiseAND(F.lit((1 << 32) - 1)))
        return F.reverse(F.concat(acc["w"], tail))

    return F.aggregate(F.reverse(instructions), start, step, finish)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def uniform(symbol: Column) -> Column:
    """Instruction of a symbol without context."""
    return F.struct(F.lit(1 << 16).cast("long").alias("ls"), F.shiftleft(symbol.cast("long"), 16).alias("bs"))


def instructions(syms: DataFrame, model: DataFrame, keys: list[str], model_keys: list[str]) -> DataFrame:
    """(keys, seq): per blob the array of (ls, bs) of its symbols under a first-order model (model_keys, prev, next, ls, bs)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("pos")
    rows = syms.withColumn("prev", F.lag("sym").over(w)).withColumnRenamed("sym", "next")
    rows = rows.join(model, [*model_keys, "prev", "next"], "left")
    one = F.when(F.col("prev").isNull(), uniform(F.col("next"))).otherwise(F.struct(F.col("ls").cast("long").alias("ls"), F.col("bs").cast("long").alias("bs")))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", one.alias("i")))).alias("s")).select(
        *keys, F.transform("s", lambda x: x["i"]).alias("seq")
    )
