"""Substring dedup by hashing of lines and of the sentences within them.

A unit is a line as it is. A line is also cut after sentence marks with white
space and before capitals after white space (a passage pasted into a line starts
with one), and each piece is a unit too; nothing is fused with what stands before
or after it. A unit is normalised (ASCII lower case, white space collapsed) and
hashed to 128 bits; digests are grouped globally by a combining aggregation; the
earliest occurrence, by document id and place, stays. Later occurrences of lines
of ``LINE_WORDS`` words or more are removed, and so are runs of neighbouring
repeated units of ``MIN_WORDS`` words or more; shorter ones are idiom and are left
alone. Removed spans keep their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LINE_WORDS, MIN_WORDS = 5, 25
BOUNDARY = regex.compile(r"(?<=\n)|(?<=[.!?][ \t])|(?<=[ \t])(?=\p{Lu})")
#: Units of a batch that a Python worker sends back at once.
BATCH = 50_000
#: span and place hold two numbers each, the first in the upper half: characters, with the sign set for whole lines; words.
UNITS = "doc_id bigint, text_key bigint, d0 array<bigint>, d1 array<bigint>, span array<bigint>, place array<bigint>"
LINE = -(1 << 63)


def split_units(text: str) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
    """(start, stop) in characters, (first, last) in words, whole line or not, and normalised text of the units of a text."""
    cuts = [0, *(c for m in BOUNDARY.finditer(text) if 0 < (c := m.start()) < len(text)), len(text)]
    begin = n = 0
    pieces: list[tuple[int, int, list[bytes]]] = []
    for a, b in zip(cuts, cuts[1:]):
        w = text[a:b].encode().lower().split()
        if w:
            pieces.append((a, b, w))
        if b == len(text) or text[b - 1] == "\n":
            if len(pieces) > 1:
                at = n
                for x, y, p in pieces:
                    yield x, y, at, at + len(p), False, b" ".join(p)
                    at += len(p)
            if pieces:
                whole = [v for *_, p in pieces for v in p]
                yield begin, b, n, n + len(whole), True, b" ".join(whole)
                n += len(whole)
            begin, pieces = b, []


def _units(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    n = 0
    for g in it:
        for doc_id, key, text in zip(g["doc_id"], g["text_key"], g["text"], strict=True):
            units = list(split_units(text))
            if not units:
                continue
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(u[5]) for u in units]), ">i8").astype(np.int64)
            start, stop, first, last, line = np.array([u[:5] for u in units], np.int64).T
            rows.append((doc_id, key, digests[::2], digests[1::2], (start << 32 | stop) + line * LINE, first << 32 | last))
            n += len(units)
            if n > BATCH:
                yield _frame(rows)
                rows, n = [], 0
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, text_key, start, stop, n_words, kept_doc_id): spans to remove from texts of ``docs``.

    ``kept_doc_id`` holds the earliest occurrence of the span's longest unit.
    Null and empty texts have no units; a null doc_id ranks last; repeated rows (one
    id, one text) are one document; repeats within a document count as well; of
    equal digests in one document the first stays; texts are used whole, however
    long; other columns are ignored; no rows give no spans.
    """
    rows = docs.filter(docs["text"].isNotNull()).select(
        docs["doc_id"].alias("doc_id"), common.row_key(docs["text"]).alias("text_key"), docs["text"].alias("text")
    )
    # nullable ids would become floats in pandas: they travel as the largest long, which ranks last
    none = F.lit((1 << 63) - 1)
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", none))
    packed = common.cut(rows.mapInPandas(_units, UNITS))
    units = packed.select("doc_id", "text_key", F.explode(F.arrays_zip("d0", "d1", "span", "place")).alias("u")).select("doc_id", "text_key", "u.*")
    at = F.struct("doc_id", "text_key", "place")
    mark = F.xxhash64("doc_id", "text_key", "place")
    first = units.groupBy(F.col("d0").alias("f0"), F.col("d1").alias("f1")).agg(
        F.min(at).alias("first"), F.min(mark).alias("low"), F.max(mark).alias("high"), F.count(F.lit(1)).alias("copies")
    )
    first = common.cut(first.filter("low <> high").select("f0", "f1", "first", "copies"))
    total = packed.agg(F.sum(F.size("d0"))).first()[0] or 0
    again = common.join_hot(units, first, ["d0", "d1"], ["f0", "f1"], "copies", total).filter(at != F.col("first"))
    begin, end = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    again = again.select("doc_id", "text_key", "span", begin.alias("begin"), end.alias("end"), F.col("first.doc_id").alias("kept"))
    again = again.dropDuplicates(["doc_id", "text_key", "begin", "end"])
    chars = F.col("span").bitwiseAND(F.lit((1 << 63) - 1))
    again = again.select(
        "doc_id", "text_key", "begin", "end", ((F.col("span") < 0) & (F.col("end") - F.col("begin") >= line_words)).alias("line"), "kept",
        F.shiftright(chars, 32).cast("int").alias("start"), chars.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("stop"),
    )
    doc = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("new", F.when(before >= F.col("begin"), 0).otherwise(1)).withColumn("run", F.sum("new").over(doc))
    unit = F.struct((F.col("begin") - F.col("end")).alias("n"), "begin", "end", "start", "stop", "kept")
    runs = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("end") - F.min("begin")).alias("n_words"),
        F.min(unit).alias("longest"), F.collect_list(F.when(F.col("line"), unit)).alias("lines"),
    )
    whole = F.struct("start", "stop", "n_words", F.col("longest.kept").alias("kept"))
    of_line = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), (-x["n"]).alias("n_words"), x["kept"].alias("kept"))
    spans = F.when(F.col("n_words") >= min_words, F.array(whole)).otherwise(F.transform("lines", of_line))
    spans = runs.select("doc_id", "text_key", F.explode(spans).alias("s"))
    real = lambda c: F.when(F.col(c) != none, F.col(c))
    return spans.select(
        real("doc_id").alias("doc_id"), "text_key", "s.start", "s.stop", F.col("s.n_words").cast("long").alias("n_words"),
        real("s.kept").alias("kept_doc_id"),
    )


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the texts' ``spans`` cut out; columns as they are."""
    per_doc = spans.groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )
    same = docs["doc_id"].eqNullSafe(per_doc["k_id"]) & (common.row_key(docs["text"]) == per_doc["k_text"])
    both = docs.join(per_doc, same, "left")
    # text before each span, from the end of the one before; then the tail
    kept = F.expr(
        "concat(array_join(transform(spans, (s, i) -> substring(text, if(i = 0, 0, spans[i - 1].stop) + 1,"
        " s.start - if(i = 0, 0, spans[i - 1].stop))), ''), substring(text, spans[size(spans) - 1].stop + 1))"
    )
    return both.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
