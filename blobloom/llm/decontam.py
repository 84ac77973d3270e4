"""Benchmark decontamination by a prefix-filtered containment join.

An item gives windows of eight consecutive words (all its words if fewer). A
window is contained in a document only if each of its words is, so one word is
a sufficient prefix: the one that the corpus has least often. Document words
join these rarest words; the window's place in the document follows from the
word's offset, must lie within the text (positional and length bound), and the
words there must equal the window (exact verification). Windows with a word the
corpus lacks are never looked for.

Two scans of the corpus: word counts of the benchmark's vocabulary, and the
join. Only matches and one row a document are shuffled, never texts. Where the
index is too large to broadcast, a bitmap of its tokens is, and words that it may
hold are shuffled with those around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_ITEMS = 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap of index tokens that goes to all executors, at most.
MAX_BITS = 27
#: A token no text has; stands behind each document's words to carry its row through the join.
END = " "


def words(text: Column) -> Column:
    """Lower-cased words; null and wordless texts give an empty array."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, n, items): distinct windows and the ids, as strings, of the items that have them."""
    items = benchmark.filter(benchmark["item_id"].isNotNull()).select(
        benchmark["item_id"].cast("string").alias("item"), words(benchmark["text"]).alias("w")
    )
    items = items.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(width)))
    starts = items.withColumn("s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return starts.groupBy(F.slice("w", F.col("s"), F.col("n")).alias("window")).agg(
        F.collect_set("item").alias("items")
    )


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(token, off, window, items): each window under its rarest word in ``docs``."""
    vocabulary = wins.select(F.explode("window").alias("v")).distinct()
    size = vocabulary.count()
    tokens = docs.select(F.explode(words(docs["text"])).alias("t"))
    if size <= common.BROADCAST_ROWS:
        tokens = tokens.join(F.broadcast(vocabulary), F.col("t") == F.col("v"), "left_semi")
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    if size > common.BROADCAST_ROWS:
        counts = counts.join(vocabulary, F.col("t") == F.col("v"), "left_semi")
    places = wins.select("window", "items", F.posexplode("window").alias("off", "token"))
    ranked = places.join(common.small(counts, size), F.col("token") == F.col("t"), "left")
    best = ranked.groupBy("window").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("token"), F.col("off"))).alias("p"),
        F.first("items").alias("items"),
    )
    return best.filter("p.c > 0").select("p.token", "p.off", "window", "items")


def token_hash(token: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(1 << bits))


def bitmap(index: DataFrame, rows: int) -> tuple[bytes, int]:
    """A bit for each hash of a token of ``index``: one in 16 or fewer is set, up to MAX_BITS. Bounded by these, whatever the index."""
    bits = min(MAX_BITS, max(10, (16 * rows).bit_length()))
    h = token_hash(F.col("token"), bits)
    set_ = index.select(F.shiftright(h, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = bytearray(1 << bits - 3)
    for r in set_.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[8 * r["at"] : 8 * r["at"] + 8] = (r["bits"] & (1 << 64) - 1).to_bytes(8, "little")
    return bytes(out), bits


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...).

    Returns doc_id, text_key, n_words, n_hit, n_items, items_sha256,
    contaminated. Null texts and texts without words have no words and no hit;
    items without an id or without words are ignored, items of one id are one;
    repeated rows are all returned; of equally rare words of a window the first in
    order is its prefix; texts are used whole, however long; other columns are
    ignored; without items nothing is hit; no rows give no rows.
    """
    index = prefixes(docs, windows(benchmark, width))
    index = index.select("token", "off", F.size("window").alias("len"), "window", "items")
    end = index.sparkSession.range(1).select(
        F.lit(END).alias("token"),
        F.lit(0).alias("off"),
        F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("window"),
        F.array().cast("array<string>").alias("items"),
    )
    index = common.cut(index.unionByName(end))
    n_index = index.count()
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        common.row_key(docs["text"]).alias("text_key"),
        words(docs["text"]).alias("w"),
    )
    if n_index <= common.BROADCAST_ROWS:
        at = rows.select("doc_id", "text_key", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "t"))
        at = at.join(F.broadcast(index), F.col("t") == F.col("token"))
        first, n = F.col("pos") - F.col("off"), F.size("w")
        fits = (first >= 0) & (first + F.col("len") <= n)
        same = F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("len")) == F.col("window")
    else:  # an index beyond the bound: words that may be in it are shuffled, each with the words around it
        n = F.col("n")
        held, bits = bitmap(index.filter(F.col("token") != END), n_index)
        padded = F.concat("w", F.array(F.lit(END)))

        def may_be(i: Column) -> Column:
            h = token_hash(F.get("p", i), bits)
            byte = F.conv(F.hex(F.substring(F.lit(held), (F.shiftright(h, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return (i == F.size("w")) | (F.call_function("shiftright", byte, h.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1)

        at = rows.select("doc_id", "text_key", "w", padded.alias("p"))
        at = at.select("doc_id", "text_key", "w", "p", F.explode(F.filter(F.sequence(F.lit(0), F.size("w")), may_be)).alias("pos"))
        at = at.select(
            "doc_id", "text_key", "pos", F.get("p", F.col("pos")).alias("t"), F.size("w").alias("n"),
            F.slice("w", F.greatest(F.col("pos") + 2 - width, F.lit(1)), F.lit(2 * width - 1)).alias("near"),
        )
        at = at.join(index, F.col("t") == F.col("token"))
        first = F.col("pos") - F.col("off")
        fits = (first >= 0) & (first + F.col("len") <= n)
        lead = F.greatest(F.col("pos") + 1 - width, F.lit(0))
        same = F.slice("near", F.greatest(first - lead, F.lit(0)) + 1, F.col("len")) == F.col("window")
    is_end = F.col("token") == END
    at = at.filter(is_end | (fits & same))
    hits = at.select(
        "doc_id",
        "text_key",
        is_end.alias("is_end"),
        F.when(is_end, n).alias("n_words"),
        F.when(~is_end, F.struct(first.alias("s"), F.col("len").alias("n"))).alias("span"),
        F.when(~is_end, F.col("items")).alias("items"),
    )
    per_doc = hits.groupBy("doc_id", "text_key").agg(
        F.count_if("is_end").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set("span").alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))
    n_items = F.size("items").cast("long")
    out = per_doc.select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
        "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_items: int = 1) -> DataFrame:
    """``docs`` without rows that hold windows of ``min_items`` or more items; columns as they are."""
    bad = contamination(docs, benchmark, width, min_items).filter("contaminated")
    bad = common.cut(bad.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).distinct())
    return common.drop_keys(docs, bad, bad.count())
