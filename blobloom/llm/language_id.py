"""Language ID by Bayesian fusion of text, markup, address suffix and host.

* Text: naive Bayes over hashed byte trigrams, fitted on a bounded sample of rows
  that declare a language. Evidence is capped at ``EVIDENCE`` trigrams' worth, as
  trigrams of a text aren't independent. "und" is a text with trigrams of no
  language (uniform).
* Declared language: right with a rate learned per language by aggregation.
* Host: share of each language on it, summed over the text posteriors of all its
  rows, smoothed by its address suffix's shares, and those by all rows' shares.

A row is rejected if "und" wins, or if it has no letters at all. At most
``LANGUAGES`` languages with ``LEAST`` rows or more have a text model; a row that
declares another one is not rejected for that, but keeps its declaration where no
modelled language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 13
#: Expected training rows of a language, languages at most, and the least rows of one.
SAMPLE, LANGUAGES, LEAST = 2000, 200, 5
EVIDENCE, HOST_WEIGHT, SUFFIX_WEIGHT = 200.0, 20.0, 100.0
UNKNOWN = "und"
REJECT_BELOW = 0.5
CHUNK = 1 << 20

_FOLD = np.full(256, 32, np.int64)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32


def trigrams(data: bytes | None) -> np.ndarray:
    """Counts of hashed byte trigrams that hold a letter; other bytes count as spaces."""
    out = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(b" " + (data or b"") + b" ", np.uint8)
    for at in range(0, len(raw) - 2, CHUNK):
        b = _FOLD[raw[at : at + CHUNK + 2]]
        b0, b1, b2 = b[:-2], b[1:-1], b[2:]
        some = (b1 != 32) | ((b0 != 32) & (b2 != 32))
        h = (((b0 * 31 + b1) * 31 + b2) * 2654435761 >> 10) & (BUCKETS - 1)
        out += np.bincount(h[some], minlength=BUCKETS)
    return out


class TextModel:
    """log p(trigram | language); the last language is "und"."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = [*names, UNKNOWN]
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(names) else np.zeros((0, BUCKETS))
        self.log_p = np.log(np.vstack([p, np.full(BUCKETS, 1 / BUCKETS)]))

    def evidence(self, data: bytes | None) -> list[float]:
        """Log likelihood of each language, of EVIDENCE trigrams at most; zeros for a text without letters."""
        c = trigrams(data)
        n = c.sum()
        if not n:
            return [0.0] * len(self.names)
        return (self.log_p @ c * (min(n, EVIDENCE) / n)).tolist()


def fit(rows: DataFrame) -> TextModel:
    """From rows (declared, text): about SAMPLE of each declared language, by hash of the text."""
    known = rows.filter("declared is not null and text is not null")
    counts = known.groupBy("declared").count().filter(F.col("count") >= LEAST)
    top = counts.orderBy(F.desc("count"), "declared").limit(LANGUAGES).collect()  # at most LANGUAGES rows
    names = sorted(r["declared"] for r in top)
    if not names:
        return TextModel([], np.zeros((0, BUCKETS)))
    share = {r["declared"]: min(1.0, SAMPLE / r["count"]) for r in top}
    rate = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, share[n])]), F.col("declared"))
    picked = known.filter(F.col("declared").isin(names) & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate * (1 << 20)))

    def tally(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for g in it:
            for name, text in zip(g["declared"], g["text"], strict=True):
                sums[name] = sums.get(name, 0) + trigrams(text)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": c[at]})

    got = picked.select("declared", F.col("text").cast("binary").alias("text")).mapInPandas(tally, "lang string, bucket int, n bigint")
    got = got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most LANGUAGES x BUCKETS rows
    table = np.zeros((len(names), BUCKETS))
    table[got["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return TextModel(names, table)


def place(host: str, suffix: str) -> Column:
    """One key of a host and a suffix; nulls are values of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return F.concat(part(host), F.lit("\n"), part(suffix))


def _softmax(x: str, n: int) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def identify(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Language of each row of ``rows``: ``keys``, declared, host, suffix, text (strings but for the keys).

    Returns keys, lang (None if rejected), probability, text_lang, declared and
    rejected. Null texts and texts without letters are rejected; a null declared
    language is no evidence; null hosts and suffixes are each one group; of equally
    likely languages the first in order of names wins; repeated rows are treated
    alike; texts are used whole, however long; columns other than those named are
    ignored; no rows give no rows.
    """
    model = fit(rows)
    names, size = model.names, len(model.names)

    @F.pandas_udf("array<double>")
    def evidence(text: pd.Series) -> pd.Series:
        return pd.Series([model.evidence(t) for t in text])

    log = rows.select(
        *keys, "declared", "host", "suffix",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        evidence(F.col("text").cast("binary")).alias("ll"),
    )
    log = common.cut(log.withColumn("post", _softmax("ll", size)))  # texts are read once; what follows is narrow
    best = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("post", F.array_max("post")).cast("int"))
    log = log.withColumn("text_lang", F.when(F.col("letters"), best).otherwise(F.lit(UNKNOWN)))

    # how often a declaration is right, per language of the text
    heard = log.filter(F.col("declared").isin(names[:-1]) & (F.col("text_lang") != UNKNOWN))
    right = heard.groupBy("text_lang").agg(
        F.sum((F.col("declared") == F.col("text_lang")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")
    ).collect()  # a row per language
    rate = dict.fromkeys(names, 0.5) | {r["text_lang"]: (r["right"] + 1) / (r["n"] + 2) for r in right}
    miss = {n: (1 - rate[n]) / max(1, size - 2) for n in names}
    said = F.array(*[F.when(F.col("declared") == F.lit(n), F.lit(float(np.log(rate[n])))).otherwise(F.lit(float(np.log(max(miss[n], 1e-6))))) for n in names[:-1]], F.lit(float(np.log(1 / max(1, size - 1)))))
    said = F.when(F.col("declared").isin(names[:-1]), said).otherwise(F.array(*[F.lit(0.0)] * size))

    # shares by host, suffix and over all: sums of posteriors, combined before any shuffle
    sums = [F.sum(F.when(F.col("letters"), F.col("post")[i]).otherwise(F.lit(0.0))).alias(f"s{i}") for i in range(size)]
    hosts = common.cut(log.groupBy("host", "suffix").agg(*sums, F.count(F.lit(1)).alias("rows")))
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    suffixes = common.cut(hosts.groupBy("suffix").agg(*again))
    all_rows = suffixes.agg(*again).first()
    total = sum(x or 0.0 for x in all_rows) or 1.0
    base = [((x or 0.0) + 1.0) / (total + size) for x in all_rows]

    def shares(t: DataFrame, by: list[str], parent: list[Column], weight: float, prefix: str) -> DataFrame:
        n = sum((F.col(f"s{i}") for i in range(1, size)), F.col("s0"))
        p = F.array(*[(F.col(f"s{i}") + F.lit(weight) * parent[i]) / (n + F.lit(weight)) for i in range(size)])
        return t.select(*[F.col(c).alias(f"{prefix}_{c}") for c in by], p.alias(f"{prefix}_p"), *([F.col("rows")] if "host" in by else []))

    sfx = shares(suffixes, ["suffix"], [F.lit(x) for x in base], SUFFIX_WEIGHT, "x")
    up = hosts.join(common.small(sfx, suffixes.count()), F.col("suffix").eqNullSafe(F.col("x_suffix")))
    pri = shares(up, ["host", "suffix"], [F.col("x_p")[i] for i in range(size)], HOST_WEIGHT, "h")
    pri = common.cut(pri.select(place("h_host", "h_suffix").alias("h_place"), "h_p", "rows"))
    log = log.withColumn("place", place("host", "suffix"))
    n_hosts = pri.count()
    if n_hosts <= common.BROADCAST_ROWS:
        fused = log.join(F.broadcast(pri.drop("rows")), F.col("place") == F.col("h_place"))
    else:
        fused = common.join_hot(log, pri, "place", "h_place", "rows", log.count())
    prior = F.col("h_p")
    score = F.zip_with(F.zip_with("ll", F.transform(prior, lambda v: F.log(v)), lambda a, b: a + b), said, lambda a, b: a + b)
    fused = fused.withColumn("score", score).withColumn("p", _softmax("score", size))
    top = F.array_max("p")
    lang = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("p", top).cast("int"))
    fused = fused.withColumn("best", lang).withColumn("top", top)
    lost = (F.col("best") == UNKNOWN) | (F.col("top") < REJECT_BELOW)
    other = F.col("declared").isNotNull() & ~F.col("declared").isin([*names[:-1], UNKNOWN])
    bad = ~F.col("letters") | (lost & ~other)
    return fused.select(
        *keys, F.when(~bad, F.when(lost, F.col("declared")).otherwise(F.col("best"))).alias("lang"), F.col("top").alias("probability"), "text_lang", "declared", bad.alias("rejected")
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Input of ``identify`` from documents: the source stands for the host; there is no address suffix."""
    return docs.select(
        docs["doc_id"].alias("doc_id"), common.row_key(docs["text"]).alias("text_key"), docs["lang"].alias("declared"),
        docs["source"].alias("host"), F.lit("").alias("suffix"), docs["text"].alias("text"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Input of ``identify`` from pages: markup language, host and its last label, and the visible text."""
    from .line_dedup import host, lines

    html = F.coalesce(pages["html"], F.lit(""))
    said = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select(
        pages["page_id"].alias("page_id"), F.when(said != "", said).alias("declared"), host(pages["url"]).alias("host"),
        F.regexp_extract(host(pages["url"]), r"([^.]+)$", 1).alias("suffix"), F.array_join(lines(pages["html"]), "\n").alias("text"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected; columns as they are."""
    bad = identify(of_documents(docs), ["doc_id", "text_key"]).filter("rejected")
    bad = common.cut(bad.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).distinct())
    return common.drop_keys(docs, bad, bad.count())
