"""Line dedup by site-relative frequency.

A page's lines are the text pieces between its block tags. Per host, the number
of pages that hold a line is divided by the host's pages; lines above
``MAX_RATIO`` on at least ``MIN_PAGES`` pages are boilerplate and are dropped.
Lines are made distinct within a page before anything is shuffled, so counts are
plain sums with partial aggregation, whatever share of pages a host or line has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_RATIO = 0.3
MIN_PAGES = 4
#: Applied in order to the markup: what is no text, block ends, other tags, spaces.
STEPS = (
    (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(html|head|body|title|meta|nav|ul|ol|li|div|p|br|h[1-6]|article|section|footer|header|table|tr|td|th|pre|form|aside|main)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"[\x20\x09\x0B-\x0D]+", " "),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def lines(html: Column) -> Column:
    """Trimmed non-empty text lines of a page; null markup has none."""
    text = F.coalesce(html, F.lit(""))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host(url: Column) -> Column:
    """Lower-cased host of an address; "" if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_key, pages, of, ratio): lines to drop on a host, of whose ``of`` pages ``pages`` hold them."""
    rows = pages.select(host(pages["url"]).alias("host"), lines(pages["html"]).alias("lines"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    held = rows.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line_key"))
    held = held.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    hosts = hosts.withColumnRenamed("host", "h_host")
    both = held.join(hosts, F.col("host") == F.col("h_host"))
    ratio = F.col("pages") / F.col("of")
    return both.select("host", "line_key", "pages", "of", ratio.alias("ratio")).filter(F.col("ratio") > max_ratio)


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def clean(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of each row of ``pages`` (page_id, url, html).

    Null or hostless addresses are one host; null markup has no lines and an empty
    text; repeated rows count as pages of their own and are all returned; a page may
    be of any length; ties don't arise, as a ratio decides alone; extra columns are
    ignored; no pages give no rows.
    """
    bad = boilerplate(pages, max_ratio, min_pages).select(F.col("host").alias("b_host"), "line_key", "of")
    # a host's boilerplate: fewer lines than its average page has, divided by max_ratio
    per_host = bad.groupBy("b_host").agg(F.collect_set("line_key").alias("bad"), F.max("of").alias("of"), F.count(F.lit(1)).alias("k"))
    per_host = common.cut(per_host)
    n = per_host.agg(F.sum("k")).first()[0] or 0
    rows = pages.select(pages["page_id"].alias("page_id"), host(pages["url"]).alias("host"), lines(pages["html"]).alias("lines"))
    if n <= common.BROADCAST_ROWS:
        both = rows.join(F.broadcast(per_host), F.col("host") == F.col("b_host"), "left")
    else:  # facts of large hosts go to where their pages are; pages of the others, each a small part, meet them by shuffle
        total = pages.count()
        sure = per_host.select(F.col("b_host").alias("s_host"))
        both = common.join_hot(rows, per_host, "host", "b_host", "of", total)
        hot = F.broadcast(per_host.filter(F.col("of") > F.lit(total * common.HOT)).select(F.col("b_host").alias("_h")))
        none = rows.join(hot, F.col("host") == F.col("_h"), "left_anti").join(sure, F.col("host") == F.col("s_host"), "left_anti")
        both = both.unionByName(none, allowMissingColumns=True)
    keep = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), line_key(x)))
    )
    out = both.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), keep.alias("kept"))
    return out.select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )
