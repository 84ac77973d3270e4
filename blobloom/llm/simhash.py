"""SimHash near-dedup by a binary trie self-join.

Fingerprints are paths in a binary trie. Two nodes are walked together, starting
from the root with itself; each step takes both to their children, adds one
error where the bits differ, and gives up a pair whose errors exceed the budget.

The join is dealt out by bands: cut into one band more than the budget has bits,
two fingerprints within the budget agree in all of some band, so each goes to one
bucket a band, and the walk goes on within a bucket. Where bands are too short for
a large table, there are more and shorter ones, of which such fingerprints agree in
two or three, and buckets are of each two or three: they are smaller, and nothing
is lost. A bucket of more than ``BUCKET`` rows all the same is cut into blocks by a
hash of the id, and each two blocks are a task's. What is joined already is not walked again, so a
cluster of many fingerprints costs little more than its links. A bucket returns a
spanning forest of its links, not all pairs. Components of the forests are joined
by alternating star contraction, one shuffle a step, checkpointed.

The pipeline's near-dedup walks ``WORDS`` independent fingerprints of the set of
five-word shingles of each text. Links found there, tightened by the distance of
all bits, only say what is compared: the decision is the exact similarity of the
sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUDGET = 2
WIDTH = 3
SEED = 42
#: Rows of a bucket that are walked at once, rows that stand for a bucket's clusters, rows of which it is not worth it.
BUCKET, PIVOTS, PLAIN = 1 << 16, 32, 256
#: Node pairs expanded at once, and pairs below which two nodes are compared outright.
FRONTIER, LEAF = 1 << 18, 256
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def majority(w: list[bytes], width: int, digest: Callable[[bytes], bytes]) -> bytes:
    """Bits set in over half the digests of the word shingles (all words together if there are fewer)."""
    n = max(1, len(w) - width + 1)
    ones = 0
    for at in range(0, n, CHUNK):
        part = w[at : min(at + CHUNK, n) + width - 1]
        shingles = part if width == 1 else map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        if len(w) < width:
            shingles = [b" ".join(w)]
        found = np.frombuffer(b"".join([digest(s) for s in shingles]), np.uint8).reshape(min(n - at, CHUNK), -1)
        ones = ones + np.unpackbits(found, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: bytes' lower() and split() know ASCII only."""
    return (data or b"").lower().split()


def xxh64(shingle: bytes) -> bytes:
    return xxhash.xxh64_digest(shingle, SEED)


def fingerprint(data: bytes | None, width: int) -> int:
    """64-bit SimHash of the word shingles; 0 without words."""
    w = words(data)
    return int.from_bytes(majority(w, width, xxh64), "big", signed=True) if w else 0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, fp) of each row; checkpointed, so texts are read once."""

    @F.pandas_udf("bigint")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in text], dtype="int64")

    return common.cut(docs.select(
        docs["doc_id"].alias("doc_id"),
        common.row_key(docs["text"]).alias("text_key"),
        prints(docs["text"].cast("binary")).alias("fp"),
    ))


class Forest:
    """Components of 0..n-1 under links given in blocks; labels are smallest members."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links = 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        x = self.label
        while True:
            ri, rj = x[i], x[j]
            apart = ri != rj
            if not apart.any():
                return
            self.links += 1
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            low, high = np.minimum(ri, rj), np.maximum(ri, rj)
            np.minimum.at(x, high, low)
            while True:
                y = x[x]
                if (y == x).all():
                    break
                x[:] = y

    def runs(self) -> np.ndarray:
        """Of each member, where the run of neighbours with its label ends."""
        ends = np.append(np.flatnonzero(self.label[1:] != self.label[:-1]) + 1, len(self.label))
        return ends[np.searchsorted(ends, np.arange(len(self.label)), side="right")]


class Walk:
    """Joins rows of a sorted fingerprint array within ``budget`` of ``width`` bits, in a forest.

    Rows from ``second`` on are another sorted array; then only pairs across count.
    ``near`` tells of row indices (i, j) which pairs are links. Depth-first over
    blocks of node pairs, so memory is bounded by FRONTIER and ``width`` levels.
    """

    def __init__(self, fp: np.ndarray, width: int, budget: int, near: Callable, second: int | None = None):
        self.fp, self.width, self.budget, self.near, self.second = fp, width, budget, near, second
        self.forest = Forest(len(fp))
        self.cuts: dict[int, np.ndarray] = {}

    def ones(self, bit: int) -> np.ndarray:
        """Running count of rows whose bit, from the top, is set."""
        if bit not in self.cuts:
            x = (self.fp >> np.uint64(self.width - 1 - bit)) & np.uint64(1)
            self.cuts[bit] = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return self.cuts[bit]

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        ok = (np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.budget) & (i != j)
        i, j = i[ok], j[ok]
        ok = self.near(i, j)
        self.forest.link(i[ok], j[ok])

    def pivots(self) -> None:
        """Links of some rows to all: most of a large cluster is joined before the walk."""
        n = len(self.fp)
        rows = np.arange(n)
        if self.second is None:
            self.take(rows[:-1], rows[1:])
        for p in np.unique(np.linspace(0, n - 1, PIVOTS).astype(np.int64)):
            other = rows if self.second is None else rows[self.second :] if p < self.second else rows[: self.second]
            self.take(np.full(len(other), p), other)

    def run(self) -> np.ndarray:
        """Labels of the rows: the smallest index of each component."""
        n, cut = len(self.fp), self.second
        if n > PLAIN:
            self.pivots()
        start = [0, n, 0, n, 0] if cut is None else [0, cut, cut, n, 0]
        stack = [(0, np.array(start, np.int64)[:, None])] if start[1] > start[0] and start[3] > start[2] else []
        ends, seen = self.forest.runs(), self.forest.links
        while stack:
            at, f = stack.pop()
            if self.forest.links != seen:
                ends, seen = self.forest.runs(), self.forest.links
            # nodes of one component have nothing to find
            x = self.forest.label
            f = f[:, ~((ends[f[0]] >= f[1]) & (ends[f[2]] >= f[3]) & (x[f[0]] == x[f[2]]))]
            if f.shape[1] > FRONTIER:
                half = f.shape[1] // 2
                stack += [(at, f[:, :half]), (at, f[:, half:])]
                continue
            pairs = (f[1] - f[0]) * (f[3] - f[2])
            leaf = pairs <= LEAF if at < self.width else np.ones(len(pairs), bool)
            if leaf.any():
                self.leaves(f[:, leaf], pairs[leaf])
                f = f[:, ~leaf]
            if not f.shape[1]:
                continue
            c = self.ones(at)
            la, ha, lb, hb, e = f
            ma, mb = ha - (c[ha] - c[la]), hb - (c[hb] - c[lb])
            mirror = (la == lb) & (ha == hb)
            nexts = []
            for x0, x1, y0, y1, add, ok in (
                (la, ma, lb, mb, 0, True),
                (ma, ha, mb, hb, 0, True),
                (la, ma, mb, hb, 1, True),
                (ma, ha, lb, mb, 1, ~mirror),
            ):
                take = (x1 > x0) & (y1 > y0) & (e + add <= self.budget) & ok
                nexts.append(np.stack([x0[take], x1[take], y0[take], y1[take], e[take] + add]))
            f = np.concatenate(nexts, axis=1)
            if f.shape[1]:
                stack.append((at + 1, f))
        return self.forest.label

    def leaves(self, f: np.ndarray, pairs: np.ndarray) -> None:
        ends = np.cumsum(pairs)
        lo = 0
        while lo < len(pairs):  # blocks of about a million pairs, or one large leaf in rows
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + (1 << 20), side="right")))
            g, n = f[:, lo:hi], pairs[lo:hi]
            lo = hi
            if n[0] > 1 << 20:  # one leaf of equal fingerprints: a row of it at a time, against what is not joined to it
                la, ha, lb, hb, _ = g[:, 0]
                for i in range(la, ha):
                    j = np.arange(lb, hb)
                    j = j[self.forest.label[j] != self.forest.label[i]]
                    self.take(np.full(len(j), i), j)
                continue
            k = np.arange(int(n.sum()))
            of = np.repeat(np.arange(len(n)), n)
            k -= np.repeat(np.cumsum(n) - n, n)
            wide = (g[3] - g[2])[of]
            self.take(g[0][of] + k // wide, g[2][of] + k % wide)


def by_group(rows: DataFrame, keys: list[str], link: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links (a, b), a > b, that ``link`` finds in each group of two ``rows`` or more, given its columns.

    Rows are dealt out and sorted by ``keys``; a worker holds one group and one batch.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found = None, []

        def done(g: pd.DataFrame, last: bool) -> int:
            change = np.zeros(len(g), bool)
            for k in keys:
                v = g[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change), [len(g)]])
            upto = len(starts) - (1 if last else 2)
            columns = {c: g[c].to_numpy() for c in g.columns}
            for s in np.flatnonzero(np.diff(starts[: upto + 1]) > 1):
                found.append(link({c: v[starts[s] : starts[s + 1]] for c, v in columns.items()}))
            return starts[upto]

        def frame() -> pd.DataFrame:
            a = np.concatenate([x for x, _ in found])
            b = np.concatenate([y for _, y in found])
            found.clear()
            return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

        for g in it:
            if not len(g):
                continue
            g = g if held is None else pd.concat([held, g], ignore_index=True)
            held = g.iloc[done(g, False) :]
            if len(found) > 1000:
                yield frame()
        if held is not None:
            done(held, True)
        if found:
            yield frame()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a bigint, b bigint").distinct()


def star(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of each component to its smallest id: where groups share a cluster, mostly the same links."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    to = least[label]
    out = np.flatnonzero(ids != to)
    return ids[out], to[out]


def bands(n: int, width: int, budget: int, ms: tuple[int, ...] = (1, 2, 3)) -> list[list[tuple[int, int]]]:
    """Sets of bands (from, to) of ``width`` bits, of which ``budget`` errors leave one set whole.

    Of budget + m bands at least m agree, and any m are a set. Taken is the one of
    ``ms`` by which ``n`` rows are copied least: once a set, and once a block of its
    buckets. A set has 32 bits at most.
    """
    found = []
    for m in ms:
        cuts = [width * k // (budget + m) for k in range(budget + m + 1)]
        cut = [(x, min(y, x + 32 // m)) for x, y in zip(cuts, cuts[1:])]
        sets = [list(s) for s in combinations(cut, m)]
        bits = min(sum(y - x for x, y in s) for s in sets)
        found.append((len(sets) * max(1, -(-n // (BUCKET << bits))), m, sets))
    return min(found)[2]


def links(keys: DataFrame, longs: list[str], width: int, budget: int, limit: int | None = None) -> DataFrame:
    """Spanning-forest links (a, b), a > b, of the distinct ids of ``keys`` (id, longs).

    ``longs`` hold fingerprints of ``width`` bits, from the top. Two ids are linked if
    one of these differs in ``budget`` bits or fewer, and all bits together in
    ``limit`` or fewer where that is given.
    """
    keys = common.cut(keys.select("id", *longs))
    n_keys = keys.count()
    per, mask = 64 // width, (1 << width) - 1
    sets = bands(n_keys, width, budget)
    buckets = []
    for i in range(per * len(longs)):
        for s, of in enumerate(sets):
            value = F.shiftleft(F.lit(i * len(sets) + s).cast("long"), 32 - sum(y - x for x, y in of))
            for x, y in of:
                part = F.shiftrightunsigned(longs[i // per], 64 - width * (i % per) - y).bitwiseAND(F.lit((1 << (y - x)) - 1))
                value = F.shiftleft(value, y - x).bitwiseOR(part)
            buckets.append(value)
    dealt = keys.select("id", *longs, F.explode(F.array(*buckets)).alias("bucket"))
    groups = ["bucket"]
    if n_keys > BUCKET:  # else no bucket can be larger
        sizes = dealt.groupBy(F.col("bucket").alias("b_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
        sizes = common.cut(sizes.select("b_key", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")))
        n_large = sizes.count()
        if n_large:
            dealt = dealt.join(common.small(sizes, n_large), F.col("bucket") == F.col("b_key"), "left")
            blocks = F.coalesce("blocks", F.lit(1))
            dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.select("id", *longs, "bucket", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
            groups = ["bucket", "p", "q"]

    def group(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i = int(g["bucket"][0] >> 32) // len(sets)
        fp = (g[longs[i // per]].view(np.uint64) >> np.uint64(64 - width * (i % per + 1))) & np.uint64(mask)
        order, second = np.argsort(fp, kind="stable"), None
        if "p" in g and g["p"][0] != g["q"][0]:
            of_q = g["block"] == g["q"][0]
            order = np.concatenate([order[~of_q[order]], order[of_q[order]]])
            second = int((~of_q).sum())
        bits = [g[c].view(np.uint64)[order] for c in longs]

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if limit is None:
                return np.ones(len(a), bool)
            return sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in bits) <= limit

        label = Walk(fp[order], width, budget, near, second).run()
        return star(g["id"][order], label)

    return by_group(dealt, groups, group)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): label is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the
    edges form stars; each step is an aggregation and a join on a node.
    """
    edges = common.cut(edges.select("a", "b"))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()

    seen = mark(edges)
    while seen[0]:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m0")).select(F.col("a").alias("u"), F.least("a", "m0").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # now every edge goes from a node to a smaller one
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.cut(small.union(low.select("u", "m")).filter("a <> b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )


def simhash_components(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text, ...).

    Null and wordless texts have fingerprint zero and link like any other. A
    component's id is its smallest non-null doc_id (null if it has none);
    repeated rows are all returned; no rows give no rows.
    """
    prints = fingerprints(docs, width)
    keys = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    label = components(links(keys.select(F.col("fp").alias("id"), F.col("fp").alias("s0")), ["s0"], 64, budget))
    named = keys.join(label, keys["fp"] == label["node"]).select("fp", "label", "least")
    root = named.groupBy("label").agg(F.min("least").alias("root")).withColumnRenamed("label", "r_label")
    moved = named.join(root, F.col("label") == F.col("r_label")).select(F.col("fp").alias("m_fp"), "root")
    own = F.when(F.col("m_fp").isNotNull(), F.col("root")).otherwise(F.col("least"))
    final = keys.join(moved, F.col("fp") == F.col("m_fp"), "left").select(F.col("fp").alias("k_fp"), own.alias("component_id"), "copies")
    final = common.cut(final)
    return common.join_hot(prints, final, "fp", "k_fp", "copies", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Near copies of the pipeline: an exact Jaccard similarity of 4/5 or more of the sets of five-word shingles.
NEAR_WIDTH, NEAR = 5, (4, 5)
#: Compared are texts of which some one of WORDS fingerprints differs in NEAR_BUDGET of WORD bits or fewer, and all in
#: NEAR_LIMIT or fewer. At a similarity of 0.8 a bit differs with a probability of 0.1515 at most (the angle between
#: sets of that similarity over pi), so 1 - 0.735^16 = 0.993 of pairs are compared; of 0.85, 0.9996; of 0.9, all but 2 in 10^6.
WORD, WORDS, NEAR_BUDGET, NEAR_LIMIT = 32, 16, 3, 108
LONGS = [f"s{k}" for k in range(WORD * WORDS // 64)]
#: Sets and shingles of a block: two blocks at most are compared in one task.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
_random = np.random.default_rng(SEED)
MIX = _random.integers(0, 1 << 63, len(LONGS), dtype=np.uint64)
ODD = _random.integers(0, 1 << 63, len(LONGS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes | None, width: int = NEAR_WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (all words together if there are fewer); empty without words."""
    w = words(data)
    if not w:
        return np.empty(0, np.uint64)
    hashed = np.array([xxhash.xxh3_64_intdigest(x, SEED) for x in w], np.uint64)
    width = min(width, len(w))
    out = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ hashed[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set in ``LONGS``: of each bit, whether over half of the set's members have it."""
    ones = np.zeros(64 * len(LONGS), np.int64)
    for at in range(0, len(shingles), CHUNK):
        x = (shingles[at : at + CHUNK, None] ^ MIX) * ODD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(2 * ones > len(shingles)).tobytes(), ">i8").astype(np.int64)


def similar(sets: list[np.ndarray], near: tuple[int, int] = NEAR, seed: np.ndarray | None = None) -> np.ndarray:
    """A label of each set, its component under Jaccard similarities of ``near`` or more; sets aren't empty.

    Sets of one ``seed`` are linked as they are. All pairs of different components
    are compared, pairs of one only as far as needed.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    seen, of = np.unique(np.concatenate(sets), return_inverse=True)
    label, rest = np.arange(n), np.arange(n)
    seed = np.arange(n) if seed is None else seed
    while len(rest):
        root = rest[0]
        own = seed[rest] == seed[root]
        queue, rest = rest[own].tolist(), rest[~own]
        label[queue] = root
        while queue and len(rest):
            k = queue.pop()
            has = np.zeros(len(seen), np.uint8)
            has[of[starts[k] : starts[k] + sizes[k]]] = 1
            shared = np.add.reduceat(has[of], starts, dtype=np.int64)[rest]
            close = near[1] * shared >= near[0] * (sizes[k] + sizes[rest] - shared)
            if close.any():
                more = np.isin(seed[rest], seed[rest[close]])
                label[rest[more]] = root
                queue += rest[more].tolist()
                rest = rest[~more]
    return label


def near_links(docs: DataFrame, keys: DataFrame, near: tuple[int, int] = NEAR, width: int = NEAR_WIDTH) -> DataFrame:
    """Links (a, b), a > b, that join those ids of ``keys`` (id, n, LONGS, least) whose texts are similar.

    Candidates fall into components. Texts of these are read again, by ``least``'s
    doc_id and text_key. Large components are cut into blocks: first each block is
    compared within itself and with one of them; then what that has not joined to
    the component's largest group is compared with all blocks.
    """
    cand = components(links(keys.filter("n > 0"), LONGS, WORD, NEAR_BUDGET, NEAR_LIMIT))
    some = keys.join(cand, keys["id"] == cand["node"]).select(
        F.col("id").alias("c_id"), "n", "label", F.col("least.doc_id").alias("c_doc"), F.col("least.text_key").alias("c_text")
    )
    some = common.cut(some)

    @F.pandas_udf("binary")
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).tobytes() for t in text], dtype=object)

    same = docs["doc_id"].eqNullSafe(some["c_doc"]) & (common.row_key(docs["text"]) == some["c_text"])
    again = docs.select("doc_id", "text").join(common.small(some.select("c_id", "c_doc", "c_text"), some.count()), same)
    sets = common.cut(again.select("c_id", shingles(docs["text"].cast("binary")).alias("shingles")).dropDuplicates(["c_id"]))
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sizes = common.cut(some.groupBy(F.col("label").alias("comp")).agg(F.ceil(size).cast("int").alias("blocks")).filter("blocks > 1"))
    n_large = sizes.count()
    met = some.select("c_id", "label").join(common.small(sizes, n_large), F.col("label") == F.col("comp"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    met = common.cut(met.select("c_id", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("c_id"), blocks).cast("int").alias("block")))

    def group(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, first = np.unique(g["c_id"], return_index=True)
        label = similar([np.frombuffer(g["shingles"][i], np.uint64) for i in first], near, g["seed"][first] if "seed" in g else None)
        return star(ids, label)

    def compared(dealt: DataFrame, groups: list[str]) -> DataFrame:
        dealt = dealt.withColumnRenamed("c_id", "d_id")
        full = dealt.join(sets, F.col("d_id") == F.col("c_id")).drop("d_id")
        return by_group(full, groups, group)

    # the first block meets every block
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = met.select("c_id", "label", F.explode(F.when(F.col("block") == 0, all_blocks).otherwise(F.array("block"))).alias("p"))
    found = common.cut(compared(dealt, ["label", "p"]))
    if not n_large:
        return found
    large = met.filter("blocks > 1").join(components(found).select(F.col("node").alias("f_node"), F.col("label").alias("joined")), F.col("c_id") == F.col("f_node"), "left")
    large = common.cut(large.select("c_id", "label", "blocks", "block", F.coalesce("joined", "c_id").alias("seed")))
    counts = large.groupBy("label", "seed").agg(F.count(F.lit(1)).alias("k"))
    top = counts.groupBy(F.col("label").alias("t_label")).agg(F.max_by("seed", "k").alias("t_seed"), (F.sum("k") - F.max("k")).alias("rest"))
    top = common.cut(top.select("t_label", "t_seed", F.ceil(F.col("rest") / BLOCK).cast("int").alias("r_blocks")).filter("r_blocks > 0"))
    left = common.cut(large.join(common.small(top, top.count()), F.col("label") == F.col("t_label")))
    r_block = F.pmod(F.xxhash64("c_id", F.lit(1)), F.col("r_blocks")).cast("int").alias("p")
    outside = left.filter("seed <> t_seed").select("c_id", "label", "seed", r_block, F.explode(all_blocks).alias("q"))
    everyone = left.select("c_id", "label", "seed", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)).alias("p"), F.col("block").alias("q"))
    return found.union(compared(outside.union(everyone), ["label", "p", "q"]))


def near_duplicates(docs: DataFrame, near: tuple[int, int] = NEAR, width: int = NEAR_WIDTH) -> DataFrame:
    """(doc_id, text_key, group_id, keep) of each row of ``docs``.

    Groups are components of links between documents whose sets of word shingles
    have a Jaccard similarity of ``near`` or more. ``keep`` marks the smallest
    (doc_id, text_key) of a group, rows without id last. Null texts and texts
    without words are copies of each other; of repeated rows all have the same
    marks; no rows give no rows; texts are used whole, however long.
    """

    @F.pandas_udf(", ".join(["h binary, n bigint", *(f"{c} bigint" for c in LONGS)]))
    def prints(text: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in text]
        bits = np.array([signature(s) for s in sets], np.int64).reshape(len(sets), len(LONGS))
        out = {"h": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": np.array([len(s) for s in sets], np.int64)}
        return pd.DataFrame(out | {c: bits[:, k] for k, c in enumerate(LONGS)})

    rows = docs.select(
        docs["doc_id"].alias("doc_id"), common.row_key(docs["text"]).alias("text_key"), prints(docs["text"].cast("binary")).alias("p")
    )
    rows = common.cut(rows.select("doc_id", "text_key", "p.*"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    # one key a set, by 128 bits; numbers of keys are theirs from here on, as they are written
    keys = rows.groupBy("h").agg(*[F.max(c).alias(c) for c in ["n", *LONGS]], first, F.count(F.lit(1)).alias("copies"))
    keys = common.cut(keys.withColumn("id", F.monotonically_increasing_id()))
    label = components(near_links(docs, keys, near, width))
    named = keys.join(label, keys["id"] == label["node"], "left").select(
        F.col("h").alias("n_h"), F.coalesce("label", "id").alias("group_id"), "least", "copies"
    )
    named = common.cut(named)
    best = named.groupBy(F.col("group_id").alias("b_id")).agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("members"))
    of = common.join_hot(named, common.cut(best), "group_id", "b_id", "members", named.count())
    of = common.cut(of.select("n_h", "group_id", "best", "copies"))
    out = common.join_hot(rows, of, "h", "n_h", "copies", rows.count())
    keep = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select("doc_id", "text_key", "group_id", keep.alias("keep"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies; columns as they are.

    Of repeated rows (one id, one text) one stays as well.
    """
    found = near_duplicates(docs).groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).agg(
        F.bool_or("keep").alias("keep"), F.count(F.lit(1)).alias("n")
    )
    found = common.cut(found.filter("not keep or n > 1"))
    gone, twice = found.filter("not keep"), found.filter("keep")
    n_gone, n_twice = gone.count(), twice.count()
    kept = common.drop_keys(docs, gone, n_gone)
    if not n_twice:
        return kept
    same = kept["doc_id"].eqNullSafe(twice["k_id"]) & (common.row_key(kept["text"]) == twice["k_text"])
    once = kept.join(common.small(twice, n_twice), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return common.drop_keys(kept, twice, n_twice).unionByName(once)
