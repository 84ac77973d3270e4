"""Exact top-k inner products over norm-sorted blocks.

Vectors are put in order of descending length, in ranges, and cut into blocks that
stay where they are. Queries come to them in rounds of at most ``QUERIES``, by
broadcast. The longest block gives each query of a round a threshold, its k-th best
score there; a block counts only for queries whose length times the block's longest
reaches the threshold. Within a block the first rotated coordinates give partial
sums; Cauchy-Schwarz on what is left prunes all but a few candidates, which are
scored exactly in integers, and a task's thresholds rise as it finds better ones.
The rotation comes from the SVD of a bounded sample and moves most of the length
into the first coordinates; any rotation gives the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 5
EVERY = 50
#: Vectors in a block of candidates and in a round of queries; vectors that the rotation is fitted on.
BLOCK, QUERIES, SAMPLE = 4096, 8192, 4096
#: Queries of a round that meet a block at once, and pairs that are scored at once.
STEP, PAIRS = 512, 1 << 16
#: Share of pairs left by the bounds from which a block is scored by one product; integers to EXACT are exact in float64.
DENSE, EXACT = 0.02, 2.0**52

PACKED = "longest double, n int, ids binary, vecs binary"


def packed(it: Iterator[pd.DataFrame], per: int, dims: int) -> Iterator[pd.DataFrame]:
    """Runs of ``per`` vectors (id, v), in the order they come in, one row each."""

    def row(ids: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        longest = np.sqrt((v.astype(float) ** 2).sum(axis=1).max())
        return pd.DataFrame({"longest": [longest], "n": [len(ids)], "ids": [ids.tobytes()], "vecs": [v.tobytes()]})

    ids, vecs = np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
    for g in it:
        v = np.zeros((len(g), dims), np.int64)
        for i, x in enumerate(g["v"]):
            v[i, : len(x)] = x
        ids, vecs = np.concatenate([ids, g["id"].to_numpy(np.int64)]), np.concatenate([vecs, v])
        while len(ids) >= per:
            yield row(ids[:per], vecs[:per])
            ids, vecs = ids[per:], vecs[per:]
    if len(ids):
        yield row(ids, vecs)


def unpacked(ids: bytes, vecs: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.int64).reshape(-1, dims)


def rotation(sample: np.ndarray, dims: int) -> np.ndarray:
    """Orthogonal matrix (singular vectors of the sample) whose first columns carry most of the sample's length."""
    if not len(sample):
        return np.eye(dims)
    return np.linalg.svd(sample.T @ sample)[0]


class Search:
    """The best ``k`` of the blocks seen so far for each query of a round, of those that reach ``low``."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.low, self.turn, self.k = ids, q, low.copy(), turn, k
        self.head = max(1, q.shape[1] // 4)
        self.qf = q @ turn
        self.rest = np.sqrt((self.qf[:, self.head :] ** 2).sum(axis=1))
        self.len = np.sqrt((self.qf**2).sum(axis=1))
        self.at = np.zeros(0, np.int64)
        self.got_id, self.got = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def block(self, ids: np.ndarray, c: np.ndarray, longest: float) -> None:
        reach = np.flatnonzero(self.len * longest * (1 + 1e-9) + 1e-6 >= self.low)
        if not len(reach):
            return
        exact = float(self.len.max()) * longest < EXACT
        cf = c @ self.turn
        rest = np.sqrt((cf[:, self.head :] ** 2).sum(axis=1))
        for s in range(0, len(reach), STEP):
            r = reach[s : s + STEP]
            most = self.qf[r, : self.head] @ cf[:, : self.head].T + self.rest[r, None] * rest[None, :]
            slack = 1e-9 * (1 + self.len[r] * longest)
            open_ = most + slack[:, None] >= self.low[r, None]
            if exact and open_.mean() > DENSE:  # one product of what is left, exact as its sums are integers of a float's reach
                some = np.flatnonzero(open_.any(axis=0))
                score = self.q[r].astype(float) @ c[some].astype(float).T
                i, at = np.nonzero(open_[:, some] & (score >= self.low[r, None]))
                keep = self.ids[r[i]] != ids[some[at]]
                i, at = i[keep], at[keep]
                self.keep(r[i], ids[some[at]], score[i, at].astype(np.int64))
                continue
            i, j = np.nonzero(open_)
            i = r[i]
            other = self.ids[i] != ids[j]
            i, j = i[other], j[other]
            for p in range(0, len(i), PAIRS):
                a, b = i[p : p + PAIRS], j[p : p + PAIRS]
                # sums wrap, so a score that fits a long is right whatever its parts are
                self.keep(a, ids[b], np.einsum("nd,nd->n", self.q[a], c[b]))

    def keep(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        better = score >= self.low[at]
        at, ids, score = at[better], ids[better], score[better]
        if not len(at):
            return
        at, ids, score = np.concatenate([self.at, at]), np.concatenate([self.got_id, ids]), np.concatenate([self.got, score])
        order = np.lexsort((ids, ~score, at))  # ~ turns integers round without overflow
        at, ids, score = at[order], ids[order], score[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        last = rank == self.k - 1
        # a float a little below the k-th best: nothing that ties with it is lost
        self.low[at[last]] = np.maximum(self.low[at[last]], score[last] - np.abs(score[last]) * 1e-12 - 1e-6)
        top = rank < self.k
        self.at, self.got_id, self.got = at[top], ids[top], score[top]


def thresholds(ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best score among ``c``; -inf if there are fewer."""
    low = np.full(len(q), -np.inf)
    qf, cf = q.astype(float), c.astype(float)
    lengths = np.sqrt((qf**2).sum(axis=1)) * np.sqrt((cf**2).sum(axis=1).max(initial=0))
    for s in range(0, len(q), STEP):
        part = qf[s : s + STEP] @ cf.T
        part[ids[s : s + STEP, None] == c_ids[None, :]] = -np.inf
        if part.shape[1] >= k:
            low[s : s + STEP] = np.partition(part, -k, axis=1)[:, -k]
    return low - 1e-9 * (1 + lengths)


def vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(id, v, norm2): integer vectors floor(scale * x) that hold no null and no non-finite component."""
    x = F.transform(table["embedding"], lambda e: e.cast("double"))
    ok = table["vec_id"].isNotNull() & table["embedding"].isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    )
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    rows = table.filter(ok).select(table["vec_id"].alias("id"), v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return rows.withColumn("norm2", norm2)


def top_k(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best inner products of each query with every other vector.

    Queries are the rows whose vec_id is divisible by ``every``. Ties go to the
    smaller vec_id. Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part; shorter vectors count as padded with
    zeros. A query is not its own candidate (by id); a repeated row is a candidate
    and a query of its own, so its results are repeated. Scores must fit a long.
    Other columns are ignored. No vectors give no rows.
    """
    spark = table.sparkSession
    rows = vectors(table)
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    found_schema = "query_id bigint, q_row bigint, vec_id bigint, score bigint"
    if not n or not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toPandas()["v"]
    fit = np.zeros((len(sample), dims))
    for i, x in enumerate(sample):
        fit[i, : len(x)] = x
    turn = rotation(fit, dims)

    per_block, per_round = BLOCK, QUERIES
    # a task has some blocks of a large table, and one of a table that would leave cores idle
    parts = max(1, -(-n // (8 * per_block)), min(-(-n // per_block), spark.sparkContext.defaultParallelism))
    ranged = rows.repartitionByRange(parts, F.desc("norm2"), F.col("id")).sortWithinPartitions(F.desc("norm2"), "id").select("id", "v")
    cand = common.cut(ranged.mapInPandas(lambda it: packed(it, per_block, dims), PACKED))
    ask = rows.filter(F.col("id") % every == 0)
    n_ask = ask.count()
    ask = ask.repartition(max(1, -(-n_ask // (4 * per_round))), "id").select("id", "v").mapInPandas(lambda it: packed(it, per_round, dims), PACKED)
    asked = common.cut(ask.withColumn("part", F.monotonically_increasing_id()))
    rounds: list[list[int]] = []  # parts of a round: ``QUERIES`` at most, however the parts fell
    held = per_round
    for part, size in asked.select("part", "n").orderBy("part").collect():  # a number for each task's rest and each full round
        if held + size > per_round:
            rounds.append([])
            held = 0
        rounds[-1].append(part)
        held += size
    if not rounds:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    longest = cand.orderBy(F.desc("longest")).select("ids", "vecs").first()
    head = unpacked(longest["ids"], longest["vecs"], dims)

    def one_round(number: int) -> DataFrame:
        got = [unpacked(r["ids"], r["vecs"], dims) for r in asked.filter(F.col("part").isin(rounds[number])).orderBy("part").collect()]
        ids, q = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        sent = spark.sparkContext.broadcast((ids, q, thresholds(ids, q, *head, k), turn))
        first = number * per_round

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, low, turn = sent.value
            search = Search(ids, q, low, turn, k)
            for g in it:
                for c_ids, vecs, reach in zip(g["ids"], g["vecs"], g["longest"], strict=True):
                    search.block(*unpacked(c_ids, vecs, dims), reach)
            yield pd.DataFrame({"query_id": ids[search.at], "q_row": first + search.at, "vec_id": search.got_id, "score": search.got})

        found = cand.select("ids", "vecs", "longest").mapInPandas(run, found_schema)
        if len(rounds) > 1:  # else the plan would hold all rounds
            found = common.cut(found)
        return found

    found = one_round(0)
    for number in range(1, len(rounds)):
        found = found.unionByName(one_round(number))
    # at most k rows of each query and task reach this; keep k of a query
    best = found.groupBy("q_row", "query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k).alias("top")
    )
    return best.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
