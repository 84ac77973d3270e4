"""Mixing sources to target weights by capped water-filling.

The word budget is shared by weight; a source stops at ``max_epochs`` times its
size and what it can't take goes to the others by weight, until none is above
its cap. The level is found in closed form over sources sorted by cap / weight.

Each document is then taken floor(target / size) times, and once more if it
stands before the point, in a seeded order, at which the rest of its source's
target is reached. The point is found by radix selection on the order's hash
(1,024 cells a level), so no source is ever sorted or gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """52 bits that order documents by id and text, so that rows of one id or none are spread; null counts as the empty string."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: dict[str | None, float] | None, budget: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target, whole, need) of (source, source_size).

    One row a source goes through one task: sources are what a mix gives weights
    to, not keys of data.
    """
    if weights is None:
        at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (at % len(WEIGHTS) + 1).cast("int"))
        t = sizes.withColumn("w", w)
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
        t = sizes.withColumn("w", w)
    everything = Window.partitionBy()
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn(
        "ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
    )
    t = t.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(budget),
            "cap_before": F.sum("cap").over(level) - F.col("cap"),
            "w_left": F.sum("w").over(everything) - F.sum("w").over(level) + F.col("w"),
        }
    )
    t = t.withColumn(
        "fits",
        (F.col("w") > 0) & ((F.col("total") - F.col("cap_before")) * F.col("w") <= F.col("cap") * F.col("w_left")),
    )
    share = F.min(
        F.when(F.col("fits"), F.struct("ratio", ((F.col("total") - F.col("cap_before")) / F.col("w_left")).alias("x")))
    ).over(everything)["x"]
    t = t.withColumn("share", share)
    target = F.when(F.col("w") <= 0, F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.col("cap"), F.col("share") * F.col("w")), F.col("cap"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return t.select("source", "source_size", target.alias("target"), whole.alias("whole")).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size")
    )


def plan(sized: DataFrame, weights: dict | None, budget: float, max_epochs: float) -> DataFrame:
    """Per source its target and the last order key that gets one more repetition.

    ``sized`` has doc_id, source, u, size.
    """
    cells = common.cut(
        sized.groupBy("source", F.shiftright("u", 42).alias("c1")).agg(F.sum("size").alias("n"))
    )
    per_source = targets(
        cells.groupBy("source").agg(F.sum("n").alias("source_size")), weights, budget, max_epochs
    )
    per_source = common.cut(per_source)
    goal = per_source.select(F.col("source").alias("g_source"), "need").filter("need > 0")

    def boundary(cells: DataFrame, goal: DataFrame, c: str) -> DataFrame:
        run = Window.partitionBy("source").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        before = cells.withColumn("b", F.sum("n").over(run) - F.col("n"))
        before = before.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).filter("b <= need")
        return before.groupBy("g_source").agg(
            F.max_by(F.struct(F.col(c).alias("c"), (F.col("need") - F.col("b")).alias("rest")), c).alias("m")
        )

    one = boundary(cells, goal, "c1").select("g_source", F.col("m.c").alias("b1"), F.col("m.rest").alias("need"))
    in_one = sized.join(
        one.select(F.col("g_source").alias("o_source"), "b1"),
        F.col("source").eqNullSafe(F.col("o_source")) & (F.shiftright("u", 42) == F.col("b1")),
    ).select("doc_id", "source", "u", "size", F.shiftright("u", 32).alias("c2"))
    in_one = common.cut(in_one)
    two = boundary(
        in_one.groupBy("source", "c2").agg(F.sum("size").alias("n")), one.drop("b1"), "c2"
    ).select(F.col("g_source").alias("t_source"), F.col("m.c").alias("b2"), F.col("m.rest").alias("rest"))
    last = in_one.join(two, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("c2") == F.col("b2")))
    run = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("b", F.sum("size").over(run) - F.col("size")).filter(F.col("b") + F.col("size") / 2 <= F.col("rest"))
    key = last.groupBy("source").agg(F.max(F.struct("u", "doc_id", "size")).alias("last")).withColumnRenamed(
        "source", "k_source"
    )
    ends = two.join(key, F.col("t_source").eqNullSafe(F.col("k_source")), "left").select("t_source", "b2", "last")
    return per_source.join(ends, F.col("source").eqNullSafe(F.col("t_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", "b2", "last"
    )


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
    keep: bool = False,
) -> DataFrame:
    """Repetitions of each row of ``docs`` (doc_id, text, source, ...).

    Returns doc_id, source, size (words), source_size, target, repetitions and
    taken (size times repetitions); with ``keep`` instead the columns of ``docs``,
    each row as many times as it is taken. Without ``weights`` sources weigh 5, 2,
    1, repeating in order of their names, null last. Null texts have size 0;
    null sources are one source; repeated rows are rows of their own (of rows with
    one id and text all or none get the extra repetition); no rows give no rows.
    """
    base = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        order_hash(docs["doc_id"], docs["text"], seed).alias("u"),
        word_count(docs["text"]).alias("size"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []),
    )
    sized = common.cut(base.select("doc_id", "source", "u", "size"))
    per_source = common.cut(plan(sized, weights, budget, max_epochs))
    n = per_source.count()
    rows = base if keep else sized
    rows = rows.join(common.small(per_source, n), F.col("source").eqNullSafe(F.col("p_source")), "left")
    more = F.col("b2").isNotNull() & (
        (F.shiftright("u", 32) < F.col("b2"))
        | ((F.shiftright("u", 32) == F.col("b2")) & F.col("last").isNotNull() & (F.struct("u", "doc_id", "size") <= F.col("last")))
    )
    reps = (F.col("whole") + F.when(more, F.lit(1)).otherwise(F.lit(0))).cast("long")
    if keep:
        names = list(dict.fromkeys(docs.columns))
        times = rows.withColumn("reps", reps).filter("reps > 0")
        return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps"))).alias("copy")).select(
            *[F.col("row").getField(c).alias(c) for c in names]
        )
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", reps.alias("repetitions"), (reps * F.col("size")).alias("taken")
    )
