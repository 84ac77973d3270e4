"""First-order context models and frequency normalisation as aggregations.

Model states are tables of cells ``(keys..., prev, next, cnt)`` that hold only
counts of pairs seen; the prior of one a training batch is added by arithmetic
(``batches``), so states merge by summing and stay sparse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 32
TOTAL = 1 << 24
ALPHABET = 256


def pairs(syms: DataFrame, keys: list[str], value: str = "sym") -> DataFrame:
    """(keys, prev, next) of neighbouring symbols; pairs don't cross blobs."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return syms.select(*keys, F.lag(value).over(w).alias("prev"), F.col(value).alias("next")).filter("prev is not null")


def pairs_of_arrays(df: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """As ``pairs``, from an array of symbols in one row: no shuffle before the counts."""
    both = F.arrays_zip(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))).alias("prev"), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))).alias("next"))
    return df.select(*keys, F.explode(both).alias("p")).select(*keys, "p.prev", "p.next")


def train(pairs_: DataFrame, keys: list[str], step: int = STEP) -> DataFrame:
    """Cells of the pairs seen, ``step`` each; one hash aggregation with partial sums."""
    return pairs_.groupBy(*keys, "prev", "next").agg((F.count(F.lit(1)) * step).alias("cnt"))


def merge(*cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of model states."""
    all_ = cells[0]
    for c in cells[1:]:
        all_ = all_.unionByName(c)
    return all_.groupBy(*keys, "prev", "next").agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0")


def update(cells: DataFrame, keys: list[str], changes: DataFrame, op: str) -> DataFrame:
    """Adds (``update``), takes off (``revert``) or sets (``set``) cells of ``changes`` (keys, prev, next, delta)."""
    at = [*keys, "prev", "next"]
    if op == "set":
        last = changes.groupBy(*at).agg(F.max("delta").alias("cnt"))
        return cells.join(last.select(*at), at, "left_anti").unionByName(last)
    sign = {"update": 1, "revert": -1}[op]
    return merge(cells, changes.select(*at, (F.col("delta") * sign).alias("cnt")), keys=keys)


def dense(cells: DataFrame, keys: list[str], batches: Column | int = 1) -> DataFrame:
    """All 256 cells of the contexts that occur, each with the prior of one a batch."""
    rows = cells.groupBy(*keys, "prev").agg(F.map_from_entries(F.collect_list(F.struct("next", "cnt"))).alias("m"))
    prior = batches if isinstance(batches, Column) else F.lit(batches)
    full = rows.select(*keys, "prev", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(ALPHABET - 1)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0)) + prior)).alias("next", "cnt"))
    return full


def normalise(counts: DataFrame, keys: list[str], symbol: str = "next", plus: int = 0) -> DataFrame:
    """(keys, symbol, ls, bs) of dense ``counts`` (keys, symbol, cnt): frequencies that sum to 2^24, and running sums.

    ``plus`` 0 scales counts as they are (context models), 1 counts plus one
    (adaptive tables). What rounding leaves goes to the first symbols in turn.
    """
    row = Window.partitionBy(*keys)
    c = F.col("cnt").cast("long") + plus
    total = F.greatest(F.sum(c).over(row), F.lit(1))
    v = counts.withColumn("_t", total).withColumn("_v", F.expr(f"1 + ((cnt + {plus}) * {TOTAL - ALPHABET}) div _t"))
    v = v.withColumn("_r", F.lit(TOTAL) - F.sum("_v").over(row))
    v = v.withColumn("ls", F.expr(f"_v + _r div {ALPHABET} + if({symbol} < _r % {ALPHABET}, 1, 0)").cast("long"))
    before = Window.partitionBy(*keys).orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return v.select(*keys, symbol, "ls", F.coalesce(F.sum("ls").over(before), F.lit(0)).cast("long").alias("bs"))


def inverse_lookup(points: DataFrame, model: DataFrame, keys: list[str], symbol: str = "next") -> DataFrame:
    """Symbol of each point (keys, point): the last whose running sum is at most the point.

    An as-of join: points and cells are put in one order per context.
    """
    cells = model.select(*keys, F.col("bs").alias("at"), F.col(symbol).alias("s"), F.lit(None).cast("long").alias("point"), F.lit(0).alias("kind"))
    asked = points.select(*keys, F.col("point").alias("at"), F.lit(None).cast("int").alias("s"), F.col("point").cast("long").alias("point"), F.lit(1).alias("kind"))
    order = Window.partitionBy(*keys).orderBy("at", "kind", "s").rowsBetween(Window.unboundedPreceding, 0)
    both = cells.unionByName(asked).withColumn(symbol, F.last("s", ignorenulls=True).over(order))
    return both.filter("kind = 1").select(*keys, "point", symbol)


def raster_of_arrays(df: DataFrame, keys: list[str], values: Column, width: int) -> DataFrame:
    """(keys, x, y, v, left, up, diag): pixels and their neighbours of arrays of samples, ``width`` in a row, without a shuffle.

    What is made of pixels elsewhere in this module takes the neighbours from here where they are there.
    """
    p = df.select(*keys, values.alias("s")).select(*keys, "s", F.posexplode("s").alias("pos", "v"))
    x, at = F.col("pos") % width, F.col("pos")
    inner = lambda back: F.when(x > 0, F.get("s", at - back))  # noqa: E731  null outside
    return p.select(*keys, x.alias("x"), F.expr(f"cast(pos div {width} AS int)").alias("y"), "v", inner(1).alias("left"), F.get("s", at - width).alias("up"), inner(width + 1).alias("diag"))


def _neighbours(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Adds left, up and upper-left values, if they aren't there; one shuffle by row and one by column of a plane."""
    if {"left", "up", "diag"} <= set(pixels.columns):
        return pixels
    row = Window.partitionBy(*keys, "y").orderBy("x")
    col = Window.partitionBy(*keys, "x").orderBy("y")
    a = pixels.withColumns({"left": F.lag("v").over(row)})
    return a.withColumns({"up": F.lag("v").over(col), "diag": F.lag("left").over(col)})


def paeth_residual(pixels: DataFrame, keys: list[str], bits: int = 8) -> DataFrame:
    """Adds residual: value minus the nearest of left, up, upper left to |left + up - upper left|, modulo 2^bits."""
    n = _neighbours(pixels, keys)
    d = F.abs(F.col("left") + F.col("up") - F.col("diag"))
    a, b, c = (F.abs(F.col(x) - d) for x in ("left", "up", "diag"))
    near = F.when((a <= b) & (a <= c), F.col("left")).when(b <= c, F.col("up")).otherwise(F.col("diag"))
    pred = F.when(F.col("left").isNull(), F.coalesce("up", F.lit(0))).when(F.col("up").isNull(), F.col("left")).otherwise(near)
    return n.withColumn("residual", F.pmod(F.col("v") - pred, F.lit(1 << bits)).cast("int")).drop("left", "up", "diag")


def paeth_predict(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Adds predicted: the nearest of up, left, upper left (ties in this order) to up + left - upper left, signed."""
    n = _neighbours(pixels, keys)
    d = F.col("up") + F.col("left") - F.col("diag")
    a, b, c = (F.abs(F.col(x) - d) for x in ("up", "left", "diag"))
    near = F.when((a <= b) & (a <= c), F.col("up")).when(b <= c, F.col("left")).otherwise(F.col("diag"))
    pred = F.when(F.col("left").isNull(), F.coalesce("up", F.lit(0))).when(F.col("up").isNull(), F.col("left")).otherwise(near)
    return n.withColumn("predicted", pred.cast("int")).drop("left", "up", "diag")


def initial(n: int = ALPHABET) -> Column:
    """The distribution before anything is seen: one each."""
    return F.array_repeat(F.lit(1).cast("long"), n)


def _context(pixels: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Adds ctx: the left neighbour, else with ``order`` above one the upper one, else null."""
    if {"left", "up", "diag"} <= set(pixels.columns):
        return pixels.withColumn("ctx", F.coalesce("left", "up") if order > 1 else F.col("left")).drop("left", "up", "diag")
    left = F.lag("v").over(Window.partitionBy(*keys, "ch", "y").orderBy("x"))
    if order < 2:
        return pixels.withColumn("ctx", left)
    up = F.lag("v").over(Window.partitionBy(*keys, "ch", "x").orderBy("y"))
    return pixels.withColumns({"_l": left, "_u": up}).withColumn("ctx", F.coalesce("_l", "_u")).drop("_l", "_u")


def locality_counts(pixels: DataFrame, keys: list[str], order: int = 2) -> DataFrame:
    """(ch, prev, next, cnt): how often a value follows its context, by channel, over all images (keys, ch, y, x, v)."""
    p = _context(pixels, keys, order).filter("ctx is not null")
    return p.groupBy("ch", F.col("ctx").alias("prev"), F.col("v").alias("next")).agg(F.count(F.lit(1)).alias("cnt"))


def inject(counts: DataFrame) -> DataFrame:
    """(ch, prev, next, ls, bs): a static model of ``counts`` (ch, prev, next, cnt), at most 65,536 rows a channel."""
    return normalise(dense(counts, ["ch"], 0), ["ch", "prev"], "next", plus=1)


def inject_order0(counts: DataFrame) -> DataFrame:
    """(ch, next, ls, bs): the same of counts (ch, next, cnt) without context."""
    full = dense(counts.withColumn("prev", F.lit(0)), ["ch"], 0)
    return normalise(full, ["ch", "prev"], "next", plus=1).drop("prev")


def static_precode(pixels: DataFrame, model: DataFrame, keys: list[str], order: int = 2, residuals: DataFrame | None = None) -> DataFrame:
    """Adds (ls, bs) to pixels (keys, ch, y, x, v) from an injected model; uniform without context.

    With ``residuals``, an order-0 model, also (r_ls, r_bs) of a column r, the low
    bytes of deep samples. Models are a row a (channel, context, symbol): broadcast.
    """
    m = model.select(F.col("ch").alias("m_ch"), F.col("prev").alias("m_ctx"), F.col("next").alias("m_v"), "ls", "bs")
    p = _context(pixels, keys, order)
    p = p.join(F.broadcast(m), (F.col("ch") == F.col("m_ch")) & (F.col("ctx") == F.col("m_ctx")) & (F.col("v") == F.col("m_v")), "left").drop("m_ch", "m_ctx", "m_v")
    p = p.withColumns({"bs": F.coalesce("bs", F.shiftleft(F.col("v").cast("long"), 16)), "ls": F.coalesce("ls", F.lit(1 << 16).cast("long"))})
    if residuals is None:
        return p
    r = residuals.select(F.col("ch").alias("m_ch"), F.col("next").alias("m_v"), F.col("ls").alias("r_ls"), F.col("bs").alias("r_bs"))
    return p.join(F.broadcast(r), (F.col("ch") == F.col("m_ch")) & (F.col("r") == F.col("m_v")), "left").drop("m_ch", "m_v")
