"""Reversible colour transforms as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput


def lift(x: Column, y: Column, bits: int | None) -> tuple[Column, Column]:
    """(average, difference) of two samples; modulo 2^bits unless ``bits`` is None."""
    diff = _mask(y - x, bits)
    return _mask(x + F.shiftright(diff, 1), bits), diff


def unlift(avg: Column, diff: Column, bits: int | None) -> tuple[Column, Column]:
    x = _mask(avg - F.shiftright(diff, 1), bits)
    return x, _mask(x + diff, bits)


def _mask(v: Column, bits: int | None) -> Column:
    return v if bits is None else v.bitwiseAND(F.lit((1 << bits) - 1))


def ycocg(r: Column, g: Column, b: Column, bits: int | None = 8) -> tuple[Column, Column, Column]:
    """(Y, Co, Cg) of a pixel."""
    tmp, co = lift(r, b, bits)
    y, cg = lift(g, tmp, bits)
    return y, co, cg


def rgb(y: Column, co: Column, cg: Column, bits: int | None = 8) -> tuple[Column, Column, Column]:
    g, tmp = unlift(y, cg, bits)
    r, b = unlift(tmp, co, bits)
    return r, g, b


def transform(pixels: DataFrame, to: str = "ycocg", bits: int | None = 8, names: tuple[str, str, str] = ("c0", "c1", "c2")) -> DataFrame:
    """Replaces three channel columns; any fourth is left alone. ``to`` is "ycocg" or "rgb"."""
    turn = {"ycocg": ycocg, "rgb": rgb}.get(to)
    if turn is None:
        raise InvalidInput(f"undefined colour transform {to!r}")
    # one projection a lift: later steps read columns instead of repeating expressions
    a, b, c = (F.col(n) for n in names)
    if to == "ycocg":
        t, co = lift(a, c, bits)
        step = pixels.withColumns({"_t": t, "_d": co})
        y, cg = lift(F.col(names[1]), F.col("_t"), bits)
        step = step.withColumns({"_y": y, "_g": cg})
        return step.withColumns({names[0]: F.col("_y"), names[1]: F.col("_d"), names[2]: F.col("_g")}).drop("_t", "_d", "_y", "_g")
    g, t = unlift(a, c, bits)
    step = pixels.withColumns({"_g": g, "_t": t})
    r, bl = unlift(F.col("_t"), F.col(names[1]), bits)
    step = step.withColumns({"_r": r, "_b": bl})
    return step.withColumns({names[0]: F.col("_r"), names[1]: F.col("_g"), names[2]: F.col("_b")}).drop("_g", "_t", "_r", "_b")
