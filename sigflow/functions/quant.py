"""Rounding rules and scale algebra as column expressions.

R1 half away from zero, R2 truncation, R3 half to even, R4 half up before an
arithmetic shift, R5 plain arithmetic shift, R6 float to eight bits.
Every integer result is a bigint clipped to the given width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _limits(bits: int) -> tuple[float, float]:
    return float(-(1 << (bits - 1))), float((1 << (bits - 1)) - 1)


def _scaled(x: Column, scale: float, bits: int) -> Column:
    return x.cast("double") / F.lit(float(scale)) * F.lit(float(1 << (bits - 1)))


def _clip(y: Column, bits: int) -> Column:
    lo, hi = _limits(bits)
    return F.least(F.greatest(y, F.lit(lo)), F.lit(hi))


def round_away(x: Column, scale: float, bits: int) -> Column:
    """R1."""
    y = _scaled(x, scale, bits)
    return _clip(y + F.signum(y) * 0.5, bits).cast("bigint")


def truncate(x: Column, scale: float, bits: int) -> Column:
    """R2."""
    return _clip(_scaled(x, scale, bits), bits).cast("bigint")


def half_even(x: Column, scale: float, bits: int) -> Column:
    """R3: clip, then round."""
    return F.rint(_clip(_scaled(x, scale, bits), bits)).cast("bigint")


def to_int8(x: Column, factor: float) -> Column:
    """R6: scale in single precision, round half away, clip to eight bits."""
    y = (x.cast("float") * F.lit(factor).cast("float")).cast("double")
    return F.least(F.greatest(F.when(y > 0, y + 0.5).otherwise(y - 0.5).cast("bigint"), F.lit(-128)), F.lit(127)).cast("bigint")


def dequantize(q: Column, scale: float, bits: int) -> Column:
    """Back to floating point; a value outside the width is an error."""
    lo, hi = _limits(bits)
    y = q.cast("double") / F.lit(float(1 << (bits - 1))) * F.lit(float(scale))
    return F.when((q < lo) | (q > hi), F.raise_error(F.lit("value outside its width")).cast("double")).otherwise(y)


def fake_quantize(x: Column, scale: float, bits: int) -> Column:
    return dequantize(round_away(x, scale, bits), scale, bits)


def fake_half_even(x: Column, scale: float, bits: int) -> Column:
    """R3 and back to floating point."""
    return dequantize(half_even(x, scale, bits), scale, bits)


def wrap(x: Column, bits: int) -> Column:
    """What a store into so many bits keeps: no clip."""
    return F.pmod(x + F.lit(1 << (bits - 1)), F.lit(1 << bits)) - F.lit(1 << (bits - 1))


def shift_round(x: Column, k: int) -> Column:
    """R4: half towards plus infinity."""
    return x if k == 0 else F.shiftright(x + F.lit(1 << (k - 1)), k)


def shift_floor(x: Column, k: int) -> Column:
    """R5."""
    return F.shiftright(x, k)


def int32_to_float(x: Column, factor: float) -> Column:
    return (x.cast("float") * F.lit(factor).cast("float")).cast("float")


def power_of_two(x: Column) -> Column:
    """Smallest power of two that is not below x."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(x)))


def solve_scale(sy: Column, sa: Column) -> Column:
    """Scale of b in y = a * b."""
    return sy / sa


def solve_scale_square(sy: Column, sa: Column) -> Column:
    """Scale of b in y = a * b * b."""
    return F.sqrt(sy / sa)


def bit_shift(ra: Column, rb: Column, ry: Column, sa: Column, sb: Column, sy: Column) -> Column:
    """Shift that takes a product of ranges ra, rb and scales sa, sb to range ry and scale sy; must be whole."""
    k = F.log2(ra * rb * sy / (sa * sb * ry))
    return F.when(F.abs(k - F.rint(k)) > 1e-9, F.raise_error(F.lit("shift is not whole")).cast("bigint")).otherwise(F.rint(k).cast("bigint"))
