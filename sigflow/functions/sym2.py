"""Closed forms for symmetric 2 x 2 matrices [[a, b], [b, c]], so that whole pipelines stay in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread(a: Column, b: Column, c: Column) -> Column:
    """Difference of the eigenvalues."""
    return F.sqrt((a - c) * (a - c) + 4.0 * b * b)


def eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """(larger, smaller)."""
    d = spread(a, b, c)
    return (a + c + d) / 2.0, (a + c - d) / 2.0


def spectral(a: Column, b: Column, c: Column, f: Callable[[Column], Column], df: Callable[[Column], Column]) -> tuple[Column, Column, Column]:
    """f of the matrix as (aa, bb, cc): alpha I + beta S, with no eigenvector and so no choice of sign."""
    hi, lo = eigenvalues(a, b, c)
    beta = F.when(hi - lo > 1e-12, (f(hi) - f(lo)) / (hi - lo)).otherwise(df(hi))
    alpha = f(hi) - beta * hi
    return alpha + beta * a, beta * b, alpha + beta * c


def logm(a: Column, b: Column, c: Column, floor: float = 0.0):
    cut = (lambda x: F.greatest(x, F.lit(floor))) if floor else (lambda x: x)
    return spectral(a, b, c, lambda x: F.log(cut(x)), lambda x: 1.0 / cut(x))


def invsqrtm(a: Column, b: Column, c: Column):
    return spectral(a, b, c, lambda x: 1.0 / F.sqrt(x), lambda x: -0.5 / (x * F.sqrt(x)))


def congruence(r: tuple[Column, Column, Column], s: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """R S R."""
    p, q, t = r
    a, b, c = s
    x, y, z, w = p * a + q * b, p * b + q * c, q * a + t * b, q * b + t * c
    return x * p + y * q, x * q + y * t, z * q + w * t


def givens(a: Column, b: Column) -> tuple[Column, Column]:
    """(cs, sn) of the rotation that annihilates b against a; (1, 0) if b is 0, (0, sign b) if a is 0."""
    r = F.sqrt(a * a + b * b)
    cs = F.when(b == 0, F.lit(1.0)).when(a == 0, F.lit(0.0)).otherwise(a / r)
    sn = F.when(b == 0, F.lit(0.0)).when(a == 0, F.signum(b)).otherwise(-b / r)
    return cs, sn


def dominant(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column, Column]:
    """Eigenvalue of larger magnitude, the other one, and cs * cs and cs * sn of the first one's unit eigenvector."""
    hi, lo = eigenvalues(a, b, c)
    first = F.when(a + c < 0, lo).otherwise(hi)
    second = F.when(a + c < 0, hi).otherwise(lo)
    gap = first - second
    cs2 = F.when(gap == 0, F.lit(1.0)).otherwise((a - second) / gap)
    cssn = F.when(gap == 0, F.lit(0.0)).otherwise(b / gap)
    return first, second, cs2, cssn
