"""Dense matrices as row-major array columns. Every operation is local to its row: no shuffle, no Python.

Functions take SQL names of array columns and give SQL text, which composes inside
``selectExpr``; ``cells`` turns a matrix into rows (i, j, v).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FRESH = count()


def bound(body, *values: str) -> str:
    """``body`` of names for the values, each computed once for a row and not once for each cell."""
    names = [f"v{next(_FRESH)}_" for _ in values]
    out = body(*names)
    for name, value in reversed(list(zip(names, values))):
        out = f"transform(array({value}), {name} -> {out})[0]"
    return out


def build(rows: int, cols: int, cell: str) -> str:
    """Matrix whose cell (i, j) is the SQL text ``cell``."""
    body = cell.replace("{i}", f"(p div {cols})").replace("{j}", f"(p % {cols})")
    return f"transform(sequence(0, {rows * cols - 1}), p -> {body})"


def at(m: str, cols: int, i: str, j: str) -> str:
    return f"{m}[cast(({i}) * {cols} + ({j}) as int)]"


def eye(n: int) -> str:
    return build(n, n, "if({i} = {j}, 1L, 0L)")


def add(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> x + y)"


def sub(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> x - y)"


def _dot(n: int, left: str, right: str) -> str:
    return f"aggregate(sequence(0, {n - 1}), 0L, (total, k) -> total + {left} * {right})"


def mul(a: str, b: str, n: int, m: int, o: int) -> str:
    """(n x m) times (m x o)."""
    return bound(lambda a, b: build(n, o, _dot(m, at(a, m, "{i}", "k"), at(b, o, "k", "{j}"))), a, b)


def mul_t(a: str, b: str, n: int, m: int, o: int) -> str:
    """(n x m) times the transpose of (o x m)."""
    return bound(lambda a, b: build(n, o, _dot(m, at(a, m, "{i}", "k"), at(b, m, "{j}", "k"))), a, b)


def mul_sym(a: str, b: str, n: int) -> str:
    """Product known to be symmetric: the upper triangle, mirrored."""
    lo, hi = "least({i}, {j})", "greatest({i}, {j})"
    return bound(lambda a, b: build(n, n, _dot(n, at(a, n, lo, "k"), at(b, n, "k", hi))), a, b)


def mul_diag(a: str, d: str, n: int, m: int) -> str:
    return bound(lambda a, d: build(n, m, at(a, m, "{i}", "{j}") + f" * {d}[cast({{j}} as int)]"), a, d)


def mat_vec(a: str, x: str, n: int, m: int) -> str:
    return bound(lambda a, x: build(n, 1, _dot(m, at(a, m, "{i}", "k"), f"{x}[k]")), a, x)


def vec_mat(x: str, a: str, n: int, m: int) -> str:
    return bound(lambda x, a: build(1, m, _dot(n, f"{x}[k]", at(a, m, "k", "{j}"))), x, a)


def outer(x: str, y: str, n: int, m: int) -> str:
    return bound(lambda x, y: build(n, m, f"{x}[cast({{i}} as int)] * {y}[cast({{j}} as int)]"), x, y)


def vec_cov(x: str, n: int, store: str = "full") -> str:
    """x x'; ``upper`` and ``lower`` leave the other triangle 0."""
    keep = {"full": "true", "upper": "{i} <= {j}", "lower": "{i} >= {j}"}[store]
    return bound(lambda x: build(n, n, f"if({keep}, {x}[cast({{i}} as int)] * {x}[cast({{j}} as int)], 0L)"), x)


def inner(x: str, y: str) -> str:
    return f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0L, (total, v) -> total + v)"


def norm(x: str) -> str:
    return f"sqrt(cast({inner(x, x)} as double))"


def transpose(a: str, n: int, m: int) -> str:
    return bound(lambda a: build(m, n, at(a, m, "{j}", "{i}")), a)


def sub_matrix(a: str, cols: int, r0: int, c0: int, n: int, m: int) -> str:
    return bound(lambda a: build(n, m, at(a, cols, f"{{i}} + {r0}", f"{{j}} + {c0}")), a)


def half_vector(m: str, n: int, root: str = "sqrt(2D)") -> str:
    """Diagonal, then the strict upper triangle column by column times the root of two."""
    def body(m: str) -> str:
        diagonal = f"transform(sequence(0, {n - 1}), i -> {at(m, n, 'i', 'i')})"
        upper = f"flatten(transform(sequence(1, {n - 1}), j -> transform(sequence(0, j - 1), i -> {root} * {at(m, n, 'i', 'j')})))"
        return f"concat({diagonal}, {upper})"

    return bound(body, m)


def cells(df: DataFrame, key: str, m: str, cols: int) -> DataFrame:
    """(key, i, j, v) rows of the matrix expression ``m``."""
    x = df.selectExpr(key, f"posexplode({m}) as (p, v)")
    return x.select(key, F.floor(F.col("p") / cols).cast("int").alias("i"), (F.col("p") % cols).cast("int").alias("j"), "v")


def entries(df: DataFrame, key: str, m: str) -> DataFrame:
    """(key, i, v) rows of a vector expression."""
    return df.selectExpr(key, f"posexplode({m}) as (i, v)")
