"""Pieces of SQL and table views that the registered queries share."""

from __future__ import annotations

#: DuckDB views of the test tables as trials and signals.
TRIALS = "select vec_id, label, (p // {w})::int c, (p % {w})::int t, x::double x from (select vec_id, label, unnest(embedding) x, unnest(range(64)) p from embeddings)"
QUANT = "trunc(greatest(least(({x}) / {s}::double * {h}::double + sign({x}) * 0.5, {h}::double - 1), -({h}::double)))::bigint"
SIGNAL = "select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 k, value from events"


def trials(channels: int) -> str:
    return TRIALS.format(w=64 // channels)


def quant(x: str, scale: float = 1, bits: int = 8) -> str:
    return QUANT.format(x=x, s=scale, h=1 << (bits - 1))


def qtrials(channels: int) -> str:
    """Trials with samples as eight-bit integers."""
    return f"select vec_id, label, c, t, {quant('x')} x from ({trials(channels)})"


#: Matrix A: the quantised vector as 8 x 8; W: fixed small integers.
A = f"select vec_id, (p // 8)::int i, (p % 8)::int j, {quant('x')} v from (select vec_id, unnest(embedding)::double x, unnest(range(64)) p from embeddings)"
W = "select i::int i, j::int j, ((7 * i + 3 * j) % 11 - 5)::bigint v from range(8) a(i), range(8) b(j)"
FIXED = "((7 * {i} + 3 * {j}) % 11 - 5)"
