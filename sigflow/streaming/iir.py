"""Integer SOS filtering of streams: registers are kept for each signal between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigflow.session import ship


def stream_filter(samples: DataFrame, q: dict, key: str = "user_id", order: str = "k", value: str = "x") -> DataFrame:
    """(key, order, y) of samples that arrive in order for each key; results equal those of one batch run.

    ``q`` has integer sections a, b and shifts a_shift, b_shift. The state of a key is
    four registers a section.
    """
    ship(samples.sparkSession)
    a, b = [list(map(int, r)) for r in q["a"]], [list(map(int, r)) for r in q["b"]]
    sa, sb = list(map(int, q["a_shift"])), list(map(int, q["b_shift"]))

    def half_up(v: int, k: int) -> int:
        return v if k == 0 else (v + (1 << (k - 1))) >> k

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reg = list(state.get[0]) if state.exists else [0] * (4 * len(a))
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for v in rows[value].tolist():
            for m in range(len(a)):
                x1, x2, y1, y2 = reg[4 * m : 4 * m + 4]
                o = half_up(half_up(b[m][0] * v + b[m][1] * x1 + b[m][2] * x2, sb[m] - sa[m]) - a[m][1] * y1 - a[m][2] * y2, sa[m])
                reg[4 * m : 4 * m + 4] = [v, x1, o, y1]
                v = o
            out.append(v)
        state.update((reg,))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), "y": out})

    return samples.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, y long", "reg array<long>", "append", GroupStateTimeout.NoTimeout)
