"""Incremental scoring of growing sequences (an extension beyond batch scoring).

``forward_stream`` keeps one scaled Forward vector per key, so a symbol costs
S x S work whatever came before, and late rows of an expired key start anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weft.operators import kernels as K
from weft.plans.machine import Machine


def forward_stream(stream: DataFrame, m: Machine, key: str, sym: str, values: dict | None = None, order: str | None = None, timeout_ms: int | None = None) -> DataFrame:
    """(key, n, loglike) after each trigger: symbols seen and the log score if the sequence ended now.

    Rows of a trigger are taken in order of ``order``. With ``timeout_ms`` an
    idle key's state is dropped.
    """
    c = K.compile_machine(m, values)
    kind = stream.schema[key].dataType.simpleString()

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        g = K.Grid(c, K.SUM)
        table = g.inp if c.inputs else g.out
        n, v = (state.get[0], np.array(state.get[1])) if state.exists else (0, g.start)
        rows = pd.concat(list(frames))
        if order:
            rows = rows.sort_values(order, kind="stable")
        toks = {s: t for t, s in enumerate(c.inputs or c.outputs)}
        for s in rows[sym]:
            v = K.SUM.times(K.SUM.times(v, table[toks[s]]), g.silent) if s in toks else np.full_like(v, -np.inf)
            n += 1
        state.update((n, v.tolist()))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "loglike": [float(v[-1])]})

    return stream.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, n bigint, loglike double", "n bigint, v array<double>", "update", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout"
    )
