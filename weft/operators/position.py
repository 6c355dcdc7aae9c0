"""Dynamic programming with position-dependent weights, along given alignments, and over fused machines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.operators import graph as G
from weft.operators import infer as I
from weft.operators import kernels as K
from weft.plans.machine import Machine

MAT, INS, DEL = 0, 1, 2


class PositionMachine:
    """Edges whose log weights are arrays that broadcast to the (Li + 1, Lo + 1) grid of cells they enter.

    ``edges``: (src, dst, takes input, takes output, weights). Silent edges must
    go to later states.
    """

    def __init__(self, states: int, edges: list[tuple]):
        self.states, self.edges = states, edges
        for s, d, i, o, _ in edges:
            if not i and not o and d <= s:
                raise ValueError("silent edges must go forward")

    @classmethod
    def from_machine(cls, c: K.Compiled, x: np.ndarray, y: np.ndarray) -> "PositionMachine":
        """The cells of fixed weights on tokens x, y; a start for weights that vary."""
        li, lo = len(x), len(y)
        tx, ty = np.concatenate([[-1], x]), np.concatenate([[-1], y])
        edges = []
        for e in range(len(c.lw)):
            w = np.full((li + 1, lo + 1), c.lw[e])
            if c.inp[e]:
                w = np.where((tx == c.inp[e])[:, None], w, -np.inf)
            if c.out[e]:
                w = np.where((ty == c.out[e])[None, :], w, -np.inf)
            edges.append((int(c.src[e]), int(c.dst[e]), bool(c.inp[e]), bool(c.out[e]), w))
        return cls(c.states, edges)

    def fill(self, li: int, lo: int, ring: K.Semiring = K.SUM, allowed=None) -> np.ndarray:
        f = np.full((li + 1, lo + 1, self.states), -np.inf)
        grid = [(s, d, i, o, np.broadcast_to(w, (li + 1, lo + 1))) for s, d, i, o, w in self.edges]
        loud = [e for e in grid if e[2] or e[3]]
        quiet = sorted((e for e in grid if not (e[2] or e[3])), key=lambda e: e[0])
        f[0, 0, 0] = 0
        for total in range(li + lo + 1):
            i = np.arange(max(0, total - lo), min(li, total) + 1)
            o = total - i
            for s, d, a, b, w in loud:
                ok = (i >= a) & (o >= b)
                p, q = i[ok], o[ok]
                f[p, q, d] = ring.plus(f[p, q, d], f[p - a, q - b, s] + w[p, q])
            for s, d, _, _, w in quiet:
                f[i, o, d] = ring.plus(f[i, o, d], f[i, o, s] + w[i, o])
            if allowed is not None:
                f[i, o] = np.where(allowed[i, o][:, None], f[i, o], -np.inf)
        return f

    def score(self, li, lo, ring=K.SUM) -> float:
        return float(self.fill(li, lo, ring)[li, lo, -1])


def check_alignment(ops, li: int, lo: int) -> None:
    """Operations 0 (match), 1 (input only), 2 (output only) must use up both sequences."""
    ops = np.asarray(ops)
    if not np.isin(ops, (MAT, INS, DEL)).all():
        raise ValueError("an operation is 0, 1 or 2")
    if (ops != DEL).sum() != li or (ops != INS).sum() != lo:
        raise ValueError(f"the alignment uses {(ops != DEL).sum()} inputs and {(ops != INS).sum()} outputs of {li} and {lo}")


def aligned(c: K.Compiled, x, y, ops, ring: K.Semiring = K.SUM) -> float:
    """Score of all state paths along one alignment."""
    check_alignment(ops, len(x), len(y))
    g = K.Grid(c, ring)
    v, i, o = g.start, 0, 0
    for op in ops:
        a, b = op != DEL, op != INS
        m = g.match[x[i] - 1, y[o] - 1] if a and b else g.inp[x[i] - 1] if a else g.out[y[o] - 1]
        v = ring.times(ring.times(v, m), g.silent)
        i, o = i + a, o + b
    return float(v[-1])


def score_aligned(df: DataFrame, m: Machine, inp: str, out: str, ops: str, values: dict | None = None, ring: K.Semiring = K.SUM, name: str = "loglike") -> DataFrame:
    """Score rows along their own alignments (array<int> column)."""
    bound = df.sparkSession.sparkContext.broadcast(K.compile_machine(m, values))

    def run(batches):
        c = bound.value
        for b in batches:
            s = []
            for x, y, z in zip(*[b.column(q).to_pylist() for q in (inp, out, ops)], strict=True):
                x, y = c.tokens(x or [], "in"), c.tokens(y or [], "out")
                s.append(-np.inf if x is None or y is None else aligned(c, x, y, z or [], ring))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return df.mapInArrow(run, I._schema(df, f"`{name}` double"))


def fuse(generator: Machine, transducer: Machine, values: dict | None = None) -> Machine:
    """Generator into transducer with numeric weights: what scores exactly as the two composed, deletions included."""
    return G.compose(generator.evaluated(values), transducer.evaluated(values), cycles="sum")


def fused_score(df: DataFrame, generator: Machine, transducer: Machine, out: str, values: dict | None = None, ring: K.Semiring = K.SUM, name: str = "loglike") -> DataFrame:
    """Score a column of output sequences under generator and transducer; the batch form of the fused operators."""
    return I.score(df, fuse(generator, transducer, values), None, out, None, ring, name)
