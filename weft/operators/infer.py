"""Inference over DataFrames of sequences.

The machine is broadcast; sequences stay where they are. Kernels run in
``mapInArrow`` on blocks of rows of similar length (sorted within an Arrow
batch), so padding stays small; only counts are shuffled, pre-added per task.
``forward_column`` compiles a small one-tape machine to a SQL expression that
never leaves the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import weights as W
from weft.operators import kernels as K
from weft.operators.kernels import MAX, SUM, Semiring
from weft.plans.machine import Machine

#: Cells (pairs x diagonal) of a block, and numbers held where all cells are kept.
BLOCK, KEPT = 1 << 15, 1 << 21


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *([extra] if extra else [])])


def _sides(b, c: K.Compiled, inp, out):
    """Token arrays or profiles of a batch's rows; None where a symbol is unknown."""
    n = b.num_rows

    def side(col, which):
        if col is None:
            return [np.zeros(0, np.int64)] * n
        vals = b.column(col).to_pylist()
        got = []
        for v in vals:
            v = v or []
            if v and isinstance(v[0], (list, tuple)):
                got.append(np.array(v, float))
            else:
                got.append(c.tokens(v, which))
        return got

    return side(inp, "in"), side(out, "out")


def _blocks(x, y, states: int = 0):
    """Rows in blocks of similar lengths; with ``states`` small enough to keep all their cells."""
    ok = [k for k in range(len(x)) if x[k] is not None and y[k] is not None]
    ok.sort(key=lambda k: (len(x[k]), len(y[k])))
    at = 0
    while at < len(ok):
        width = max(1, len(x[ok[at]]) + 1)
        chunk = ok[at : at + max(1, BLOCK // width)]
        while len(chunk) > 1 and (len(x[chunk[-1]]) > 2 * width + 16 or states and len(chunk) * states * (len(x[chunk[-1]]) + 1) * (max(len(y[k]) for k in (chunk[0], chunk[-1])) + 1) > KEPT):
            del chunk[max(1, len(chunk) * 3 // 4) :]
        yield chunk
        at += len(chunk)


def score(df: DataFrame, m: Machine, inp: str | None = None, out: str | None = None, values: dict | None = None, ring: Semiring = SUM, name: str = "loglike", envelopes: str | None = None) -> DataFrame:
    """Add the Forward (or Viterbi, ``ring=MAX``) log score of each row.

    ``inp``/``out``: array<string> columns, or array<array<double>> profiles over
    the machine's sorted alphabet. An unknown symbol scores -Infinity.
    ``envelopes``: column of array<struct<lo,hi>> per output position.
    """
    bound = df.sparkSession.sparkContext.broadcast((K.compile_machine(m, values), ring))

    def run(batches):
        c, ring = bound.value
        grid = K.Grid(c, ring)
        for b in batches:
            x, y = _sides(b, c, inp, out)
            s = np.full(b.num_rows, -np.inf)
            env = b.column(envelopes).to_pylist() if envelopes else None
            for chunk in _blocks(x, y):
                allowed = None
                if env:
                    allowed = []
                    for k in chunk:
                        i = np.arange(len(x[k]) + 1)[:, None]
                        lo, hi = (np.array([e[f] for e in env[k]]) for f in ("lo", "hi"))
                        allowed.append((i >= lo) & (i < hi))
                s[chunk] = grid.fill([x[k] for k in chunk], [y[k] for k in chunk], allowed=allowed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return df.mapInArrow(run, _schema(df, f"`{name}` double"))


def accepts(df: DataFrame, m: Machine, inp: str, values: dict | None = None, name: str = "accepted") -> DataFrame:
    """Language membership: some path has weight above 0."""
    flat = Machine([[e.to(e.dst, out="") for e in es] for es in m.edges], m.names, m.defs, m.cons)
    return score(df, flat, inp, None, values, MAX, "__s").withColumn(name, F.col("__s") > float("-inf")).drop("__s")


def _cellwise(df, m, values, keys, name, fill, inp, out):
    """A row a finite cell: keys, in_pos, out_pos, state_idx and the cell; ``fill`` gives a block's cells (pairs, I+1, O+1, S), nan for none."""
    bound = df.sparkSession.sparkContext.broadcast(K.compile_machine(m, values))
    kinds = ", ".join(f"`{q}` {df.schema[q].dataType.simpleString()}" for q in keys)
    names = [*keys, "in_pos", "out_pos", "state_idx", name]

    def run(batches):
        c = bound.value
        for b in batches:
            x, y = _sides(b, c, inp, out)
            for chunk in _blocks(x, y, c.states):
                v = fill(c, [x[k] for k in chunk], [y[k] for k in chunk])
                k, *at = np.nonzero(~np.isnan(v))
                picked = [b.column(q).take(pa.array(np.array(chunk)[k])) for q in keys]
                yield pa.RecordBatch.from_arrays([*picked, *[pa.array(a.astype(np.int32)) for a in at], pa.array(v[(k, *at)])], names)

    return df.mapInArrow(run, f"{kinds}, in_pos int, out_pos int, state_idx int, {name} double")


def posteriors(df: DataFrame, m: Machine, keys: list[str], inp: str | None = None, out: str | None = None, values: dict | None = None) -> DataFrame:
    """State posteriors of every cell: keys, in_pos, out_pos, state_idx, p."""

    def fill(c, x, y):
        p = K.batch_posteriors(c, x, y)[1]
        return np.where(p > 0, p, np.nan)

    return _cellwise(df, m, values, keys, "p", fill, inp, out)


def cells(df: DataFrame, m: Machine, keys: list[str], inp=None, out=None, values=None, ring: Semiring = SUM, backward: bool = False) -> DataFrame:
    """Every Forward (or Backward) cell: keys, in_pos, out_pos, state_idx, loglike."""

    def fill(c, x, y):
        f = K.Grid(c, ring, backward).fill(x, y, True)[1]
        return np.where(f > -np.inf, f, np.nan)

    return _cellwise(df, m, values, keys, "loglike", fill, inp, out)


def paths(df: DataFrame, m: Machine, keys: list[str], inp=None, out=None, values=None, seed: int | None = None) -> DataFrame:
    """The best path of each row (with ``seed``: one drawn by posterior): keys, step, src, ord, dst, in_sym, out_sym, loglike.

    Cells are filled a block at a time; only the walk back is row by row.
    """
    bound = df.sparkSession.sparkContext.broadcast(K.compile_machine(m, values))
    kinds = ", ".join(f"`{q}` {df.schema[q].dataType.simpleString()}" for q in keys)
    names = [*keys, "step", "src", "ord", "dst", "in_sym", "out_sym", "loglike"]

    def run(batches):
        c = bound.value
        grid = K.Grid(c, MAX if seed is None else SUM)
        ins, outs = np.array(["", *c.inputs], object), np.array(["", *c.outputs], object)
        for b in batches:
            x, y = _sides(b, c, inp, out)
            for chunk in _blocks(x, y, c.states):
                ll, F = grid.fill([x[k] for k in chunk], [y[k] for k in chunk], True)
                rows, steps, edges, lls = [], [], [], []
                for k, f, z in zip(chunk, F, ll, strict=True):
                    rng = None if seed is None else np.random.default_rng([seed, *x[k].tolist(), 0, *y[k].tolist()])
                    path = K.trace(c, x[k], y[k], rng, F=f)[1]
                    rows += [k] * len(path)
                    steps += range(len(path))
                    edges += path
                    lls += [float(z)] * len(path)
                e = np.array(edges, np.int64)
                made = [pa.array(steps, pa.int32()), *[pa.array(v[e].astype(np.int32)) for v in (c.src, c.ord, c.dst)], pa.array(ins[c.inp[e]], pa.string()), pa.array(outs[c.out[e]], pa.string()), pa.array(lls, pa.float64())]
                yield pa.RecordBatch.from_arrays([*[b.column(q).take(pa.array(rows, pa.int64())) for q in keys], *made], names)

    return df.mapInArrow(run, f"{kinds}, step int, src int, ord int, dst int, in_sym string, out_sym string, loglike double")


def edge_counts(df: DataFrame, m: Machine, inp=None, out=None, values=None) -> DataFrame:
    """Expected uses of each edge over all rows: src, ord, cnt; impossible rows are left out. One small row a task and edge is shuffled."""
    bound = df.sparkSession.sparkContext.broadcast(K.compile_machine(m, values))

    def run(batches):
        c = bound.value
        total, ll, n = np.zeros(len(c.lw)), 0.0, 0
        for b in batches:
            x, y = _sides(b, c, inp, out)
            for chunk in _blocks(x, y, c.states):
                z, k = K.batch_counts(c, [x[i] for i in chunk], [y[i] for i in chunk])
                total += k
                ll += z[z > -np.inf].sum()
                n += (z > -np.inf).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([*c.src, -1, -2], pa.int32()), pa.array([*c.ord, 0, 0], pa.int32()), pa.array([*total, ll, float(n)])], ["src", "ord", "cnt"]
        )

    return df.mapInArrow(run, "src int, ord int, cnt double").groupBy("src", "ord").agg(F.sum("cnt").alias("cnt"))


def param_counts(counts: DataFrame, m: Machine, values: dict) -> dict[str, float]:
    """Expected uses of each parameter: sum over edges of count * dlog(weight)/dlog(parameter)."""
    v = {**m.defs, **values}
    out: dict[str, float] = {}
    for r in counts.filter("src >= 0").collect():  # one row an edge
        w = m.edges[r.src][r.ord].weight
        for p in W.params(w, m.defs):
            if p in values:
                d = W.evaluate(W.derive(w, p, m.defs), v) * W.evaluate(p, v) / W.evaluate(w, v)
                out[p] = out.get(p, 0.0) + r.cnt * d
    return out


# one tape, in the JVM
def forward_column(m: Machine, seq: Column | str, values: dict | None = None, ring: Semiring = SUM) -> Column:
    """Log score of an array<string> column as a SQL expression: a fold with a state vector, rescaled at every step.

    For recognisers (inputs only) or generators (outputs only) without both.
    """
    c = K.compile_machine(m, values)
    t = c.tensor(ring)
    if c.inputs and c.outputs:
        raise ValueError("a column expression takes one tape")
    symbols = c.inputs or c.outputs
    steps = t[1:, 0] if c.inputs else t[0, 1:]
    close = ring.closure(t[0, 0])
    lin = np.exp(np.stack([ring.times(s, close) for s in steps])) if symbols else np.zeros((0, c.states, c.states))
    start = np.full(c.states, -np.inf)
    start[0] = 0
    start = np.exp(ring.times(start, close))
    seq = F.col(seq) if isinstance(seq, str) else seq
    S = range(c.states)
    vec = lambda cols: F.array(*cols)

    def step(acc, sym):
        v = acc["v"]
        new = []
        for d in S:
            terms = [v[s] * _pick(sym, symbols, lin[:, s, d]) for s in S if (lin[:, s, d] > 0).any()]
            new.append((F.greatest(*terms) if len(terms) > 1 else terms[0]) if ring.name == "max" and terms else sum(terms[1:], terms[0]) if terms else F.lit(0.0))
        return F.struct(vec(new).alias("v"), acc["ll"].alias("ll"))

    def rescale(acc, sym):
        a = step(acc, sym)
        top = F.array_max(a["v"])
        scaled = F.transform(a["v"], lambda x: F.when(top > 0, x / top).otherwise(F.lit(0.0)))
        return F.struct(scaled.alias("v"), (a["ll"] + F.when(top > 0, F.ln(top)).otherwise(F.lit(float("-inf")))).alias("ll"))

    zero = F.struct(vec([F.lit(float(x)) for x in start]).alias("v"), F.lit(0.0).alias("ll"))
    return F.aggregate(seq, zero, rescale, lambda a: a["ll"] + W.safe_log(a["v"][c.states - 1]))


def _pick(sym: Column, symbols, w) -> Column:
    out = F.lit(0.0)
    if len(w) and (w == w[0]).all() and len(symbols) > 0:
        return F.when(sym.isin(*symbols), F.lit(float(w[0]))).otherwise(out)
    for s, x in zip(symbols, w, strict=True):
        if x > 0:
            out = F.when(sym == s, F.lit(float(x))).otherwise(out)
    return out


# very long single sequences: the product of transfer matrices is associative
def forward_chunks(df: DataFrame, m: Machine, key: str, pos: str, sym: str, values: dict | None = None, ring: Semiring = SUM, chunk: int = 4096) -> DataFrame:
    """Score sequences given as (key, pos, sym) rows too long for one row.

    Each chunk of positions becomes one S x S matrix in its own task; a key's
    matrices (length / chunk of them) are multiplied in order.
    """
    c = K.compile_machine(m, values)
    bound = df.sparkSession.sparkContext.broadcast((c, ring))
    kind = df.schema[key].dataType.simpleString()

    def matrix(k, t):
        c, ring = bound.value
        g = K.Grid(c, ring)
        table = g.inp if c.inputs else g.out
        toks = c.tokens(t.sort_by(pos).column(sym).to_pylist(), "in" if c.inputs else "out")
        out = np.where(np.eye(c.states, dtype=bool), 0.0, -np.inf)
        if toks is None:
            out[:] = -np.inf
        else:
            for x in toks:
                out = ring.times(out, np.broadcast_to(ring.times(table[x - 1], g.silent), (c.states, c.states, c.states)))
        return pa.table([pa.array([k[0].as_py()], t.schema.field(key).type), pa.array([k[1].as_py()], pa.int64()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], [key, "chunk", "m"])

    def join(k, t):
        c, ring = bound.value
        v = K.Grid(c, ring).start
        for x in t.sort_by("chunk").column("m").to_pylist():
            v = ring.times(v, np.array(x).reshape(c.states, c.states))
        return pa.table([pa.array([k[0].as_py()], t.schema.field(key).type), pa.array([float(v[-1])])], [key, "loglike"])

    parts = df.withColumn("chunk", F.floor(F.col(pos) / chunk).cast("long")).groupBy(key, "chunk").applyInArrow(matrix, f"`{key}` {kind}, chunk bigint, m array<double>")
    return parts.groupBy(key).applyInArrow(join, f"`{key}` {kind}, loglike double")
