"""Semiring kernels: batches of sequence pairs move through the cell grid one anti-diagonal at a time.

A cell holds a log vector over states. Silent paths are folded into a closure
matrix (exact (I - T)^-1 for sums, all-pairs longest path for max), so a cell
is ``(match + input + output moves) . closure``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from weft.functions import weights as W
from weft.plans.machine import Machine

INF = float("inf")


@dataclass(frozen=True)
class Semiring:
    name: str

    def times(self, a: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Row vectors a (..., S) by matrices m (..., S, S), all logs."""
        if self.name == "max":
            return (a[..., :, None] + m).max(axis=-2)
        top = np.maximum(a.max(axis=-1, keepdims=True), -1e300)
        with np.errstate(divide="ignore"):
            return np.log((np.exp(a - top)[..., None, :] @ np.exp(m))[..., 0, :]) + top

    def plus(self, a, b):
        return np.maximum(a, b) if self.name == "max" else np.logaddexp(a, b)

    def closure(self, m: np.ndarray) -> np.ndarray:
        """All silent paths, the empty one included."""
        n = len(m)
        if self.name == "max":
            out = np.maximum(m, np.where(np.eye(n, dtype=bool), 0.0, -INF))
            for k in range(n):
                out = np.maximum(out, out[:, k : k + 1] + out[k : k + 1, :])
            if (np.diag(out) > 1e-9).any():
                raise ValueError("a silent cycle has a weight above 1")
            return out
        t = np.exp(m)
        if n and np.abs(np.linalg.eigvals(t)).max(initial=0) >= 1 - 1e-12:
            raise ValueError("silent cycles don't converge")
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(np.linalg.inv(np.eye(n) - t), 0))


SUM, MAX = Semiring("sum"), Semiring("max")


@dataclass
class Compiled:
    """Numeric machine: tokens from 1 in order of the sorted alphabets, 0 for none."""

    inputs: list[str]
    outputs: list[str]
    states: int
    src: np.ndarray
    ord: np.ndarray
    dst: np.ndarray
    inp: np.ndarray
    out: np.ndarray
    lw: np.ndarray

    def tensor(self, ring: Semiring, reverse: bool = False) -> np.ndarray:
        """log weights (in, out, src, dst), parallel edges joined."""
        t = np.full((len(self.inputs) + 1, len(self.outputs) + 1, self.states, self.states), -INF)
        a, b = (self.dst, self.src) if reverse else (self.src, self.dst)
        if reverse:
            a, b = self.states - 1 - a, self.states - 1 - b
        for i, o, s, d, w in zip(self.inp, self.out, a, b, self.lw, strict=True):
            t[i, o, s, d] = ring.plus(t[i, o, s, d], w)
        return t

    def tokens(self, seq, side: str):
        table = getattr(self, f"_{side}", None)
        if table is None:
            table = {s: k + 1 for k, s in enumerate(self.inputs if side == "in" else self.outputs)}
            setattr(self, f"_{side}", table)
        got = [table.get(x, -1) for x in seq]
        return None if -1 in got else np.array(got, np.int64)


def compile_machine(m: Machine, values: dict | None = None) -> Compiled:
    v = {**m.defs, **(values or {})}
    ins, outs = m.inputs(), m.outputs()
    ti, to = {s: k + 1 for k, s in enumerate(ins)}, {s: k + 1 for k, s in enumerate(outs)}
    rows = [(s, k, e.dst, ti.get(e.inp, 0), to.get(e.out, 0), W.evaluate(e.weight, v)) for s, k, e in m.all_edges()]
    col = list(zip(*rows, strict=True)) if rows else [()] * 6
    with np.errstate(divide="ignore"):
        lw = np.log(np.array(col[5], float))
    return Compiled(ins, outs, len(m), *(np.array(c, np.int64) for c in col[:5]), lw)


class Grid:
    """Forward-style filling of a batch of pairs under one machine and semiring."""

    def __init__(self, c: Compiled, ring: Semiring, reverse: bool = False):
        self.c, self.ring, self.reverse = c, ring, reverse
        t = c.tensor(ring, reverse)
        self.t = t
        self.silent = ring.closure(t[0, 0])
        self.match, self.inp, self.out = t[1:, 1:], t[1:, 0], t[0, 1:]
        self.start = np.full(c.states, -INF)
        self.start[0] = 0
        self.start = ring.times(self.start, self.silent)

    def _moves(self, x, y):
        """Matrices of a match, input or output step; x, y tokens (n,) or soft profiles (n, K) or None."""
        table = self.match if x is not None and y is not None else self.inp if x is not None else self.out
        for side in (x, y):
            if side is None:
                continue
            if side.ndim == 1:
                table = table[side - 1] if side is x else (table[np.arange(len(side)), side - 1] if x is not None else table[side - 1])
            else:
                with np.errstate(divide="ignore"):
                    p = np.log(side)
                if side is y and x is not None:
                    table = _mix(self.ring, table, p, batched=True)
                else:
                    table = _mix(self.ring, table, p, batched=False)
        return table

    def fill(self, xs: list, ys: list, keep: bool = False, allowed: list | None = None):
        """Scores of the pairs; with ``keep`` also all cells (pairs, I+1, O+1, S), -Infinity beyond a pair's own lengths.

        A pair's side is tokens (L,) or a profile (L, K). ``allowed``: boolean
        (Li+1, Lo+1) grids that confine the cells.
        """
        n, S = len(xs), self.c.states
        if self.reverse:
            xs, ys = [x[::-1] for x in xs], [y[::-1] for y in ys]
            allowed = None if allowed is None else [a[::-1, ::-1] for a in allowed]
        li, lo = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        score = np.full(n, -INF)
        I, O = int(li.max(initial=0)), int(lo.max(initial=0))
        cells = np.full((n, I + 1, O + 1, S), -INF) if keep else None
        soft_x, soft_y = xs and xs[0].ndim == 2, ys and ys[0].ndim == 2

        def grid(side, L, soft):
            K = side[0].shape[1] if soft and side else 0
            g = np.ones((n, L + 1, K)) if soft else np.ones((n, L + 1), np.int64)
            for k, s in enumerate(side):
                g[k, 1 : len(s) + 1] = s
            return g

        gx, gy = grid(xs, I, soft_x), grid(ys, O, soft_y)
        last, last2 = np.full((n, I + 1, S), -INF), None
        for d in range(int((li + lo).max(initial=0)) + 1):
            now = np.full((n, I + 1, S), -INF)
            k, i = np.nonzero((np.arange(I + 1) <= np.minimum(li, d)[:, None]) & (d - np.arange(I + 1) <= lo[:, None]))
            o = d - i
            if allowed is not None:
                ok = np.array([allowed[a][b, c] for a, b, c in zip(k, i, o, strict=True)], bool)
                k, i, o = k[ok], i[ok], o[ok]
            if d == 0:
                now[k, 0] = self.start
            else:
                for di, do in ((1, 1), (1, 0), (0, 1)):
                    use = (i >= di) & (o >= do)
                    if not use.any() or (di and not len(self.c.inputs)) or (do and not len(self.c.outputs)):
                        continue
                    a, b, c = k[use], i[use], o[use]
                    prev = (last2 if di and do else last)[a, b - di]
                    m = self._moves(gx[a, b] if di else None, gy[a, c] if do else None)
                    now[a, b] = self.ring.plus(now[a, b], self.ring.times(prev, m))
                if len(k):
                    now[k, i] = self.ring.times(now[k, i], self.silent)
            if keep:
                cells[k, i, o] = now[k, i]
            end = np.flatnonzero(li + lo == d)
            score[end] = now[end, li[end], S - 1]
            last2, last = last, now
        if keep and self.reverse:  # each pair's grid is turned round within its own lengths
            i, o = li[:, None] - np.arange(I + 1), lo[:, None] - np.arange(O + 1)
            inside = (i >= 0)[:, :, None] & (o >= 0)[:, None, :]
            cells = np.where(inside[..., None], cells[np.arange(n)[:, None, None], np.maximum(i, 0)[:, :, None], np.maximum(o, 0)[:, None, :], ::-1], -INF)
        return (score, cells) if keep else score


def _mix(ring, table, p, batched):
    """Profile-weighted sum of matrices: table (K, ...) or (n, K, ...) by log weights p (n, K)."""
    t = table if batched else table[None]
    x = t + p.reshape(*p.shape, *([1] * (t.ndim - 2)))
    if ring.name == "max":
        return x.max(axis=1)
    top = np.maximum(x.max(axis=1, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def counts(c: Compiled, x, y, allowed=None) -> tuple[float, np.ndarray]:
    """Log likelihood and expected uses of each edge."""
    z, n = batch_counts(c, [x], [y], None if allowed is None else [allowed])
    return float(z[0]), n


def batch_counts(c: Compiled, xs: list, ys: list, allowed=None) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of some pairs and the expected uses of each edge in all of them; impossible pairs add nothing."""
    z, F = Grid(c, SUM).fill(xs, ys, True, allowed)
    _, B = Grid(c, SUM, True).fill(xs, ys, True, allowed)
    out, ok = np.zeros(len(c.lw)), z > -INF
    if not ok.any():
        return z, out
    F, B, z_ = F[ok], B[ok], z[ok]
    I, O = F.shape[1], F.shape[2]

    def weights(side, L, tokens):
        """(pairs, L, symbols + 1): how far each place holds each symbol."""
        w = np.zeros((len(F), L, tokens + 1))
        for k, s in enumerate(side[p] for p in np.flatnonzero(ok)):
            if s.ndim == 2:
                w[k, : len(s), 1:] = s
            else:
                w[k, np.arange(len(s)), s] = 1
        return w

    wx, wy = weights(xs, I - 1, len(c.inputs)), weights(ys, O - 1, len(c.outputs))
    for e in range(len(c.lw)):
        i, o = int(c.inp[e]), int(c.out[e])
        a = F[:, : I - (i > 0), : O - (o > 0), c.src[e]]
        p = np.exp(a + c.lw[e] + B[:, (i > 0) :, (o > 0) :, c.dst[e]] - z_[:, None, None])
        if i:
            p = p * wx[:, :, i][:, :, None]
        if o:
            p = p * wy[:, :, o][:, None, :]
        out[e] = p.sum()
    return z, out


def state_posteriors(c: Compiled, x, y) -> tuple[float, np.ndarray]:
    """exp(F + B - ll) of every cell and state."""
    z, p = batch_posteriors(c, [x], [y])
    return float(z[0]), p[0]


def batch_posteriors(c: Compiled, xs: list, ys: list) -> tuple[np.ndarray, np.ndarray]:
    """The same for a batch: (pairs,) and (pairs, I+1, O+1, S); 0 for impossible pairs."""
    z, F = Grid(c, SUM).fill(xs, ys, True)
    _, B = Grid(c, SUM, True).fill(xs, ys, True)
    return z, np.exp(F + B - np.where(z > -INF, z, INF)[:, None, None, None])


def _arrivals(c: Compiled) -> dict:
    """Edges by (destination, input, output), with what ties are broken by."""
    got = getattr(c, "_into", None)
    if got is None:
        kind = np.where((c.inp > 0) & (c.out > 0), 0, np.where(c.inp > 0, 1, np.where(c.out > 0, 2, 3)))
        got = {}
        for e in range(len(c.lw)):
            if c.lw[e] > -INF:
                i, o, src = int(c.inp[e]), int(c.out[e]), int(c.src[e])
                got.setdefault((int(c.dst[e]), i, o), []).append((e, i > 0, o > 0, src, float(c.lw[e]), (int(kind[e]), i, o, src)))
        c._into = got
    return got


def trace(c: Compiled, x, y, rng=None, start=None, F=None) -> tuple[float, list[int]]:
    """Edges of the best path (or, with ``rng``, of a path drawn by posterior) that ends at the end, or at cell ``start``; ``F``: cells already filled."""
    if F is None:
        F = Grid(c, MAX if rng is None else SUM).fill([x], [y], True)[1][0]
    i, o, s = start if start is not None else (len(x), len(y), c.states - 1)
    total = F[i, o, s]
    path: list[int] = []
    if total == -INF:
        return total, path
    into, x, y = _arrivals(c), [0, *x.tolist()], [0, *y.tolist()]
    back = [np.flatnonzero(c.dst == k) for k in range(c.states)] if rng is not None else None
    while not (i == 0 and o == 0 and s == 0 and (rng is None or _stop(F, c, rng, back))):
        keys = {(s, x[i], y[o]): 0, (s, x[i], 0): 0, (s, 0, y[o]): 0, (s, 0, 0): 0}
        options = [(F[i - di, o - do, src] + w, e, tie, di, do, src) for k in keys for e, di, do, src, w, tie in into.get(k, ()) if F[i - di, o - do, src] > -INF]
        if not options:
            break
        if rng is None:
            top = max(v[0] for v in options) - 1e-9
            pick = min((v for v in options if v[0] >= top), key=lambda v: v[2])
        else:
            w = np.array([v[0] for v in options])
            p = np.exp(w - w.max())
            pick = options[int(rng.choice(len(p), p=p / p.sum()))]
        path.append(pick[1])
        i, o, s = i - pick[3], o - pick[4], pick[5]
        if len(path) > 1_000_000:
            raise RuntimeError("path too long")
    return float(total), path[::-1]


def _stop(F, c, rng, into):
    """Whether a drawn path ends at the start state: by chance only if silent edges lead back to it."""
    w = [F[0, 0, c.src[e]] + c.lw[e] for e in into[0] if not c.inp[e] and not c.out[e]]
    more = np.exp(np.array(w)).sum() if w else 0.0
    return rng.random() < 1 / (1 + more)


def null_sums(c: Compiled, only_no_output: bool = False) -> np.ndarray:
    """(I - T)^-1 over all edges, or over those without output."""
    t = np.zeros((c.states, c.states))
    use = c.out == 0 if only_no_output else np.ones(len(c.lw), bool)
    np.add.at(t, (c.src[use], c.dst[use]), np.exp(c.lw[use]))
    return np.linalg.inv(np.eye(c.states) - t)
