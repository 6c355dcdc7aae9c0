"""Baum-Welch training: distributed E-steps, a driver M-step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from weft.functions import weights as W
from weft.operators import infer
from weft.plans.machine import Machine, merge_constraints


def seed_params(cons: dict) -> dict[str, float]:
    """Uniform norm groups, probabilities 0.5, rates 1."""
    out = {p: 1 / len(g) for g in cons.get("norm", []) for p in g}
    return out | {p: 0.5 for p in cons.get("prob", [])} | {p: 1.0 for p in cons.get("rate", [])}


def maximise(m: Machine, cons: dict, edge_count: dict[tuple[int, int], float], fixed: dict, start: dict) -> dict[str, float]:
    """Parameters that maximise sum count * log weight under the constraints.

    Closed form where every parameter enters weights as a plain factor of norm
    groups or as p / 1 - p; otherwise quasi-Newton on unconstrained coordinates.
    """
    closed = _closed_form(m, cons, edge_count)
    return closed if closed is not None else _bfgs(m, cons, edge_count, fixed, start)


def _factors(w):
    """A weight as a product of parameters, their complements and numbers; None if it isn't one."""
    if W.is_number(w):
        return []
    if isinstance(w, str):
        return [(w, True)]
    op, a = W.parts(w)
    if op == "*":
        x = [_factors(v) for v in a]
        return None if None in x else x[0] + x[1]
    if op == "not" and isinstance(a[0], str):
        return [(a[0], False)]
    if op == "-" and W.is_number(a[0]) and a[0] == 1 and isinstance(a[1], str):
        return [(a[1], False)]
    if op == "/" and W.is_number(a[1]):
        return _factors(a[0])
    return None


def _closed_form(m, cons, counts):
    group = {p: tuple(g) for g in cons.get("norm", []) for p in g}
    prob = set(cons.get("prob", []))
    if cons.get("rate"):
        return None
    yes: dict = {}
    no: dict = {}
    for s, k, e in m.all_edges():
        w = W.bind(e.weight, m.defs) if m.defs else e.weight
        f = _factors(w)
        if f is None or any((p not in group and p not in prob) or (not positive and p not in prob) for p, positive in f):
            return None
        for p, positive in f:
            d = yes if positive else no
            d[p] = d.get(p, 0.0) + counts.get((s, k), 0.0)
    out = {}
    for g in cons.get("norm", []):
        total = sum(yes.get(p, 0.0) for p in g)
        out |= {p: yes.get(p, 0.0) / total if total else 1 / len(g) for p in g}
    for p in prob:
        total = yes.get(p, 0.0) + no.get(p, 0.0)
        out[p] = yes.get(p, 0.0) / total if total else 0.5
    return out


def _bfgs(m, cons, counts, fixed, start, rounds: int = 100):
    names, decode = [], []
    for g in cons.get("norm", []):  # stick breaking
        decode.append(("norm", g, slice(len(names), len(names) + len(g) - 1)))
        names += g[:-1]
    for kind in ("prob", "rate"):
        for p in cons.get(kind, []):
            decode.append((kind, [p], slice(len(names), len(names) + 1)))
            names.append(p)

    def values(x):
        out = {}
        for kind, g, at in decode:
            if kind == "norm":
                left = 1.0
                for p, v in zip(g[:-1], x[at], strict=True):
                    share = np.exp(-(v**2))
                    out[p] = left * share
                    left *= 1 - share
                out[g[-1]] = left
            else:
                v = x[at][0]
                out[g[0]] = float(np.exp(-(v**2)) if kind == "prob" else v**2)
        return out

    edges = [(e.weight, counts.get((s, k), 0.0)) for s, k, e in m.all_edges() if counts.get((s, k), 0.0) > 0]

    def loss(x):
        v = {**m.defs, **fixed, **values(x)}
        total = 0.0
        for w, c in edges:
            y = W.evaluate(w, v)
            if not y > 0:
                return 1e30
            total -= c * np.log(y)
        return total

    def gradient(x, h=1e-6):
        return np.array([(loss(x + h * e) - loss(x - h * e)) / (2 * h) for e in np.eye(len(x))])

    x = []
    for kind, g, _ in decode:
        if kind == "norm":
            left = 1.0
            for p in g[:-1]:
                share = min(max(start[p] / max(left, 1e-12), 1e-6), 1 - 1e-6)
                x.append(np.sqrt(-np.log(share)))
                left -= start[p]
        else:
            v = start[g[0]]
            x.append(np.sqrt(-np.log(min(max(v, 1e-6), 1 - 1e-6))) if kind == "prob" else np.sqrt(max(v, 1e-6)))
    x = np.array(x)
    h, g, f = np.eye(len(x)), gradient(x), loss(x)
    for _ in range(rounds):
        if np.abs(g).max(initial=0) < 1e-5:
            break
        step = -h @ g
        t = 1.0
        while loss(x + t * step) > f + 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        s = t * step
        new = gradient(x + s)
        y = new - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            a = np.eye(len(x)) - r * np.outer(s, y)
            h = a @ h @ a.T + r * np.outer(s, s)
        x, g, last, f = x + s, new, f, loss(x + s)
        if last - f < 1e-10 * max(1, abs(f)):
            break
    return values(x)


def fit(df: DataFrame, m: Machine, inp=None, out=None, cons: dict | None = None, start: dict | None = None, fixed: dict | None = None, tolerance: float = 0.001, most: int = 1000) -> tuple[dict, list[float]]:
    """EM until the relative gain falls below ``tolerance``; parameters and log likelihoods.

    One Spark job a round; what comes back is one number an edge.
    """
    cons = merge_constraints(m.cons, cons or {})
    params = seed_params(cons) | (start or {})
    history: list[float] = []
    df = df.cache()
    try:
        for _ in range(most):
            rows = infer.edge_counts(df, m, inp, out, {**(fixed or {}), **params}).collect()
            got = {(r.src, r.ord): r.cnt for r in rows}
            ll = got.pop((-1, 0), 0.0)
            got.pop((-2, 0), None)
            if history and (ll - history[-1]) / max(abs(history[-1]), 1e-12) < tolerance:
                history.append(ll)
                break
            history.append(ll)
            params = maximise(m, cons, got, fixed or {}, params)
    finally:
        df.unpersist()
    return params, history
