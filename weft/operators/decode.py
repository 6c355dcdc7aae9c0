"""Decoding: the most likely input of an observed output (or, transposed, output of an input)."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import algebra as A
from weft.operators import graph as G
from weft.operators import kernels as K
from weft.plans.machine import Machine


def beam(c: K.Compiled, y, width: int = 100) -> tuple[list[str], float]:
    """Per cell (output position, state) the ``width`` best input prefixes; equal prefixes add up."""
    order = np.argsort(c.src, kind="stable")
    cells: list[dict] = [{} for _ in range((len(y) + 1) * c.states)]
    cells[0][()] = 0.0
    for o in range(len(y) + 1):
        # edges without output stay at this position: relax in rounds until nothing new arrives
        todo = {s: dict(cells[o * c.states + s]) for s in range(c.states) if cells[o * c.states + s]}
        for _ in range(10 * c.states + 100):
            if not todo:
                break
            new: dict = {}
            for e in order:
                s = int(c.src[e])
                if s not in todo or c.out[e]:
                    continue
                for p, w in todo[s].items():
                    q = (*p, int(c.inp[e])) if c.inp[e] else p
                    d = new.setdefault(int(c.dst[e]), {})
                    v = w + c.lw[e]
                    d[q] = np.logaddexp(d[q], v) if q in d else v
            todo = {}
            for s, d in new.items():
                cell = cells[o * c.states + s]
                floor = sorted(cell.values())[-width] if len(cell) >= width else -np.inf
                d = {q: v for q, v in d.items() if v > max(floor - 30, -700)}
                for q, v in d.items():
                    cell[q] = np.logaddexp(cell[q], v) if q in cell else v
                if d:
                    todo[s] = d
        for s in range(c.states):
            cell = cells[o * c.states + s]
            if len(cell) > width:
                cell = dict(sorted(cell.items(), key=lambda x: (-x[1], x[0]))[:width])
                cells[o * c.states + s] = cell
            if o < len(y):
                for e in order[c.src[order] == s]:
                    if c.out[e] == y[o]:
                        t = cells[(o + 1) * c.states + int(c.dst[e])]
                        for p, w in cell.items():
                            q = (*p, int(c.inp[e])) if c.inp[e] else p
                            v = w + c.lw[e]
                            t[q] = np.logaddexp(t[q], v) if q in t else v
    last = cells[-1]
    if not last:
        return [], -np.inf
    best = min(last, key=lambda p: (-last[p], p))
    return [c.inputs[k - 1] for k in best], float(last[best])


class PrefixTree:
    """Exact prefix probabilities: what inputs starting with a prefix weigh in all."""

    def __init__(self, c: K.Compiled, y):
        self.c, self.y = c, y
        t = c.tensor(K.SUM)
        lin = np.exp(t)
        n, S = len(y), c.states
        # every way on without fixing further inputs: the input is free
        free = lin.sum(axis=0)
        self.close_free = np.linalg.inv(np.eye(S) - free[0])
        self.close = np.linalg.inv(np.eye(S) - lin[0, 0])
        self.lin, self.n, self.S = lin, n, S
        back = np.zeros((n + 1, S))
        back[n] = self.close_free[:, S - 1]
        for o in range(n - 1, -1, -1):
            back[o] = self.close_free @ (free[y[o]] @ back[o + 1])
        self.back = back
        start = np.zeros((n + 1, S))
        start[0, 0] = 1
        self.root = self._spread(start)

    def _spread(self, f):
        """Silent and output-only moves from (position, state) weights."""
        out = np.zeros_like(f)
        carry = np.zeros(self.S)
        for o in range(self.n + 1):
            out[o] = (f[o] + carry) @ self.close
            carry = out[o] @ self.lin[0, self.y[o]] if o < self.n else carry
        return out

    def child(self, f, tok):
        """Weights after one more input symbol."""
        g = np.zeros_like(f)
        for o in range(self.n + 1):
            g[o] += f[o] @ self.lin[tok, 0]
            if o < self.n:
                g[o + 1] += f[o] @ self.lin[tok, self.y[o]]
        return g

    def prefix(self, opened) -> float:
        return float((opened * self.back).sum())

    def final(self, f) -> float:
        return float(f[self.n, self.S - 1])


def prefix_search(c: K.Compiled, y, most: int = 100_000, backtrack: int | None = None) -> tuple[list[str], float]:
    """Best-first search over input prefixes; exact unless ``most`` nodes are used up or prefixes over ``backtrack`` shorter than the longest are given up."""
    t = PrefixTree(c, y)
    best, score = (), t.final(t.root)
    heap = [(-np.inf, 0, (), t.root)]
    n = deepest = 0
    while heap and n < most:
        p, _, seq, f = heapq.heappop(heap)
        if -p <= score:
            break
        deepest = max(deepest, len(seq))
        if backtrack is not None and len(seq) < deepest - backtrack:
            continue
        for tok in range(1, len(c.inputs) + 1):
            opened = t.child(f, tok)
            weight = t.prefix(opened)
            if weight <= score:
                continue
            g = t._spread(opened)
            n += 1
            s = (*seq, tok)
            if t.final(g) > score:
                best, score = s, t.final(g)
            heapq.heappush(heap, (-weight, n, s, g))
    return [c.inputs[k - 1] for k in best], float(np.log(score)) if score > 0 else -np.inf


def random_prefix(c: K.Compiled, y, rng) -> tuple[list[str], float]:
    """Draw an input by its probability given the output."""
    t = PrefixTree(c, y)
    f, seq = t.root, ()
    while True:
        kids = [t.child(f, k) for k in range(1, len(c.inputs) + 1)]
        w = np.array([t.final(f), *[t.prefix(k) for k in kids]])
        if not w.sum() > 0:
            return [], -np.inf
        k = int(rng.choice(len(w), p=w / w.sum()))
        if k == 0:
            return [c.inputs[s - 1] for s in seq], float(np.log(t.final(f)))
        seq, f = (*seq, k), t._spread(kids[k - 1])


def viterbi(c: K.Compiled, y) -> tuple[list[str], float]:
    """Inputs along the single best path."""
    flat = K.Compiled([], c.outputs, c.states, c.src, c.ord, c.dst, np.zeros_like(c.inp), c.out, c.lw)
    ll, path = K.trace(flat, np.zeros(0, np.int64), y)
    return [c.inputs[c.inp[e] - 1] for e in path if c.inp[e]], ll


def mcmc(c: K.Compiled, y, rng, steps: int = 10, cool: bool = False, start=None) -> tuple[list[str], float]:
    """Metropolis-Hastings over inputs with substitutions, deletions and insertions (``cool``: annealed); the best seen."""
    grid = K.Grid(c, K.SUM)
    fill = lambda x: float(grid.fill([np.array(x, np.int64)], [y])[0])
    x = list(start) if start is not None else [c.inputs.index(s) + 1 for s in viterbi(c, y)[0]]
    now = fill(x)
    best, top, A_ = list(x), now, len(c.inputs)
    total = steps * max(1, len(x))
    for k in range(total):
        heat = max(1e-3, 1 - k / total) if cool else 1.0
        n = len(x)
        slot = int(rng.integers(3 * n + 1))
        z = list(x)
        if slot < n and A_ > 1:  # substitute
            z[slot] = int((z[slot] - 1 + rng.integers(1, A_)) % A_) + 1
            q = 0.0
        elif n <= slot < 2 * n:  # delete; an insertion leads back
            del z[slot - n]
            q = np.log((3 * n + 1) / (3 * (n - 1) + 1) / A_)
        else:  # insert
            z.insert(int(rng.integers(n + 1)), int(rng.integers(1, A_ + 1)))
            q = np.log((3 * n + 1) / (3 * (n + 1) + 1) * A_)
        s = fill(z)
        if s > -np.inf and np.log(rng.random()) < (s - now) / heat + q:
            x, now = z, s
            if now > top:
                best, top = list(x), now
    return [c.inputs[k - 1] for k in best], top


METHODS = {"beam": beam, "prefix": prefix_search, "viterbi": viterbi, "random": random_prefix, "mcmc": mcmc, "cool": lambda c, y, rng, **o: mcmc(c, y, rng, cool=True, **o)}


def _spells(m: Machine) -> bool:
    """Whether the machine has one state and every edge writes one letter, so that letters can be decoded one by one."""
    return len(m) == 1 and all(e.out for e in m.edges[0])


def _letter_by_letter(df: DataFrame, m: Machine, seq: str, values: dict | None) -> DataFrame:
    """Viterbi decoding under a one-state machine as an expression: each output letter's best input, and its log weight."""
    c = K.compile_machine(m, values)
    best: dict = {}
    for i, o, w in sorted(zip(c.inp.tolist(), c.out.tolist(), c.lw.tolist(), strict=True), key=lambda e: (-e[2], e[0] == 0, e[0])):
        if w > -np.inf:
            best.setdefault(c.outputs[o - 1], (c.inputs[i - 1] if i else None, w))
    pick = lambda kind, at: F.create_map(*[x for k, v in best.items() for x in (F.lit(k), F.lit(v[at]).cast(kind))]) if best else F.create_map().cast(f"map<string,{kind}>")
    y = F.coalesce(F.col(seq), F.array().cast("array<string>"))
    letters, weights = pick("string", 0), pick("double", 1)
    known = F.forall(y, lambda s: F.coalesce(F.map_contains_key(weights, s), F.lit(False)))
    decoded = F.array_compact(F.transform(y, lambda s: F.element_at(letters, s)))
    ll = F.aggregate(F.transform(y, lambda s: F.element_at(weights, s)), F.lit(0.0), lambda a, w: a + w)
    return df.withColumns({"decoded": F.when(known, decoded), "decoded_ll": F.when(known, ll).otherwise(F.lit(float("-inf")))})


def decode(df: DataFrame, m: Machine, seq: str, method: str = "beam", values: dict | None = None, encode: bool = False, seed: int = 1, **options) -> DataFrame:
    """Add ``decoded`` (array of symbols) and ``decoded_ll`` for an output column (``encode``: the output of an input)."""
    m = A.transpose(m) if encode else m
    if method == "viterbi" and _spells(m):
        return _letter_by_letter(df, m, seq, values)
    c = K.compile_machine(G.sort(m, "sum") if not m.is_advancing() else m, values)
    bound = df.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        c = bound.value
        for b in batches:
            out, ll = [], []
            for v in b.column(seq).to_pylist():
                y = c.tokens(v or [], "out")
                if y is None:
                    out.append(None), ll.append(-np.inf)
                    continue
                extra = {"rng": np.random.default_rng([seed, *y.tolist()])} if method in ("random", "mcmc", "cool") else {}
                s, w = METHODS[method](c, y, **extra, **options)
                out.append(s), ll.append(w)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string())), pa.array(ll, pa.float64())], [*b.schema.names, "decoded", "decoded_ll"])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{cols}, decoded array<string>, decoded_ll double")
