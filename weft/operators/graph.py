"""Products and order-sensitive graph rewrites (driver side)."""

from __future__ import annotations

import heapq
import json

import numpy as np

from weft.functions import weights as W
from weft.operators import algebra as A
from weft.plans.machine import Edge, Machine


def accumulate(m: Machine) -> Machine:
    """Merge parallel edges, adding weights; edges in order of (dst, in, out)."""
    out = []
    for es in m.edges:
        by: dict = {}
        for e in es:
            k = (e.dst, e.inp, e.out)
            by[k] = W.add(by[k], e.weight) if k in by else e.weight
        out.append([Edge(*k, w) for k, w in sorted(by.items(), key=lambda x: x[0])])
    return Machine(out, list(m.names), m.defs, m.cons)


def keep(m: Machine, states: list[int]) -> Machine:
    new = {s: k for k, s in enumerate(states)}
    edges = [[e.to(new[e.dst]) for e in m.edges[s] if e.dst in new] for s in states]
    return Machine(edges, [m.names[s] for s in states], m.defs, m.cons)


def ergodic(m: Machine) -> Machine:
    """States on some path from start to end; silent weight-1 states with one exit are skipped (start and end never)."""
    live = m.accessible()
    if not live:
        return Machine([[], []], None, m.defs, m.cons)
    m = keep(m, live)
    skip = {s: m.edges[s][0].dst for s in range(1, m.end) if len(m.edges[s]) == 1 and m.edges[s][0].silent() and m.edges[s][0].weight == 1 and W.is_number(m.edges[s][0].weight)}
    for s in list(skip):  # a ring of such states stays
        seen, t = {s}, skip.get(s)
        while t in skip and t not in seen:
            seen.add(t)
            t = skip[t]
        if t in seen:
            skip.pop(s)
    if not skip:
        return m

    def goal(d):
        while d in skip:
            d = skip[d]
        return d

    m = Machine([[e.to(goal(e.dst)) for e in es] for es in m.edges], m.names, m.defs, m.cons)
    return keep(m, [s for s in range(len(m)) if s not in skip])


def waiting(m: Machine) -> Machine:
    """Split states that mix input and other edges, so every state waits or continues; an end that continues is split too."""
    split = [not m.waits(s) and (not m.continues(s) or s == m.end) for s in range(len(m))]
    if not any(split):
        return m
    at, n = [], 0
    for s in split:
        at.append(n)
        n += 1 + s
    edges, names = [], []
    for s, es in enumerate(m.edges):
        moved = [e.to(at[e.dst]) for e in es]
        if split[s]:
            edges += [[*[e for e in moved if not e.inp], Edge(at[s] + 1)], [e for e in moved if e.inp]]
            names += [m.names[s], {"wait": m.names[s]}]
        else:
            edges.append(moved)
            names.append(m.names[s])
    return Machine(edges, names, m.defs, m.cons)


def advance_sort(m: Machine, must=Edge.silent) -> Machine:
    """Order states so that few must-advance edges go back: greedy scheduling, start first and end last."""
    before = m.back_edges(must)
    if not before or len(m) < 3:
        return m
    best = _scheduled(m, must)
    if best.back_edges(must) >= before:
        best = m
    if best.back_edges(must):
        padded = A.pad(m)
        tried = _scheduled(padded, must)
        if tried.back_edges(must) < best.back_edges(must):
            best = tried
    return best


def _scheduled(m, must):
    n, end = len(m), m.end
    into, out = [0] * n, [[] for _ in range(n)]
    for s, _, e in m.all_edges():
        if must(e) and e.dst != s and {s, e.dst}.isdisjoint({0, end}):
            into[e.dst] += 1
            out[s].append(e.dst)
    key = lambda s: (into[s], into[s] - len(out[s]), s)
    heap, order, done = [key(s) for s in range(1, end)], [0], {0, end}
    heapq.heapify(heap)
    while heap:
        k = heapq.heappop(heap)
        s = k[2]
        if s in done or k != key(s):
            continue
        done.add(s)
        order.append(s)
        for d in out[s]:
            into[d] -= 1
            if d not in done:
                heapq.heappush(heap, key(d))
    return keep(m, [*order, end])


def break_cycles(m: Machine, must=Edge.silent) -> Machine:
    """Drop must-advance edges that go back."""
    return Machine([[e for e in es if not (must(e) and e.dst <= s)] for s, es in enumerate(m.edges)], m.names, m.defs, m.cons)


def sum_cycles(m: Machine) -> Machine:
    """Make silent edges go forward only, exactly: Gaussian elimination with symbolic weights."""
    if m.is_advancing():
        return m
    if any(e.silent() for e in m.edges[m.end]):
        m = Machine([*m.edges[:-1], [*m.edges[-1], Edge(len(m))], []], [*m.names, None], m.defs, m.cons)
    done: list[list[Edge]] = []
    for s, es in enumerate(m.edges):
        quiet: dict[int, object] = {}
        loud: dict[tuple, object] = {}

        def put(e, w=1, quiet=quiet, loud=loud):
            v = W.mul(w, e.weight)
            at, k = (quiet, e.dst) if e.silent() else (loud, (e.dst, e.inp, e.out))
            at[k] = W.add(at[k], v) if k in at else v

        for e in es:
            put(e)
        while (back := min(quiet, default=s)) < s:
            w = quiet.pop(back)
            for e in done[back]:
                put(e, w)
        turn = quiet.pop(s, None)
        scale = 1 if turn is None else W.geometric(turn)
        done.append([Edge(d, i, o, W.mul(scale, w)) for (d, i, o), w in sorted(loud.items())] + [Edge(d, weight=W.mul(scale, w)) for d, w in sorted(quiet.items())])
    return Machine(done, m.names, m.defs, m.cons)


def _finish(m: Machine, cycles: str) -> Machine:
    m = ergodic(m)
    if cycles == "leave":
        return m
    m = advance_sort(m)
    return ergodic(break_cycles(m) if cycles == "break" else sum_cycles(m))


def _product(a: Machine, b: Machine, moves, cycles: str, collapse: bool) -> Machine:
    named = any(n is not None for n in a.names) and any(n is not None for n in b.names)
    start, goal = (0, 0), (a.end, b.end)
    edges, todo = {}, [start]
    while todo:
        s = todo.pop()
        if s in edges:
            continue
        edges[s] = moves(*s)
        todo += [d for d, *_ in edges[s] if d not in edges]
    edges.setdefault(goal, moves(*goal))
    order = sorted(edges)
    if order[-1] != goal:
        order.remove(goal)
        order.append(goal)
    at = {s: k for k, s in enumerate(order)}
    # targets of the goal's own edges may be new
    out = [[Edge(at[d], i, o, w) for d, i, o, w in edges[s] if d in at] for s in order]
    names = [[a.names[i], b.names[j]] for i, j in order] if named else None
    m = Machine(out, names, A.merge_defs(a.defs, b.defs), A.merge_constraints(a.cons, b.cons))
    return _finish(accumulate(m) if collapse else m, cycles)


def compose(a: Machine, b: Machine, cycles: str = "sum") -> Machine:
    """a's outputs feed b's inputs; each silent path is made once (b in waiting form)."""
    b = waiting(b)
    takes = [{} for _ in b.edges]
    for j, es in enumerate(b.edges):
        for e in es:
            takes[j].setdefault(e.inp, []).append(e)

    def moves(i, j):
        if not b.waits(j):
            return [((i, e.dst), "", e.out, e.weight) for e in b.edges[j]]
        out = []
        for e in a.edges[i]:
            if not e.out:
                out.append(((e.dst, j), e.inp, "", e.weight))
            for f in takes[j].get(e.out, ()) if e.out else ():
                out.append(((e.dst, f.dst), e.inp, f.out, W.mul(e.weight, f.weight)))
        return out

    return _product(a, b, moves, cycles, True)


def intersect(a: Machine, b: Machine, cycles: str = "sum") -> Machine:
    """Both read the same input; weights multiply."""
    if a.outputs() or b.outputs():
        raise ValueError("intersection is for machines without outputs")
    b = waiting(b)

    def moves(i, j):
        if not b.waits(j):
            return [((i, e.dst), "", "", e.weight) for e in b.edges[j]]
        out = []
        for e in a.edges[i]:
            if not e.inp:
                out.append(((e.dst, j), "", "", e.weight))
            out += [((e.dst, f.dst), e.inp, "", W.mul(e.weight, f.weight)) for f in b.edges[j] if e.inp and f.inp == e.inp]
        return out

    return _product(a, b, moves, cycles, False)


def revcomp(m: Machine) -> Machine:
    from weft.functions.presets import preset

    return compose(A.reverse(m), preset("comprna" if {"U", "u"} & set(m.outputs()) else "compdna"))


def double_strand(m: Machine) -> Machine:
    return A.union(m, revcomp(m), 0.5)


def sort(m: Machine, cycles: str = "sum") -> Machine:
    m = advance_sort(m)
    return m if cycles == "leave" else break_cycles(m) if cycles == "break" else sum_cycles(m)


def decode_sort(m):
    return advance_sort(m, lambda e: not e.out)


def encode_sort(m):
    return advance_sort(m, lambda e: not e.inp)


def full_sort(m):
    return advance_sort(m, lambda e: True)


def eliminate_silent(m: Machine) -> Machine:
    """No silent edges but possibly one from start to end."""
    m = sum_cycles(advance_sort(m))
    if m.edges[m.end]:  # so that reaching the end is final
        m = Machine([*m.edges[:-1], [*m.edges[-1], Edge(len(m))], []], [*m.names, None], m.defs, m.cons)
        m = sum_cycles(m)
    n, end = len(m), m.end
    loud: list[list[Edge]] = [[] for _ in range(n)]
    stop: list = [0] * n  # silent weight to the end
    stop[end] = 1
    for s in range(n - 1, -1, -1):
        for e in m.edges[s]:
            if not e.silent():
                loud[s].append(e)
            else:
                stop[s] = W.add(stop[s], W.mul(e.weight, stop[e.dst]))
                loud[s] += [x.to(x.dst, weight=W.mul(e.weight, x.weight)) for x in loud[e.dst]]
    edges = []
    for s in range(n):
        out = []
        for e in loud[s]:
            if e.dst == end or any(not x.silent() for x in m.edges[e.dst]) or loud[e.dst]:
                out.append(e)
            if e.dst != end and stop[e.dst] != 0:
                out.append(e.to(end, weight=W.mul(e.weight, stop[e.dst])))
        edges.append(out)
    names = list(m.names)
    if end and stop[0] != 0:
        if any(e.dst == 0 for es in edges for e in es):  # the start is entered again, where stopping is an edge already: give it a twin
            edges = [[e.to(e.dst + 1) for e in es] for es in edges]
            edges.insert(0, list(edges[0]))
            names.insert(0, names[0])
            end += 1
        edges[0] = [*edges[0], Edge(end, weight=stop[0])]
    return ergodic(accumulate(Machine(edges, names, m.defs, m.cons)))


def eliminate_states(m: Machine) -> Machine:
    """Contract states whose only way in, or only way out, is one silent edge."""
    while True:
        into: dict = {}
        for s, _, e in m.all_edges():
            into.setdefault(e.dst, []).append((s, e))
        for s in range(1, m.end):
            es = m.edges[s]
            if len(es) == 1 and es[0].silent() and es[0].dst != s:
                w, d = es[0].weight, es[0].dst
                edges = [[e.to(d, weight=W.mul(e.weight, w)) if e.dst == s else e for e in x] for x in m.edges]
                break
            if len(into.get(s, [])) == 1 and into[s][0][1].silent() and into[s][0][0] != s:
                p, e0 = into[s][0]
                edges = [list(x) for x in m.edges]
                edges[p] = [e for e in edges[p] if e is not e0] + [e.to(e.dst, weight=W.mul(e0.weight, e.weight)) for e in es]
                break
        else:
            return m
        m = keep(Machine(edges, m.names, m.defs, m.cons), [k for k in range(len(m)) if k != s])


def merge_states(m: Machine) -> Machine:
    """Merge states with equal futures until nothing changes; the end is never merged away."""
    m = ergodic(m)
    while True:
        m = accumulate(m)
        first: dict = {}
        to = []
        for s, es in enumerate(m.edges):
            key = (s == m.end, json.dumps([(e.dst, e.inp, e.out, e.weight) for e in es], sort_keys=True))
            to.append(first.setdefault(key, s))
        if len(first) == len(m):
            return m
        edges = [[e.to(to[e.dst]) for e in es] for es in m.edges]
        m = keep(Machine(edges, m.names, m.defs, m.cons), [s for s in range(len(m)) if to[s] == s])


def subgraph(m: Machine, flags: set[tuple[int, int]]) -> Machine:
    edges = [[e for k, e in enumerate(es) if (s, k) in flags] for s, es in enumerate(m.edges)]
    return eliminate_states(ergodic(Machine(edges, m.names, m.defs, m.cons)))


# down-sampling: keep the likely part of a machine
def _posteriors(m: Machine, values: dict | None):
    n = len(m)
    t = np.zeros((n, n))
    edges = [(s, k, e.dst, float(W.evaluate(e.weight, {**m.defs, **(values or {})}))) for s, k, e in m.all_edges()]
    for s, _, d, w in edges:
        t[s, d] += w
    inv = np.linalg.inv(np.eye(n) - t)
    ahead, back = inv[0], inv[:, -1]
    z = inv[0, -1]
    return [(ahead[s] * w * back[d] / z, s, k, d, w) for s, k, d, w in edges], z


def _best(n, edges, start, forward):
    score, via = np.full(n, -np.inf), {}
    score[start] = 0
    for _ in range(n):
        moved = False
        for _, s, k, d, w in edges:
            a, b = (s, d) if forward else (d, s)
            if w > 0 and score[a] + np.log(w) > score[b] + 1e-12:
                score[b] = score[a] + np.log(w)
                via[b] = (s, k, a)
                moved = True
        if not moved:
            break
    return via


def _trace(via, at):
    out, seen = set(), set()
    while at in via and at not in seen:
        seen.add(at)
        s, k, at = via[at]
        out.add((s, k))
    return out


def downsample(m: Machine, size: float = 1.0, prob: float = 0.0, values: dict | None = None) -> Machine:
    """Edges by falling posterior, each with the best path through it, up to a share of edges or down to a posterior."""
    post, _ = _posteriors(m, values)
    ahead, back = _best(len(m), post, 0, True), _best(len(m), post, m.end, False)
    kept: set = set()
    for p, s, k, d, w in sorted(post, key=lambda x: (-x[0], x[1], x[2])):
        if len(kept) >= size * len(post) or p < prob:
            break
        if p > 0:
            kept |= {(s, k)} | _trace(ahead, s) | _trace(back, d)
    return subgraph(m, kept)


def downsample_paths(m: Machine, paths: int | None = None, fraction: float = 1.0, seed: int = 0, values: dict | None = None, most: int = 100_000) -> Machine:
    """The union of sampled paths: ``paths`` of them, or until a share of all edges is covered."""
    post, _ = _posteriors(m, values)
    by: dict = {}
    for p, s, k, d, w in post:
        by.setdefault(s, []).append((p, k, d))
    rng, kept, n = np.random.default_rng(seed), set(), 0
    while n < (paths if paths is not None else most) and (paths is not None or len(kept) < fraction * len(post)):
        s = 0
        while s in by and s != m.end:
            p = np.array([x[0] for x in by[s]])
            _, k, d = by[s][rng.choice(len(p), p=p / p.sum())]
            kept.add((s, k))
            s = d
        n += 1
    return subgraph(m, kept)
