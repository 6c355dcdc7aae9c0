"""Small machines and their JSON, used by several tests."""

import math

from weft.plans.machine import Edge, Machine

#: A letter is kept or slips to the next one of the ring a, b, c; a dash stays.
SLIP = {"state": [{"id": "typist", "trans": [*[{"in": x, "out": y, "to": "typist", "weight": w} for x, z in ("ab", "bc", "ca") for y, w in ((x, "keep"), (z, "slip"))], {"in": "-", "out": "-", "to": "typist"}]}]}
#: Every letter may be followed by dashes.
DASHES = {
    "state": [
        {"id": "read", "trans": [*[{"in": x, "out": x, "to": "said"} for x in "abc"], {"to": "over", "weight": 0.6}]},
        {"id": "said", "trans": [{"out": "-", "to": "said", "weight": 0.25}, {"to": "read", "weight": 0.75}]},
        {"id": "over"},
    ]
}
#: Copies the letter u; an omission comes in runs of its own state, an addition doesn't.
RUNS = {
    "state": [
        {"id": "copy", "trans": [{"in": "u", "out": "u", "to": "copy", "weight": {"*": ["calm", {"-": [1, "open"]}]}}, {"in": "u", "to": "skip", "weight": {"*": ["calm", "open"]}}, {"out": "u", "to": "copy", "weight": {"-": [1, "calm"]}}, {"to": "done", "weight": 0.5}]},
        {"id": "skip", "trans": [{"in": "u", "to": "skip", "weight": "more"}, {"in": "u", "out": "u", "to": "copy", "weight": {"-": [1, "more"]}}, {"to": "done", "weight": 0.5}]},
        {"id": "done"},
    ]
}
KEEP = {"keep": 0.8, "slip": 0.2}
RUN = {"calm": 0.9, "open": 0.3, "more": 0.4}


def all_paths(m, x, y, values=None, best=False) -> float:
    """Log score by following every path, for machines without silent cycles."""
    from weft.functions import weights as W

    v = {**m.defs, **(values or {})}

    def follow(s, i, o):
        out = [1.0] if (s, i, o) == (m.end, len(x), len(y)) else []
        for e in m.edges[s]:
            if (not e.inp or x[i : i + 1] == e.inp) and (not e.out or y[o : o + 1] == e.out):
                out.append(W.evaluate(e.weight, v) * follow(e.dst, i + bool(e.inp), o + bool(e.out)))
        return (max(out, default=0.0)) if best else sum(out)

    z = follow(0, 0, 0)
    return math.log(z) if z > 0 else -math.inf


def random_machine(rng, n, ins, outs, degree=4) -> Machine:
    return Machine([[Edge(int(rng.integers(n)), str(rng.choice(ins)), str(rng.choice(outs)), float(rng.uniform(0.05, 0.3))) for _ in range(degree)] for _ in range(n)])


def score(m, x, y, values=None, ring=None):
    from weft.operators import kernels as K

    c = K.compile_machine(m, values)
    a, b = c.tokens(x, "in"), c.tokens(y, "out")
    return -K.INF if a is None or b is None else float(K.Grid(c, ring or K.SUM).fill([a], [b])[0])
