"""Constructors and the algebra that keeps or appends states (driver side; machines are small)."""

from __future__ import annotations

import json

from weft.functions import weights as W
from weft.plans.machine import Edge, Machine, merge_constraints, merge_defs

ALPHABETS = {"dna": list("ACGT"), "rna": list("ACGU"), "aa": list("ACDEFGHIKLMNPQRSTVWY")}


# constructors
def _chain(symbols, kind: str, name=None) -> Machine:
    symbols = list(symbols)
    label = {"generate": lambda c: ("", c), "recognize": lambda c: (c, ""), "echo": lambda c: (c, c)}[kind]
    text = name if name is not None else "".join(symbols)
    return Machine([*[[Edge(k + 1, *label(c))] for k, c in enumerate(symbols)], []], [[text, k] for k in range(len(symbols) + 1)])


def generate(symbols, name=None):
    return _chain(symbols, "generate", name)


def recognize(symbols, name=None):
    return _chain(symbols, "recognize", name)


def echo(symbols, name=None):
    return _chain(symbols, "echo", name)


def _alphabet(a) -> list[str]:
    return ALPHABETS.get(a, list(a)) if isinstance(a, str) else list(a)


def wild(kind: str, alphabet) -> Machine:
    io = {"generate": lambda c: ("", c), "recognize": lambda c: (c, ""), "echo": lambda c: (c, c)}[kind]
    return Machine([[Edge(0, *io(c)) for c in _alphabet(alphabet)]])


def one(kind: str, alphabet) -> Machine:
    return Machine([[e.to(1) for e in wild(kind, alphabet).edges[0]], []])


def iid(kind: str, alphabet, weight: str = "$p%") -> Machine:
    return (weight_input if kind == "recognize" else weight_output)(wild(kind, alphabet), weight)


def uniform(kind: str, alphabet) -> Machine:
    return iid(kind, alphabet, "1/#")


def weight(w) -> Machine:
    return Machine([[Edge(1, weight=W.parse_json(w))], []])


def null() -> Machine:
    return Machine([[]])


def zero() -> Machine:
    return Machine([[], []])


# relabelling
def _map(m: Machine, f) -> Machine:
    return Machine([[f(e) for e in es] for es in m.edges], list(m.names), dict(m.defs), dict(m.cons))


def transpose(m):
    return _map(m, lambda e: e.to(e.dst, inp=e.out, out=e.inp))


def silence_input(m):
    return _map(m, lambda e: e.to(e.dst, inp=""))


def silence_output(m):
    return _map(m, lambda e: e.to(e.dst, out=""))


def copy_input_to_output(m):
    if m.outputs():
        raise ValueError("the machine has outputs already")
    return _map(m, lambda e: e.to(e.dst, out=e.inp))


def copy_output_to_input(m):
    if m.inputs():
        raise ValueError("the machine has inputs already")
    return _map(m, lambda e: e.to(e.dst, inp=e.out))


def reciprocal(m):
    return _map(m, lambda e: e.to(e.dst, weight=W.div(1, e.weight)))


def strip_names(m):
    return Machine(m.edges, [None] * len(m), m.defs, m.cons)


def weight_input(m, text):
    n = len(m.inputs())
    return _map(m, lambda e: e.to(e.dst, weight=W.mul(e.weight, W.macro(text, e.inp, n))) if e.inp else e)


def weight_output(m, text):
    n = len(m.outputs())
    return _map(m, lambda e: e.to(e.dst, weight=W.mul(e.weight, W.macro(text, e.out, n))) if e.out else e)


def _p(p):
    if not isinstance(p, str):
        return W.parse_json(p)
    try:
        return W.parse_json(json.loads(p))
    except ValueError:
        return W.parse_infix(p)


def weight_input_geom(m, p):
    p = _p(p)
    out = _map(m, lambda e: e.to(e.dst, weight=W.mul(e.weight, p)) if e.inp else e)
    return concat(out, Machine([[Edge(1, weight=W.negate(p))], []]))


def weight_output_geom(m, p):
    return transpose(weight_input_geom(transpose(m), p))


def joint_norm(m):
    return Machine([[e.to(e.dst, weight=W.div(e.weight, W.total(x.weight for x in es))) for e in es] for es in m.edges], list(m.names), m.defs, m.cons)


def cond_norm(m):
    return Machine(
        [[e.to(e.dst, weight=W.div(e.weight, W.total(x.weight for x in es if x.inp == e.inp))) for e in es] for es in m.edges], list(m.names), m.defs, m.cons
    )


def reverse(m):
    last = m.end
    edges = [[] for _ in m.edges]
    for s in range(last, -1, -1):
        for e in m.edges[s]:
            edges[last - e.dst].append(e.to(last - s))
    return Machine(edges, m.names[::-1], m.defs, m.cons)


# building from parts
def _named(m, tag):
    return [None if n is None else [tag, n] for n in m.names]


def _shift(m, by):
    return [[e.to(e.dst + by) for e in es] for es in m.edges]


def _both(a, b):
    return merge_defs(a.defs, b.defs), merge_constraints(a.cons, b.cons)


def concat(a, b):
    edges = [*[list(es) for es in a.edges], *_shift(b, len(a))]
    edges[a.end] = [*edges[a.end], Edge(len(a))]
    return Machine(edges, _named(a, "concat-l") + _named(b, "concat-r"), *_both(a, b))


def union(a, b, p=None):
    p, q = (1, 1) if p is None else (p, W.negate(p))
    end = len(a) + len(b) + 1
    ea, eb = _shift(a, 1), _shift(b, 1 + len(a))
    ea[-1] = [*ea[-1], Edge(end)]
    eb[-1] = [*eb[-1], Edge(end)]
    return Machine([[Edge(1, weight=p), Edge(1 + len(a), weight=q)], *ea, *eb, []], [None, *_named(a, "union-1"), *_named(b, "union-2"), None], *_both(a, b))


def optional(m):
    edges, names = [list(es) for es in m.edges], _named(m, "quant-main")
    if edges[-1] or len(edges) == 1:
        edges[-1].append(Edge(len(edges)))
        edges.append([])
        names.append(["quant-end"])
    edges[0].append(Edge(len(edges) - 1))
    return Machine(edges, names, m.defs, m.cons)


def plus(m):
    edges = [[Edge(1)], *_shift(m, 1), []]
    edges[len(m)] = [*edges[len(m)], Edge(1), Edge(len(m) + 1)]
    return Machine(edges, [None, *_named(m, "kleene-plus"), None], m.defs, m.cons)


def star(m):
    return optional(plus(m))


def loop(x, y):
    """x (y x)*"""
    n, k = len(x), len(y)
    edges = [*[list(es) for es in x.edges], *_shift(y, n), []]
    edges[n - 1] = [*edges[n - 1], Edge(n), Edge(n + k)]
    edges[n + k - 1] = [*edges[n + k - 1], Edge(0)]
    return Machine(edges, [*_named(x, "loop-main"), *_named(y, "loop-continue"), ["loop-end"]], *_both(x, y))


def count_copies(m, p: str):
    out = star(concat(Machine([[Edge(1, weight=p)], []]), m))
    out.defs = {**out.defs, p: 1}
    return out


def repeat(m, n: int):
    if n < 1:
        raise ValueError("repeat needs a positive number")
    out = m
    for _ in range(n - 1):
        out = concat(out, m)
    return out


def flank(m, y):
    return concat(concat(y, m), y)


def flank_wild(m, side: str):
    """side: input, output, either, both."""
    i, o = wild("recognize", m.inputs()), wild("generate", m.outputs())
    return flank(m, {"input": i, "output": o, "either": union(i, o), "both": concat(i, o)}[side])


def flank_geom(m, side: str, p):
    f = weight_input_geom(wild("recognize", m.inputs()), p) if side == "input" else weight_output_geom(wild("generate", m.outputs()), p)
    return flank(m, f)


def pad(m):
    edges = [[Edge(1)], *_shift(m, 1), []]
    edges[len(m)] = [*edges[len(m)], Edge(len(m) + 1)]
    return Machine(edges, [None, *m.names, None], m.defs, m.cons)
