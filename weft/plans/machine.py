"""Weighted transducers.

A machine is a list of states; state 0 is the start, the last one the end. The
driver holds it (machines are small); ``tables`` gives the relational form that
the DataFrame operators and broadcasts use.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weft.functions import weights as W

TRANS = "src int, ord int, dst int, in_sym string, out_sym string, weight string"
STATE = "state_idx int, name string"


@dataclass(frozen=True)
class Edge:
    dst: int
    inp: str = ""
    out: str = ""
    weight: object = 1

    def silent(self) -> bool:
        return not self.inp and not self.out

    def to(self, dst: int, **change) -> "Edge":
        return Edge(dst, change.get("inp", self.inp), change.get("out", self.out), change.get("weight", self.weight))


@dataclass
class Machine:
    edges: list[list[Edge]] = field(default_factory=list)
    names: list = field(default_factory=list)
    defs: dict = field(default_factory=dict)
    cons: dict = field(default_factory=dict)

    def __post_init__(self):
        self.names = self.names or [None] * len(self.edges)

    # facts
    def __len__(self):
        return len(self.edges)

    @property
    def end(self) -> int:
        return len(self.edges) - 1

    def all_edges(self):
        for s, es in enumerate(self.edges):
            for k, e in enumerate(es):
                yield s, k, e

    def inputs(self) -> list[str]:
        return sorted({e.inp for _, _, e in self.all_edges() if e.inp})

    def outputs(self) -> list[str]:
        return sorted({e.out for _, _, e in self.all_edges() if e.out})

    def params(self) -> set[str]:
        return set().union(set(), *(W.params(e.weight, self.defs) for _, _, e in self.all_edges()))

    def waits(self, s: int) -> bool:
        return all(e.inp for e in self.edges[s])

    def continues(self, s: int) -> bool:
        return not any(e.inp for e in self.edges[s])

    def is_waiting(self) -> bool:
        return all(self.waits(s) or self.continues(s) for s in range(len(self)))

    def back_edges(self, must=Edge.silent) -> int:
        return sum(1 for s, _, e in self.all_edges() if must(e) and e.dst <= s)

    def is_advancing(self) -> bool:
        return not self.back_edges()

    def is_decoding(self) -> bool:
        return not self.back_edges(lambda e: not e.out)

    def is_toposorted(self) -> bool:
        return not self.back_edges(lambda e: True)

    def is_ergodic(self) -> bool:
        return len(self.accessible()) == len(self)

    def is_aligning(self) -> bool:
        seen = set()
        for s, _, e in self.all_edges():
            if (s, e.inp, e.out, e.dst) in seen:
                return False
            seen.add((s, e.inp, e.out, e.dst))
        return True

    def accessible(self) -> list[int]:
        def reach(start, step):
            seen, todo = {start}, [start]
            while todo:
                for t in step[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return seen

        ahead = [[e.dst for e in es] for es in self.edges]
        back = [[] for _ in self.edges]
        for s, ds in enumerate(ahead):
            for d in ds:
                back[d].append(s)
        return sorted(reach(0, ahead) & reach(self.end, back)) if len(self) else []

    def stats(self) -> dict:
        by: dict = {}
        for s, _, e in self.all_edges():
            by[e.inp, e.out] = by.get((e.inp, e.out), 0) + 1
        silent = by.pop(("", ""), 0)
        return {"states": len(self), "transitions": sum(map(len, self.edges)), "conditioned": max(by.values(), default=0) + silent, "params": len(self.params())}

    def unconstrained(self) -> list[str]:
        known = {p for g in self.cons.get("norm", []) for p in g} | set(self.cons.get("prob", [])) | set(self.cons.get("rate", []))
        return sorted(self.params() - known)

    # JSON
    @classmethod
    def from_json(cls, x) -> "Machine":
        """A machine or a tree of machine expressions."""
        from weft.operators import algebra as A
        from weft.operators import graph as G

        if isinstance(x, str):
            x = json.loads(x)
        if not isinstance(x, dict):
            raise ValueError("a machine is a JSON object")
        sub = cls.from_json
        for op, cycles in (("compose", "break"), ("compose-sum", "sum"), ("compose-unsort", "leave")):
            if op in x:
                return G.compose(*map(sub, x[op]), cycles=cycles)
        for op, cycles in (("intersect", "break"), ("intersect-sum", "sum"), ("intersect-unsort", "leave")):
            if op in x:
                return G.intersect(*map(sub, x[op]), cycles=cycles)
        two = {"concat": A.concat, "union": A.union, "loop": A.loop}
        one = {
            "opt": A.optional, "star": A.star, "plus": A.plus, "reverse": A.reverse, "transpose": A.transpose,
            "eliminate": G.eliminate_silent, "merge": G.merge_states, "revcomp": G.revcomp,
        }
        for op, f in two.items():
            if op in x:
                return f(*map(sub, x[op]))
        for op, f in one.items():
            if op in x:
                return f(sub(x[op]))
        return cls._basic(x)

    @classmethod
    def _basic(cls, x: dict) -> "Machine":
        extra = set(x) - {"state", "defs", "cons"}
        if "state" not in x or not isinstance(x["state"], list) or not x["state"] or extra:
            raise ValueError(f"a machine needs a list 'state' and allows 'defs' and 'cons'; got {sorted(x)}")
        ids, twice = {}, set()
        for n, s in enumerate(x["state"]):
            if not isinstance(s, dict) or set(s) - {"n", "id", "trans"}:
                raise ValueError(f"bad state {n}")
            if "n" in s and s["n"] != n:
                raise ValueError(f"state {n} says it is {s['n']}")
            if "id" in s:
                if W.is_number(s["id"]):
                    raise ValueError("a state id can't be a number")
                key = json.dumps(s["id"])
                twice |= {key} & ids.keys()
                ids.setdefault(key, n)
        edges = []
        for n, s in enumerate(x["state"]):
            out = []
            if not isinstance(s.get("trans", []), list):
                raise ValueError(f"trans of state {n} is not a list")
            for t in s.get("trans", []):
                if not isinstance(t, dict) or "to" not in t or set(t) - {"to", "in", "out", "weight", "expr"}:
                    raise ValueError(f"bad transition in state {n}")
                if W.is_number(t["to"]):
                    dst = t["to"]
                else:
                    key = json.dumps(t["to"])
                    if key not in ids or key in twice:
                        raise ValueError(f"no such state, or several: {key}")
                    dst = ids[key]
                if not isinstance(dst, int) or not 0 <= dst < len(x["state"]):
                    raise ValueError(f"state {dst} does not exist")
                if any(k in t and (not isinstance(t[k], str) or not t[k]) for k in ("in", "out")):
                    raise ValueError(f"bad symbol in state {n}")
                w = W.parse_json(t["weight"]) if "weight" in t else W.parse_infix(t["expr"]) if "expr" in t else 1
                out.append(Edge(dst, t.get("in", ""), t.get("out", ""), w))
            edges.append(out)
        defs = {k: W.parse_json(v) for k, v in x.get("defs", {}).items()}
        W.check_defs(defs)
        return cls(edges, [s.get("id") for s in x["state"]], defs, read_constraints(x.get("cons", {})))

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> "Machine":
        if spark is None:
            with open(path, encoding="utf-8") as f:
                return cls.from_json(json.load(f))
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])

    def to_json(self, name_states: bool = False, define_exprs: bool = False, show_params: bool = False) -> dict:
        names, defs = list(self.names), dict(self.defs)
        count: dict = {}
        if name_states:
            for k, n in enumerate(names):
                key = json.dumps(n)
                count[key] = count.get(key, -1) + 1
                if n is None:
                    names[k] = f"s{k}"
                elif count[key]:
                    names[k] = [n, count[key]]
        weight = {e.weight if not isinstance(e.weight, dict) else json.dumps(e.weight): e.weight for _, _, e in self.all_edges()}
        short: dict = {}
        if define_exprs:
            short = common_expressions(list(weight.values()), self.params() | set(defs))
            defs |= {n: w for n, w in ((n, short["defs"][n]) for n in short["defs"])}
        out = []
        for k, es in enumerate(self.edges):
            s: dict = {"n": k}
            if names[k] is not None:
                s["id"] = names[k]
            ts = []
            for e in es:
                t: dict = {"to": names[e.dst] if name_states else e.dst}
                if e.inp:
                    t["in"] = e.inp
                if e.out:
                    t["out"] = e.out
                if e.weight != 1:
                    t["weight"] = short["use"](e.weight) if short else e.weight
                ts.append(t)
            if ts:
                s["trans"] = ts
            out.append(s)
        r: dict = {"state": out}
        if defs:
            r["defs"] = defs
        if self.cons:
            r["cons"] = self.cons
        if show_params:
            r["params"] = self.unconstrained()
        return r

    # relational form
    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(states, transitions) DataFrames."""
        states = [(k, None if n is None else json.dumps(n)) for k, n in enumerate(self.names)]
        rows = [(s, k, e.dst, e.inp, e.out, json.dumps(e.weight)) for s, k, e in self.all_edges()]
        return spark.createDataFrame(states, STATE), spark.createDataFrame(rows, TRANS)

    @classmethod
    def from_tables(cls, states: DataFrame, trans: DataFrame, defs: dict | None = None, cons: dict | None = None) -> "Machine":
        names = [None if r.name is None else json.loads(r.name) for r in states.orderBy("state_idx").collect()]
        edges: list[list[Edge]] = [[] for _ in names]
        for r in trans.orderBy("src", "ord").collect():
            edges[r.src].append(Edge(r.dst, r.in_sym or "", r.out_sym or "", json.loads(r.weight)))
        return cls(edges, names, defs or {}, cons or {})

    def evaluated(self, values: dict | None = None) -> "Machine":
        """All weights as numbers, definitions dropped."""
        v = {**self.defs, **(values or {})}
        return Machine([[e.to(e.dst, weight=float(W.evaluate(e.weight, v))) for e in es] for es in self.edges], list(self.names))

    def dot(self, merge: bool = True, show_io: bool = False) -> str:
        lines = ["digraph G {"]
        for k, n in enumerate(self.names):
            label = json.dumps(n if isinstance(n, str) else str(k) if n is None else json.dumps(n))
            lines.append(f"  {k} [label={label}{',shape=box' if show_io and self.continues(k) else ''}];")
        for s, es in enumerate(self.edges):
            groups: dict = {}
            for k, e in enumerate(es):
                groups.setdefault((e.dst, W.show(e.weight)) if merge else k, []).append(e)
            for es_ in groups.values():
                e = es_[0]
                io = ",".join(f"{x.inp or '-'}/{x.out or '-'}" for x in es_ if not x.silent())
                label = " ".join(x for x in (io, W.show(e.weight) if e.weight != 1 else "") if x)
                style = ",style=dashed,color=grey" if all(x.silent() for x in es_) else ""
                lines.append(f"  {s} -> {e.dst} [label={json.dumps(label)}{style}];")
        return "\n".join([*lines, "}"]) + "\n"


def common_expressions(ws: list, taken: set[str]) -> dict:
    """Names for subexpressions that occur twice or more."""
    prefix = "_"
    while any(n.startswith(prefix) for n in taken):
        prefix += "_"
    count: dict[str, int] = {}

    def visit(w):
        if isinstance(w, dict):
            key = json.dumps(w)
            count[key] = count.get(key, 0) + 1
            if count[key] == 1:
                for a in W.parts(w)[1]:
                    visit(a)

    for w in ws:
        visit(w)
    names = {k: f"{prefix}{i + 1}" for i, k in enumerate(k for k, n in count.items() if n > 1)}

    def use(w, top=True):
        if not isinstance(w, dict):
            return w
        key = json.dumps(w)
        if top and key in names:
            return names[key]
        op, a = W.parts(w)
        return {op: [use(x) for x in a] if isinstance(w[op], list) else use(a[0])}

    return {"defs": {n: use(json.loads(k), False) for k, n in names.items()}, "use": use}


def read_constraints(x: dict) -> dict:
    if not isinstance(x, dict) or set(x) - {"norm", "prob", "rate"}:
        raise ValueError("constraints are norm, prob and rate")
    flat = [p for g in x.get("norm", []) for p in g] + list(x.get("prob", [])) + list(x.get("rate", []))
    if len(flat) != len(set(flat)):
        raise ValueError("a parameter has two constraints")
    return {k: v for k, v in x.items() if v}


def merge_constraints(a: dict, b: dict) -> dict:
    out: dict = {}
    for k in ("norm", "prob", "rate"):
        out[k] = [*a.get(k, []), *[v for v in b.get(k, []) if v not in a.get(k, [])]]
    return read_constraints(out)


def merge_defs(a: dict, b: dict, overwrite: bool = False) -> dict:
    for k in a.keys() & b.keys():
        if a[k] != b[k] and not overwrite:
            raise ValueError(f"two definitions of {k}")
    return {**a, **b}
