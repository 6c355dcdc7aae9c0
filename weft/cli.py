"""Command line: an algebra of machines read left to right, then one thing to do with the result.

``python -m weft --generate-chars 101 --preset bintern --graphviz``. Adjacent
machines compose; parentheses group; options follow the machine they change.
"""

from __future__ import annotations

import json
import sys

import numpy as np

from weft.functions.presets import preset
from weft.operators import algebra as A
from weft.operators import decode as D
from weft.operators import graph as G
from weft.operators import kernels as K
from weft.plans.machine import Machine, merge_constraints, merge_defs, read_constraints
from weft.sources import formats as S
from weft.sources.regex import regex

UNARY = {
    "--transpose": A.transpose, "--silence-input": A.silence_input, "--silence-output": A.silence_output, "--copy-output-to-input": A.copy_output_to_input,
    "--copy-input-to-output": A.copy_input_to_output, "--reciprocal": A.reciprocal, "--joint-norm": A.joint_norm, "--cond-norm": A.cond_norm, "--reverse": A.reverse,
    "--revcomp": G.revcomp, "~": G.revcomp, "--double-strand": G.double_strand, "--zero-or-one": A.optional, "?": A.optional, "--kleene-star": A.star, "*": A.star,
    "--kleene-plus": A.plus, "+": A.plus, "--eliminate": G.eliminate_silent, "-n": G.eliminate_silent, "--eliminate-states": G.eliminate_states, "--merge-states": G.merge_states,
    "--sort": G.sort, "--sort-fast": lambda m: G.sort(m, "break"), "--sort-cyclic": lambda m: G.sort(m, "leave"), "--decode-sort": G.decode_sort, "--encode-sort": G.encode_sort,
    "--full-sort": G.full_sort, "--pad": A.pad, "--strip-names": A.strip_names, **{f"--flank-{s}-wild": (lambda s: lambda m: A.flank_wild(m, s))(s) for s in ("input", "output", "either", "both")},
}
UNARY_ARG = {
    "--weight-input": A.weight_input, "--weight-output": A.weight_output, "--weight-input-geom": A.weight_input_geom, "--weight-output-geom": A.weight_output_geom,
    "--count-copies": A.count_copies, "--repeat": lambda m, n: A.repeat(m, int(n)), "--flank-input-geom": lambda m, p: A.flank_geom(m, "input", p),
    "--flank-output-geom": lambda m, p: A.flank_geom(m, "output", p), "--downsample-size": lambda m, f: G.downsample(m, size=float(f)), "--downsample-prob": lambda m, p: G.downsample(m, prob=float(p)),
    "--downsample-path": lambda m, n: G.downsample_paths(m, paths=int(n)), "--downsample-frac": lambda m, f: G.downsample_paths(m, fraction=float(f)),
}
BINARY = {
    "--compose": G.compose, "-m": G.compose, "=>": G.compose, "--compose-fast": lambda a, b: G.compose(a, b, "break"), "--compose-cyclic": lambda a, b: G.compose(a, b, "leave"),
    "--intersect": G.intersect, "-i": G.intersect, "&&": G.intersect, "--intersect-fast": lambda a, b: G.intersect(a, b, "break"), "--intersect-cyclic": lambda a, b: G.intersect(a, b, "leave"),
    "--concatenate": A.concat, "-c": A.concat, ".": A.concat, "--union": A.union, "-u": A.union, "||": A.union, "--loop": A.loop, "-o": A.loop, "?+": A.loop, "--flank": A.flank, "-f": A.flank,
}


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _sources() -> dict:
    out = {"--load": lambda a: Machine.from_json(_read(a)), "--preset": preset, "--weight": lambda a: A.weight(A._p(a)), "#": lambda a: A.weight(A._p(a)), "--regex": regex}
    out |= {f"--{k}-regex": (lambda k: lambda a: regex(a, k))(k) for k in ("dna", "rna", "aa")}
    chain = {"generate": A.generate, "recognize": A.recognize, "echo": A.echo}
    for kind, f in chain.items():
        out[f"--{kind}-chars"] = f
        out[f"--{kind}-json"] = (lambda kind: lambda a: S.load_machine_source(kind, _read(a)))(kind)
        for shape, g in (("wild", A.wild), ("one", A.one), ("iid", A.iid), ("uniform", A.uniform)):
            out[f"--{kind}-{shape}"] = (lambda kind, g: lambda a: g(kind, a))(kind, g)
    out |= {"<<": A.generate, ">>": A.recognize}
    for mode in ("hmmer", "hmmer-global", "hmmer-plan7", "hmmer-multihit"):
        how = {"hmmer": ("local", False), "hmmer-global": ("global", False), "hmmer-plan7": ("plan7", False), "hmmer-multihit": ("plan7", True)}[mode]
        out[f"--{mode}"] = (lambda how: lambda a: S.hmmer_machine(S.read_hmmer(_read(a)), *how))(how)
    csv = lambda a: ((t := [x.split(",") for x in _read(a).split()])[0], [[float(v) for v in r] for r in t[1:]])
    out |= {"--generate-csv": lambda a: S.profile_machine(*csv(a)), "--recognize-csv": lambda a: S.profile_machine(*csv(a), kind="recognize"), "--recognize-merge-csv": lambda a: S.merged_profile(*csv(a))}
    out["--jphmm"] = lambda a: S.jumping_profile([s for _, s in fasta(_read(a))])
    for kind, f in chain.items():
        out[f"--{kind}-fasta"] = (lambda f: lambda a: f(*_single(a)))(f)
    return out


def fasta(text: str) -> list[tuple[str, str]]:
    """(name, sequence) of each record; records start with a sign at the start of a line."""
    records = [r.split("\n") for r in f"\n{text}".split("\n>")[1:]]
    return [((head.split() or [""])[0], "".join("".join(x.split()) for x in rest)) for head, *rest in records]


def _named(given: dict, side: str) -> list[dict]:
    """Sequences of one side from characters, FASTA files and JSON files."""
    out = [{"name": x, "sequence": list(x)} for x in given.get(f"--{side}-chars", [])]
    out += [{"name": n, "sequence": list(x)} for p in given.get(f"--{side}-fasta", []) for n, x in fasta(_read(p))]
    for p in given.get(f"--{side}-json", []):
        x = json.loads(_read(p))
        out += [{"name": r.get("name", ""), "sequence": list(r["sequence"])} for r in (x if isinstance(x, list) else [x])]
    return out


def _single(path):
    r = fasta(_read(path))
    if len(r) != 1:
        raise ValueError("one sequence is needed")
    return r[0][1], r[0][0]


SOURCES = _sources()


class Parser:
    def __init__(self, words: list[str]):
        self.w, self.i = words, 0

    def expression(self, close: str | None = None) -> Machine | None:
        m: Machine | None = None
        while self.i < len(self.w):
            t = self.w[self.i]
            if t == close:
                self.i += 1
                return m
            if t in BINARY:
                self.i += 1
                m = BINARY[t](m, self.operand())
            else:
                x = self.operand()
                m = x if m is None else G.compose(m, x)
        if close:
            raise ValueError("a bracket isn't closed")
        return m

    def operand(self) -> Machine:
        t = self.w[self.i]
        self.i += 1
        if t in ("(", "--begin"):
            m = self.expression(")" if t == "(" else "--end")
        elif t in SOURCES:
            m = SOURCES[t](self.w[self.i])
            self.i += 1
        else:
            base, _, alpha = t.rpartition("-")
            if base in SOURCES and alpha in A.ALPHABETS:
                m = SOURCES[base](A.ALPHABETS[alpha])
            elif t.startswith("-"):
                raise ValueError(f"unknown option {t}")
            else:
                m = SOURCES["--load"](t)
        while self.i < len(self.w) and (self.w[self.i] in UNARY or self.w[self.i] in UNARY_ARG):
            t = self.w[self.i]
            self.i += 1
            if t in UNARY:
                m = UNARY[t](m)
            else:
                m = UNARY_ARG[t](m, self.w[self.i])
                self.i += 1
        return m


FLAGS = {"--loglike": "-L", "--viterbi": "-V", "--align": "-A", "--counts": "-C", "--train": "-T", "--beam-decode": "-Z", "--prefix-decode": "", "--viterbi-decode": "", "--random-encode": "", "--cool-decode": "", "--mcmc-decode": "", "--beam-encode": "-Y", "--prefix-encode": "", "--viterbi-encode": "", "--graphviz": "-G", "--stats": "", "--evaluate": "", "--name-states": "", "--define-exprs": "", "--show-params": "", "--dot-no-merge": "", "--dot-show-io": ""}
WITH = {"--params": "-P", "--functions": "-F", "--constraints": "-N", "--input-chars": "", "--output-chars": "", "--data": "-D", "--save": "", "--seed": "", "--beam-width": "", "--decode-steps": "", "--input-fasta": "-I", "--output-fasta": "-O", "--input-json": "", "--output-json": "", "--wiggle-room": "-R", "--prefix-backtrack": ""}


def run(args: list[str]) -> object:
    """What the command prints: text, or something to be shown as JSON."""
    flags, given, words = set(), {}, []
    k = 0
    short = {v: n for n, v in {**FLAGS, **WITH}.items() if v}
    while k < len(args):
        t = short.get(args[k], args[k])
        if t in FLAGS:
            flags.add(t)
        elif t in WITH:
            k += 1
            given.setdefault(t, []).append(args[k])
        else:
            words.append(args[k])
        k += 1
    m = Parser(words).expression() or A.null()
    values: dict = {}
    for p in given.get("--params", []) + given.get("--functions", []):
        values |= json.loads(_read(p))
    for p in given.get("--constraints", []):
        m.cons = merge_constraints(m.cons, read_constraints(json.loads(_read(p))))
    for p in given.get("--functions", []):
        m.defs = merge_defs(m.defs, json.loads(_read(p)), True)
    if "--evaluate" in flags:
        m = m.evaluated(values)
    pairs = [S.pair_from_json(x) for p in given.get("--data", []) for x in json.loads(_read(p))]
    ins, outs, none = _named(given, "input"), _named(given, "output"), {"name": "", "sequence": []}
    if ins or outs:
        pairs += [{"input": a, "output": b} for a in ins or [none] for b in outs or [none]]
    for f in sorted(flags & {"--beam-decode", "--prefix-decode", "--viterbi-decode", "--random-encode", "--cool-decode", "--mcmc-decode", "--beam-encode", "--prefix-encode", "--viterbi-encode"}):
        method, _, way = f[2:].partition("-")
        enc = way == "encode"
        c = K.compile_machine(G.sort(A.transpose(m) if enc else m), values)
        extra = {"rng": np.random.default_rng(int(given.get("--seed", ["1"])[-1]))} if method in ("random", "mcmc", "cool") else {}
        if method in ("mcmc", "cool"):
            extra["steps"] = int(given.get("--decode-steps", ["10"])[-1])
        if method == "prefix" and "--prefix-backtrack" in given:
            extra["backtrack"] = int(given["--prefix-backtrack"][-1])
        if method == "beam":
            extra["width"] = int(given.get("--beam-width", ["100"])[-1])
        out = []
        for p in pairs:
            known = p["input" if enc else "output"]
            seq, ll = D.METHODS[method](c, c.tokens(known["sequence"], "out"), **extra)
            made = {"name": "", "sequence": seq}
            out.append({"input": known if enc else made, "output": made if enc else known, "meta": {"loglike": ll}})
        return out
    if flags & {"--loglike", "--viterbi", "--align", "--counts", "--train"}:
        return _infer(m, values, pairs, flags, int(given["--wiggle-room"][-1]) if "--wiggle-room" in given else None)
    if "--graphviz" in flags:
        return m.dot("--dot-no-merge" not in flags, "--dot-show-io" in flags)
    if "--stats" in flags:
        return m.stats()
    return m.to_json("--name-states" in flags, "--define-exprs" in flags, "--show-params" in flags)


def _allowed(p, room):
    """Cells within ``room`` matches of a pair's alignment; all where there is none or no limit."""
    if room is None or not p.get("alignment"):
        return None
    i = np.arange(len(p["input"]["sequence"]) + 1)[:, None]
    lo, hi = np.array(S.envelope(p["alignment"], room)).T
    return (i >= lo) & (i < hi)


def _infer(m, values, pairs, flags, room=None):
    from weft.functions import weights as W
    from weft.operators.train import maximise, seed_params

    c = K.compile_machine(m, values) if "--train" not in flags else None
    tok = lambda c, p: (c.tokens(p["input"]["sequence"], "in"), c.tokens(p["output"]["sequence"], "out"))
    if flags & {"--loglike", "--viterbi"}:
        grid = K.Grid(c, K.SUM if "--loglike" in flags else K.MAX)
        scores = [-K.INF if any(t is None for t in tok(c, p)) else float(grid.fill(*([t] for t in tok(c, p)), allowed=None if (a := _allowed(p, room)) is None else [a])[0]) for p in pairs]
        return [[p["input"]["name"], p["output"]["name"], s] for p, s in zip(pairs, scores, strict=True)]
    if "--align" in flags:
        out = []
        for p in pairs:
            ll, path = K.trace(c, *tok(c, p))
            cols = [[("", *c.inputs)[c.inp[e]], ("", *c.outputs)[c.out[e]]] for e in path if c.inp[e] or c.out[e]]
            out.append({**{s: p[s] for s in ("input", "output")}, "alignment": cols, "meta": {"loglike": ll, "path": [[int(c.src[e]), int(c.ord[e])] for e in path]}})
        return out
    edges = [(s, k, e) for s, k, e in m.all_edges()]
    if "--counts" in flags:
        v, out = {**m.defs, **values}, {}
        for p in pairs:
            z, n = K.counts(c, *tok(c, p), _allowed(p, room))
            for k, (_, _, e) in enumerate(edges):
                for q in W.params(e.weight, m.defs) if z > -K.INF else ():
                    out[q] = out.get(q, 0.0) + n[k] * W.evaluate(W.derive(e.weight, q, m.defs), v) * W.evaluate(q, v) / W.evaluate(e.weight, v)
        return out
    params, last = seed_params(m.cons) | values, None
    for _ in range(1000):
        c = K.compile_machine(m, params)
        total, ll = {}, 0.0
        for p in pairs:
            z, n = K.counts(c, *tok(c, p), _allowed(p, room))
            if z > -K.INF:
                ll += z
                for k, (s, o, _) in enumerate(edges):
                    total[s, o] = total.get((s, o), 0.0) + n[k]
        if last is not None and (ll - last) / max(abs(last), 1e-12) < 0.001:
            break
        last, params = ll, {**params, **maximise(m, m.cons, total, {}, params)}
    return params


def shown(x):
    """JSON with infinities as text."""
    if isinstance(x, float) and abs(x) == K.INF:
        return "Infinity" if x > 0 else "-Infinity"
    if isinstance(x, dict):
        return {k: shown(v) for k, v in x.items()}
    return [shown(v) for v in x] if isinstance(x, (list, tuple)) else x


def main() -> int:
    out = run(sys.argv[1:])
    print(out if isinstance(out, str) else json.dumps(shown(out)))
    return 0
