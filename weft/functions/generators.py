"""Machine generators with parameters: aligners, restricted echoes, code transducers."""

from __future__ import annotations

import itertools

from weft.functions import weights as W
from weft.functions.presets import CODONS, DNA, aligner, by_id, tkf_branch, tkf_root, translate
from weft.plans.machine import Edge, Machine

__all__ = ["aligner", "tkf_branch", "tkf_root", "translate", "mixture_aligner", "neighbour_aligner", "avoid", "code_graph", "mixed_radix", "codon_usage"]


def mixture_aligner(alphabet, prefix: str = "psw", gaps: int = 1, asymmetric: bool = False) -> Machine:
    """Aligner whose gap lengths are a mixture of ``gaps`` geometric laws; ``asymmetric`` gives insertions their own.

    A state is a role and, in a gap, its component: ``write`` may insert, ``read``
    waits for an input letter, and each gap component has a state that extends
    itself. Letters that are kept are read from ``read`` or from an omission
    that ends, so omissions need no state of their own to leave by, and every
    state that waits may end: outputs of any input add up to 1.
    """
    # fixed values: names of parameters in published parameter files
    add, drop = ("ins", "del") if asymmetric else ("gap", "gap")
    parts = [str(k + 1) for k in range(gaps)]
    role = lambda *names: "-".join((prefix, *names))
    write, read, end = role("write"), role("read"), role("end")

    def runs(kind, name, letters):
        """For each component its state, what opening costs, what extending costs, and the letter edges into it at a cost."""
        for k in parts:
            state, extend = role(name, k), f"{kind}Extend{k}"
            yield state, {"*": [f"{kind}Open", f"{kind}Mix{k}"]}, extend, lambda cost, to=state: [(to, *io, W.mul(cost, w)) for io, w in letters]

    def keep(cost):
        return [(write, a, b, W.mul(cost, f"sub{a}{b}")) for a in alphabet for b in alphabet]

    inserts = list(runs(add, "insert", [(("", b), f"eqm{b}") for b in alphabet]))
    omits = list(runs(drop, "omit", [((a, ""), 1) for a in alphabet]))
    states: dict = {write: [x for _, cost, _, into in inserts for x in into(cost)] + [(read, "", "", {"not": f"{add}Open"})]}
    states[read] = [x for _, cost, _, into in omits for x in into(cost)] + keep({"not": f"{drop}Open"}) + [(end, "", "")]
    states |= {state: [*into(extend), (read, "", "", {"not": extend})] for state, _, extend, into in inserts}
    states |= {state: [*into(extend), *keep({"not": extend}), (end, "", "")] for state, _, extend, into in omits}
    states[end] = []
    kinds = sorted({add, drop})
    return by_id(states, {"prob": [f"{g}{p}" for g in kinds for p in ("Open", *(f"Extend{k}" for k in parts))], "norm": [[f"eqm{b}" for b in alphabet], *([f"sub{a}{b}" for b in alphabet] for a in alphabet), *([f"{g}Mix{k}" for k in parts] for g in kinds)]})


def neighbour_aligner(alphabet=DNA, prefix: str = "nbr") -> Machine:
    """Substitutions that depend on the base before: one match state per previous input base."""
    states: dict = {f"{prefix}-S": [(f"{prefix}-{a}", a, b, f"sub{a}{b}") for a in alphabet for b in alphabet] + [(f"{prefix}-E", "", "")]}
    for p in alphabet:
        states[f"{prefix}-{p}"] = [(f"{prefix}-{a}", a, b, f"sub{p}{a}{b}") for a in alphabet for b in alphabet] + [(f"{prefix}-E", "", "")]
    states[f"{prefix}-E"] = []
    return by_id(states, {"norm": [*[[f"sub{a}{b}" for b in alphabet] for a in alphabet], *[[f"sub{p}{a}{b}" for b in alphabet] for p in alphabet for a in alphabet]]})


def _revcomp(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def avoid(motifs, both_strands: bool = True, homopolymers: bool = True, alphabet=DNA) -> Machine:
    """Echo of all sequences without the motifs (on either strand); states are motif prefixes."""
    words = {w for m in motifs for w in ((m, _revcomp(m)) if both_strands else (m,))}
    if not homopolymers:
        words |= {a + a for a in alphabet}
    nodes = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda x: (len(x), x))

    def step(s, a):
        t = s + a
        if any(t.endswith(w) for w in words):
            return None
        return next(t[k:] for k in range(len(t) + 1) if t[k:] in nodes)

    states = {f"avoid-{s}": [*[(f"avoid-{t}", a, a) for a in alphabet if (t := step(s, a)) is not None], ("avoid-end", "", "")] for s in nodes}
    return by_id({**states, "avoid-end": []})


def code_graph(length: int, forbidden=(), homopolymers: int = 1, reverse: bool = True) -> tuple[Machine, dict]:
    """DNA code from the graph of k-mers: bits choose among the successors that stay legal.

    Nodes with a dead end are pruned; a node with two exits reads a bit, one
    with three or four reads a bit or (third, fourth) is left out; one exit is
    written without reading. Returns the machine and statistics.
    """
    bad = set(forbidden) | ({_revcomp(f) for f in forbidden} if reverse else set()) | {a * (homopolymers + 1) for a in DNA}
    nodes = {"".join(k) for k in itertools.product(DNA, repeat=length)}
    nodes = {n for n in nodes if not any(b in n for b in bad)}
    edges = lambda n: [m for a in DNA if (m := n[1:] + a) in nodes and not any(b in n + a for b in bad)]
    while True:
        alive = {n for n in nodes if edges(n)}
        if alive == nodes:
            break
        nodes = alive
    order = sorted(nodes)
    if not order:
        raise ValueError("no sequence is legal")
    states: dict = {"S": [(order[0], "", "")]}
    for n in order:
        to = edges(n)[:2]
        states[n] = [("E", "", "")] + ([(to[0], "", to[0][-1])] if len(to) == 1 else [(t, str(k), t[-1]) for k, t in enumerate(to)])
    states["E"] = []
    forks = sum(len(edges(n)) > 1 for n in order)
    return by_id(states), {"states": len(order), "forks": forks, "bits_per_base": forks / len(order)}


def mixed_radix(block: int, radices, p_end: float = 0.01) -> Machine:
    """Arithmetic-like code: ``block`` bits are one number, written as digits of the given radices, most significant first."""
    size = 1
    for r in radices:
        size *= r
    if size < 2**block:
        raise ValueError("the digits can't hold a block")
    states: dict = {"S": [("b0", "0", "", 1 - p_end), ("b1", "1", "", 1 - p_end), ("E", "", "", p_end)]}
    for k in range(1, block + 1):
        for b in map("".join, itertools.product("01", repeat=k)):
            if k < block:
                states[f"b{b}"] = [(f"b{b}{x}", x, "") for x in "01"]
                continue
            v, digits = int(b, 2), []
            for r in reversed(radices):
                v, d = divmod(v, r)
                digits.append(str(d))
            word = digits[::-1]
            for i in range(len(word)):
                here = f"b{b}" if i == 0 else "w" + "".join(word[i:])
                states[here] = [("S" if i == len(word) - 1 else "w" + "".join(word[i + 1 :]), "", f"{word[i]}_{radices[i]}")]
    states["E"] = []
    return by_id(states)


def codon_usage(counts: dict) -> dict:
    """Parameters of ``translate`` from codon counts."""
    total: dict = {}
    for c, n in counts.items():
        total[CODONS[c]] = total.get(CODONS[c], 0) + n
    return {f"{CODONS[c]}_{c}": n / total[CODONS[c]] for c, n in counts.items() if CODONS[c] != "*" and total[CODONS[c]]}


def echo_bits() -> Machine:
    return Machine([[Edge(0, "0", "0"), Edge(0, "1", "1")]])
