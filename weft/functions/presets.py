"""Preset machines, each built from a rule."""

from __future__ import annotations

import itertools

from weft.operators import algebra as A
from weft.plans.machine import Edge, Machine

DNA, AMINO = A.ALPHABETS["dna"], A.ALPHABETS["aa"]
# Nucleotide ambiguity codes and their bases; complements of codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M", "M": "K", "B": "V", "V": "B", "D": "H", "H": "D", "N": "N", "X": "X"}
# The standard genetic code, codons in order of TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in itertools.product("TCAG", repeat=3)), CODE, strict=True))


def by_id(states: dict, cons: dict | None = None, defs: dict | None = None) -> Machine:
    """A machine from {id: [(to, in, out, weight)]} with ids as names; the last state is the end."""
    state = [{"id": k, "trans": [{"to": t[0], **({"in": t[1]} if t[1] else {}), **({"out": t[2]} if t[2] else {}), **({"weight": t[3]} if len(t) > 3 else {})} for t in ts]} for k, ts in states.items()]
    return Machine.from_json({"state": state, "cons": cons or {}, "defs": defs or {}})


def relabel(pairs, name=None) -> Machine:
    return Machine([[Edge(0, a, b) for a, b in pairs]], [name])


def complement(rna: bool) -> Machine:
    pairs = [(a, "U" if rna and b == "T" else b) for a, b in COMPLEMENT.items()]
    return relabel(pairs + [(a.lower(), b.lower()) for a, b in pairs], "CompRNA" if rna else "CompDNA")


def case(upper: bool) -> Machine:
    return relabel([(c, c.upper() if upper else c.lower()) for c in map(chr, range(32, 127))])


def aligner(alphabet, prefix: str) -> Machine:
    """Pairwise aligner with affine gaps: insert, match and delete by parameters."""
    s, j, w, x, i, m, d, e = (f"{prefix}-{k}" for k in "SJWXIMDE")
    out = by_id(
        {
            s: [(i, "", "", "gapOpen"), (w, "", "", {"not": "gapOpen"})],
            j: [(i, "", "", "gapExtend"), (w, "", "", {"not": "gapExtend"})],
            w: [(m, "", "", {"not": "gapOpen"}), (d, "", "", "gapOpen")],
            x: [(d, "", "", "gapExtend"), (m, "", "", {"not": "gapExtend"})],
            i: [(j, "", b, f"eqm{b}") for b in alphabet],
            m: [(e, "", ""), *[(s, a, b, f"sub{a}{b}") for a in alphabet for b in alphabet]],
            d: [(e, "", ""), *[(x, a, "") for a in alphabet]],
            e: [],
        },
        {"prob": ["gapOpen", "gapExtend"], "norm": [[f"eqm{b}" for b in alphabet], *[[f"sub{a}{b}" for b in alphabet] for a in alphabet]]},
    )
    return out


NO_SUB = {"pSub": {"not": "pNoSub"}, "pDiff": {"/": ["pSub", 4]}, "pSame": {"+": ["pNoSub", "pDiff"]}}


def jukes_cantor() -> Machine:
    m = relabel([], "jukescantor")
    m.edges[0] = [Edge(0, a, b, "pSame" if a == b else "pDiff") for a in DNA for b in DNA]
    m.defs, m.cons = {"pNoSub": {"exp": {"*": [-1, "t"]}}, **NO_SUB}, {"rate": ["t"]}
    return m


def tkf_root(alphabet=DNA) -> Machine:
    n = len(alphabet)
    return by_id(
        {"emit": [*[("emit", "", a, {"/": ["pExtend", n]}) for a in alphabet], ("stop", "", "", "pNoExtend")], "stop": []},
        {"rate": ["insRate", "delRate"]},
        {"pExtend": {"/": ["insRate", "delRate"]}, "pNoExtend": {"not": "pExtend"}},
    )


def tkf_branch(alphabet=DNA) -> Machine:
    """Birth-death indels with uniform substitution, after the standard fate probabilities of a link."""
    n = len(alphabet)
    live, born = ({"exp": {"*": [-1, {"*": [r, "time"]}]}} for r in ("delRate", "insRate"))
    return by_id(
        {
            "begin": [("insert", "", "", "pDescendants"), ("wait", "", "", "pNoDescendants")],
            "orphan": [("insert", "", "", "pOrphans"), ("wait", "", "", "pNoOrphans")],
            "wait": [("match", "", "", "pNoDeletion"), ("delete", "", "", "pDeletion"), ("end", "", "")],
            "insert": [("begin", "", a, {"/": [1, n]}) for a in alphabet],
            "match": [("begin", a, b, "pSame" if a == b else "pDiff") for a in alphabet for b in alphabet],
            "delete": [("orphan", a, "") for a in alphabet],
            "end": [],
        },
        {"rate": ["time", "insRate", "delRate"]},
        {
            "pNoDeletion": live,
            "pDeletion": {"not": "pNoDeletion"},
            "pNoInsertion": born,
            "pInsertion": {"not": "pNoInsertion"},
            "delInsRatio": {"/": ["pNoDeletion", "pNoInsertion"]},
            "pDescendants": {"/": [{"*": ["insRate", {"not": "delInsRatio"}]}, {"-": ["delRate", {"*": ["insRate", "delInsRatio"]}]}]},
            "pNoDescendants": {"not": "pDescendants"},
            "pNoOrphans": {"*": [{"/": ["delRate", "insRate"]}, {"/": ["pDescendants", "pDeletion"]}]},
            "pOrphans": {"not": "pNoOrphans"},
            "pNoSub": {"exp": {"*": [-1, "time"]}},
            **NO_SUB,
        },
    )


def translate(table: dict | None = None, extra=()) -> Machine:
    """Amino acids to codons, weights by codon use; ``extra`` symbols pass through."""
    codons = {c: a for c, a in (table or CODONS).items() if a != "*"}
    groups: dict = {}
    for c in sorted(codons):
        groups.setdefault(codons[c], []).append(c)
    name = lambda x: f"translate-{x}"
    states: dict = {name("start"): [(name(c), codons[c], "", *([f"{codons[c]}_{c}"] if len(groups[codons[c]]) > 1 else [])) for c in sorted(codons)]}
    states[name("start")] += [(name("start"), x, x) for x in extra] + [(name("end"), "", "")]
    for c in sorted(codons):
        states[name(c)] = [(name(c[1:]), "", c[0])]
    for k in (2, 1):
        for tail in sorted({c[-k:] for c in codons}):
            states[name(tail)] = [(name(tail[1:]) if k == 2 else name("start"), "", tail[0])]
    states[name("end")] = []
    return by_id(states, {"norm": [[f"{a}_{c}" for c in cs] for a, cs in sorted(groups.items())]})


def ternary_blocks(bits: int = 3) -> Machine:
    """Blocks of ``bits`` bits to two trits; a final pair 22 and padding trits close an open block."""
    states: dict = {"S": [("P0", "0", ""), ("P1", "1", ""), ("X", "", "2")]}
    for k in range(1, bits - 1):
        for b in map("".join, itertools.product("01", repeat=k)):
            states[f"P{b}"] = [(f"P{b}{x}", x, "") for x in "01"]
    for b in map("".join, itertools.product("01", repeat=bits - 1)):
        states[f"P{b}"] = [(f"Q{int(b + x, 2) % 3}", x, str(int(b + x, 2) // 3)) for x in "01"]
    for q in "012":
        states[f"Q{q}"] = [("S", "", q)]
    states["X"] = [("Y", "", "2")]
    states["Y"] = [*[("Z", x, x) for x in "01"], ("E", "", "2")]
    states["Z"] = [*[("E", x, x) for x in "01"], ("E", "", "2")]
    states["E"] = []
    return by_id(states)


# From each base, the next base for digit 0, 1, 2 (never a repeat).
ROTATION = {"A": "GCT", "C": "TAG", "G": "ATC", "T": "CGA"}


def base_rotation(digits: int = 3) -> Machine:
    return by_id({**{b: [*[(n, str(k), n) for k, n in enumerate(to[:digits])], ("END", "", "")] for b, to in ROTATION.items()}, "END": []})


def hamming31() -> Machine:
    return by_id({"S": [("00", "0", "0"), ("11", "1", "1"), ("E", "", "")], "00": [("0", "", "0")], "11": [("1", "", "1")], "0": [("S", "", "0")], "1": [("S", "", "1")], "E": []})


def hamming74() -> Machine:
    """Four data bits to seven: p1 p2 d1 p3 d2 d3 d4; states for what has been read, and for what is left to write."""
    states: dict = {"S": [("0", "0", ""), ("1", "1", ""), ("E", "", "")]}
    tails = set()
    for k in (1, 2, 3):
        for b in map("".join, itertools.product("01", repeat=k)):
            if k < 3:
                states[b] = [(b + x, x, "") for x in "01"]
                continue
            states[b] = []
            for x in "01":
                d1, d2, d3, d4 = map(int, b + x)
                word = [d1 ^ d2 ^ d4, d1 ^ d3 ^ d4, d1, d2 ^ d3 ^ d4, d2, d3, d4]
                word = "".join(map(str, word))
                tails |= {word[i:] for i in range(1, 7)}
                states[b].append((f"w{word[1:]}", x, word[0]))
    for t in sorted(tails, key=lambda t: (-len(t), t)):
        states[f"w{t}"] = [(f"w{t[1:]}" if len(t) > 1 else "S", "", t[0])]
    states["E"] = []
    return by_id(states)


def introns(kind: str) -> Machine:
    """"placeholders": amino acids, any of which may be three bases around an intron; "simple": introns spelled GT...AG."""
    if kind == "simple":
        return by_id(
            {
                "si-S": [*[("si-S", b, b) for b in [*DNA, "base"]], ("si-donor", "intron", "G"), ("si-E", "", "")],
                "si-donor": [("si-intron", "", "T")],
                "si-intron": [("si-intron", "", "base", "extendIntron"), ("si-acceptor", "", "A", {"not": "extendIntron"})],
                "si-acceptor": [("si-S", "", "G")],
                "si-E": [],
            },
            {"prob": ["extendIntron"]},
        )
    orders = ["IBB", "BIB", "BBI"]
    spelled = {"I": "intron", "B": "base"}
    states: dict = {"i-S": [*[t for a in AMINO for t in [("i-S", a, a, {"not": "intron"}), *[(f"i-{o}", a, "", {"/": ["intron", 3]}) for o in orders]]], ("i-E", "", "")]}
    rest = sorted({o[k:] for o in orders for k in range(3)}, key=lambda r: (-len(r), r))
    for r in rest:
        states[f"i-{r}"] = [(f"i-{r[1:]}" if len(r) > 1 else "i-S", "", spelled[r[0]])]
    states["i-E"] = []
    return by_id(states, {"prob": ["intron"]})


def intron_marks() -> Machine:
    """Amino acids, any of which may give way to three bases with an intron before, between or after them."""
    m, e, i = "pswint-M", "pswint-E", "pswint-M-intron"
    states: dict = {m: [(e, "", ""), *[t for a in AMINO for t in [(m, a, a, {"not": "intron"}), (i, a, "", "intron")]]]}
    orders = ["IBB", "BIB", "BBI"]
    spelled = {"I": "intron", "B": "base"}
    states[i] = [(f"pswint-{o[1:]}", "", spelled[o[0]], {"/": [1, 3]}) for o in orders]
    for r in sorted({o[k:] for o in orders for k in (1, 2)}, key=lambda r: (-len(r), r)):
        states[f"pswint-{r}"] = [(f"pswint-{r[1:]}" if len(r) > 1 else m, "", spelled[r[0]])]
    states[e] = []
    return by_id(states, {"prob": ["intron"]})


def base_to_acgt() -> Machine:
    return by_id({"bases": [*[("bases", b, b) for b in DNA], *[("bases", "base", b, f"p{b}") for b in DNA]]}, {"norm": [[f"p{b}" for b in DNA]]})


def flank_base() -> Machine:
    return by_id(
        {"flank-start": [("flank-emit", "", "", "flankExtend"), ("flank-end", "", "", {"not": "flankExtend"})], "flank-emit": [("flank-start", "", "base")], "flank-end": []},
        {"prob": ["flankExtend"]},
    )


def protein_to_dna(inner: Machine | None = None) -> Machine:
    """Protein with introns, translated, spelled and flanked by random bases."""
    from weft.operators import graph as G

    first = intron_marks() if inner is None else G.compose(inner, intron_marks())
    core = G.compose(G.compose(first, translate(extra=["base", "intron"])), introns("simple"))
    return G.compose(A.flank(core, flank_base()), base_to_acgt())


def geometric_bits() -> Machine:
    return Machine([[Edge(0, "0", "0", {"/": ["p", 2]}), Edge(0, "1", "1", {"/": ["p", 2]}), Edge(1, weight={"not": "p"})], []], None, {}, {"prob": ["p"]})


def bit_code() -> Machine:
    return by_id({"S": [("Q12", "0", "0"), ("Q12", "1", "1"), ("E", "", "2")], "Q12": [("Q2", "", "1")], "Q2": [("S", "", "2")], "E": []})


def no_repeats(alphabet=DNA) -> Machine:
    return by_id({"S": [*[(b, b, b) for b in alphabet], ("end", "", "")], **{b: [*[(c, c, c) for c in alphabet if c != b], ("end", "", "")] for b in alphabet}, "end": []})


PRESETS = {
    "null": A.null,
    "compdna": lambda: complement(False),
    "comprna": lambda: complement(True),
    "dnapsw": lambda: aligner(DNA, "dnapsw"),
    "protpsw": lambda: aligner(AMINO, "protpsw"),
    "translate": translate,
    "prot2dna": protein_to_dna,
    "psw2dna": lambda: protein_to_dna(aligner(AMINO, "protpsw")),
    "iupacdna": lambda: relabel([(c, b) for c, bs in IUPAC.items() for b in bs]),
    "iupacaa": lambda: relabel([*[(a, a) for a in AMINO], *[("X", a) for a in AMINO]]),
    "dna2rna": lambda: relabel([(b, "U" if b == "T" else b) for b in DNA]),
    "rna2dna": lambda: relabel([("U" if b == "T" else b, b) for b in DNA]),
    "bintern": ternary_blocks,
    "terndna": base_rotation,
    "jukescantor": jukes_cantor,
    "dnapswnbr": lambda: __import__("weft.functions.generators", fromlist=["x"]).neighbour_aligner(DNA, "dnapswnbr"),
    "tkf91root": tkf_root,
    "tkf91branch": tkf_branch,
    "tolower": lambda: case(False),
    "toupper": lambda: case(True),
    "hamming31": hamming31,
    "hamming74": hamming74,
    "bitbase": lambda: base_rotation(2),
    "bitcod": bit_code,
    "flankbase": flank_base,
    "base2acgt": base_to_acgt,
    "geom_iid_binary": geometric_bits,
    "simple_introns": lambda: introns("simple"),
    "add-intron-placeholders": lambda: introns("placeholders"),
    "noreps": no_repeats,
    "pint": intron_marks,
}


def preset(name: str) -> Machine:
    if name not in PRESETS:
        raise KeyError(f"no preset {name}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]()
