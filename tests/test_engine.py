import itertools
import json
import math

import numpy as np
import pytest
from machines import DASHES, KEEP, RUN, RUNS, SLIP, all_paths, random_machine, score

from weft import cli
from weft.functions import generators as Gen
from weft.functions import weights as W
from weft.functions.presets import PRESETS, preset
from weft.operators import algebra as A
from weft.operators import decode as D
from weft.operators import graph as G
from weft.operators import kernels as K
from weft.operators import position as P
from weft.operators.train import maximise, seed_params
from weft.plans.machine import Edge, Machine
from weft.sources import formats as S
from weft.sources.regex import regex



def M(x):
    return Machine.from_json(x)


def test_weights_simplify_and_evaluate():
    x = W.parse_infix("$a * (1 - b) + 2^c / log(d)")
    v = {"a": 2.0, "b": 0.25, "c": 3, "d": math.e}
    assert W.evaluate(x, v) == pytest.approx(1.5 + 8)
    assert W.parse_json({"*": [1, "x"]}) == "x" and W.parse_json({"*": [0, "x"]}) == 0
    assert W.parse_json({"/": [1, 4]}) == {"/": [1, 4]} and W.parse_json({"/": [1.0, 4]}) == 0.25
    assert W.add("a", {"-": [0, "b"]}) == {"-": ["a", "b"]}
    assert W.parse_json({"log": {"exp": "x"}}) == "x" and W.parse_json(True) == 1
    for bad in (None, {"x": 1}, {"*": [1]}, [], ""):
        with pytest.raises(ValueError):
            W.parse_json(bad)
    for bad in ("a +", "(a", "a b", "a^b^c", "x_y"):
        with pytest.raises(ValueError):
            W.parse_infix(bad)
    assert W.evaluate(W.parse_infix(W.show(x)), v) == pytest.approx(9.5)


def test_weights_derive_and_definitions():
    w = W.parse_json({"*": [{"pow": ["x", 3]}, {"exp": {"*": ["k", "x"]}}]})
    v = {"x": 1.3, "y": 0.4, "k": {"geomsum": "y"}}
    h = 1e-6
    for p in ("x", "y"):
        d = (W.evaluate(w, v | {p: v[p] + h}) - W.evaluate(w, v | {p: v[p] - h})) / (2 * h)
        assert W.evaluate(W.derive(w, p, {"k": v["k"]}), v) == pytest.approx(d, rel=1e-6)
    assert W.params(w, {"k": v["k"]}) == {"x", "y"}
    with pytest.raises(ValueError, match="cyclic"):
        W.check_defs({"a": "b", "b": {"+": ["a", 1]}})
    assert W.check_defs({"a": "b", "b": 1}) == ["b", "a"]
    with pytest.raises(KeyError):
        W.evaluate("zz", {})


def test_weight_columns(spark):
    df = spark.createDataFrame([(0.5, 2.0), (0.0, 1.0)], "a double, b double")
    w = W.parse_json({"+": [{"log": "a"}, {"*": ["b", {"not": "a"}]}]})
    got = [r[0] for r in df.select(W.column(w)).collect()]
    assert got[0] == pytest.approx(math.log(0.5) + 1) and got[1] == -math.inf


def test_loader_rejects_bad_machines():
    ok = {"state": [{"id": "a", "trans": [{"to": "b", "in": "x"}]}, {"id": "b"}]}
    assert len(M(ok)) == 2
    for bad in (
        {}, {"state": []}, {"state": [{"n": 1}]}, {"state": [{"id": 3}]}, {"state": [{"trans": [{"to": 5}]}]}, {"state": [{"trans": [{"to": "zz"}]}]},
        {"state": [{"trans": [{"to": 0, "weight": None}]}]}, {"state": [{}], "define": {}}, {"state": [{"trans": [{}]}]},
        {"state": [{"id": "a"}, {"id": "a", "trans": [{"to": "a"}]}]}, {"state": [{}], "defs": {"a": "b", "b": "a"}}, {"state": [{}], "cons": {"norm": [["a"], ["a"]]}},
    ):
        with pytest.raises(ValueError):
            M(bad)
    with pytest.raises(ValueError):
        M("not json")


def test_json_round_trip_and_options():
    for x in (SLIP, DASHES, RUNS):
        m = M(x)
        assert M(m.to_json()).edges == m.edges
    m = M({"state": [{"trans": [{"to": 0, "in": c, "weight": {"*": [{"+": ["x", "y"]}, k]}} for k, c in ((2, "a"), (3, "b"))]}]})
    j = m.to_json(define_exprs=True)
    assert j["defs"] == {"_1": {"+": ["x", "y"]}}
    assert score(M(j), "ab", "", {"x": 1.0, "y": 0.5}) == pytest.approx(score(m, "ab", "", {"x": 1.0, "y": 0.5}))
    named = A.concat(A.generate("a"), A.generate("b")).to_json(name_states=True)
    assert M(named).edges == A.concat(A.generate("a"), A.generate("b")).edges
    assert M({**SLIP, "cons": {"norm": [["keep", "slip"]]}}).unconstrained() == []
    assert "digraph" in m.dot() and m.stats() == {"states": 1, "transitions": 2, "conditioned": 1, "params": 2}


def test_tables_round_trip(spark):
    m = G.compose(M(DASHES), M(SLIP))
    assert Machine.from_tables(*m.tables(spark)).edges == m.edges


def test_forward_and_viterbi_goldens():
    assert score(M(SLIP), "abca", "abab", KEEP) == pytest.approx(2 * math.log(0.8) + 2 * math.log(0.2))
    assert score(M(DASHES), "ab", "a--b") == pytest.approx(math.log(0.25**2 * 0.75**2 * 0.6))
    m = G.compose(M(DASHES), M(SLIP))
    assert score(m, "ab", "a--c", KEEP) == pytest.approx(math.log(0.25**2 * 0.75**2 * 0.6 * 0.8 * 0.2))
    for x, y in (("uu", "uuu"), ("uuuu", "u"), ("uuu", "uu"), ("", "u"), ("u", "")):
        assert score(M(RUNS), x, y, RUN) == pytest.approx(all_paths(M(RUNS), x, y, RUN))
        assert score(M(RUNS), x, y, RUN, K.MAX) == pytest.approx(all_paths(M(RUNS), x, y, RUN, best=True))
    assert score(M(SLIP), "ab", "bb", {"keep": 0.1, "slip": 0.9}) == pytest.approx(math.log(0.09))


def test_counts_and_maximise():
    m = M(SLIP)
    c = K.compile_machine(m, KEEP)
    _, n = K.counts(c, c.tokens("abcab", "in"), c.tokens("abaab", "out"))
    assert n == pytest.approx([2, 0, 2, 0, 0, 1, 0])  # a to a, a to b, b to b, b to c, c to c, c to a, dash
    cons = {"norm": [["keep", "slip"]]}
    got = maximise(m, cons, {(0, k): x for k, x in enumerate(n)}, {}, seed_params(cons))
    assert got == pytest.approx({"keep": 0.8, "slip": 0.2})
    # the numeric route agrees with the closed form
    from weft.operators.train import _bfgs

    assert _bfgs(m, cons, {(0, k): x for k, x in enumerate(n)}, {}, seed_params(cons)) == pytest.approx(got, abs=1e-3)


def test_training(spark):
    from weft.operators.train import fit

    df = spark.createDataFrame([(list("abc"), list("aba")), (list("ccab"), list("cabc"))], "x array<string>, y array<string>")
    params, history = fit(df, M(SLIP), "x", "y", {"norm": [["keep", "slip"]]})
    assert params == pytest.approx({"keep": 3 / 7, "slip": 4 / 7}) and history == sorted(history)


def test_count_copies():
    m = G.compose(G.sort(A.generate("AGAGAGAGAGA")), A.flank(A.count_copies(A.recognize("A"), "n"), A.star(A.recognize("G"))), "sum")
    assert len(m) and "n" in m.defs


@pytest.mark.parametrize("seed", range(12))
def test_rewrites_keep_weights(seed):
    rng = np.random.default_rng(seed)
    a, b = random_machine(rng, 3, ["", "a", "b"], ["", "x", "y"]), random_machine(rng, 3, ["", "x", "y"], ["", "0", "1"])
    try:
        m = G.compose(a, b)
        want = {(x, y): score(m, x, y) for x in ("", "a", "ab") for y in ("", "0", "01")}
    except ValueError:
        return  # silent cycles of this draw don't converge
    mids = [list(s) for k in range(9) for s in itertools.product("xy", repeat=k)]
    for (x, y), w in want.items():
        both = [score(a, x, q) + score(b, q, y) for q in mids[:127]]
        if w > -K.INF:
            assert np.logaddexp.reduce(both) <= w + 1e-9
        for f in (G.eliminate_silent, G.merge_states, G.sort, G.eliminate_states, A.pad, G.full_sort, lambda z: A.reverse(A.reverse(z)), lambda z: A.transpose(A.transpose(z))):
            got = score(f(m), x, y)
            assert got == w or got == pytest.approx(w, abs=1e-8)
        back = score(A.reverse(m), x[::-1], y[::-1])
        assert back == w or back == pytest.approx(w, abs=1e-8)
        assert score(m, x, y, ring=K.MAX) <= w + 1e-9


def test_backward_equals_forward_and_posteriors_add_up():
    m = G.compose(M(DASHES), M(SLIP))
    c = K.compile_machine(m, KEEP)
    x, y = c.tokens("abc", "in"), c.tokens("a-ca", "out")
    f, F = K.Grid(c, K.SUM).fill([x], [y], True)
    b, B = K.Grid(c, K.SUM, True).fill([x], [y], True)
    assert f[0] == pytest.approx(b[0]) and B[0][0, 0, 0] == pytest.approx(f[0])
    one = A.iid("recognize", "ab", "0.5")
    c1 = K.compile_machine(one)
    _, p = K.state_posteriors(c1, c1.tokens("abba", "in"), np.zeros(0, int))
    assert p.sum(axis=(1, 2)) == pytest.approx(np.ones(5))


def test_count_gradient():
    m = G.compose(M(DASHES), M(SLIP))
    c = K.compile_machine(m, KEEP)
    _, n = K.counts(c, c.tokens("abc", "in"), c.tokens("a-ca", "out"))
    for p in KEEP:
        got = sum(n[k] * W.evaluate(W.derive(e.weight, p), KEEP) / W.evaluate(e.weight, KEEP) for k, (_, _, e) in enumerate(m.all_edges()))
        h = 1e-6
        d = (score(m, "abc", "a-ca", KEEP | {p: KEEP[p] + h}) - score(m, "abc", "a-ca", KEEP | {p: KEEP[p] - h})) / (2 * h)
        assert got == pytest.approx(d, rel=1e-4)


def test_best_and_drawn_paths():
    m = G.compose(M(DASHES), M(SLIP))
    c = K.compile_machine(m, KEEP)
    x, y = c.tokens("abc", "in"), c.tokens("a-ca", "out")
    ll, path = K.trace(c, x, y)
    assert c.lw[path].sum() == pytest.approx(ll) == pytest.approx(score(m, "abc", "a-ca", KEEP, K.MAX))
    rng = np.random.default_rng(0)
    for _ in range(20):
        _, p = K.trace(c, x, y, rng)
        assert [c.inp[e] for e in p if c.inp[e]] == x.tolist() and [c.out[e] for e in p if c.out[e]] == y.tolist()


def test_preset_sizes_and_languages():
    sizes = {"compdna": (1, 34), "comprna": (1, 34), "dnapsw": (8, 34), "protpsw": (8, 450), "translate": (83, 143), "iupacdna": (1, 32), "iupacaa": (1, 40), "bintern": (14, 25), "terndna": (5, 16),
             "jukescantor": (1, 16), "tkf91root": (2, 5), "tkf91branch": (7, 31), "tolower": (1, 95), "toupper": (1, 95), "hamming31": (6, 7), "hamming74": (70, 85), "pint": (8, 49), "simple_introns": (5, 11), "bitcod": (4, 5)}
    for n, want in sizes.items():
        m = preset(n)
        assert (len(m), sum(map(len, m.edges))) == want, n
    for n in PRESETS:
        assert len(preset(n)) >= 1
    v = {"time": 0.5, "insRate": 0.1, "delRate": 0.2}
    total = sum(math.exp(score(preset("tkf91branch"), "A", "".join(s), v)) for k in range(5) for s in itertools.product("ACGT", repeat=k))
    assert 0.99 < total <= 1 + 1e-9


def run_code(name, text, encode=True, method="viterbi"):
    m = preset(name)
    m = A.transpose(m) if encode else m
    c = K.compile_machine(m)
    return "".join(D.METHODS[method](c, c.tokens(text, "out"))[0])


def test_codes():
    assert run_code("bintern", "1010101") == "12022212" and run_code("terndna", "12022212") == "CGATATGC"
    assert run_code("bintern", "101") == "12222" and run_code("hamming31", "101") == "111000111"
    assert run_code("terndna", "CGATATGC", False) == "12022212" and run_code("bintern", "12022212", False, "beam") == "1010101"
    assert run_code("hamming31", "111000111", False, "prefix") == "101"
    word = run_code("hamming74", "1011")
    assert len(word) == 7 and run_code("hamming74", word, False, "prefix") == "1011"
    m = Gen.mixed_radix(3, [3, 3], 0.1)
    e = K.compile_machine(A.transpose(m))
    assert D.viterbi(e, e.tokens("101", "out"))[0] == ["1_3", "2_3"]
    g, stats = Gen.code_graph(3, ["ACG"])
    assert stats["states"] > 0 and score(g, "0", "") == -K.INF
    a = Gen.avoid(["GAATTC"])
    assert score(a, "GAATT", "GAATT") > -K.INF and score(a, "AGAATTC", "AGAATTC") == -K.INF


def test_decoders_agree():
    m = Machine([[Edge(0, x, y, 0.8 if x == y.lower() else 0.1) for x in "ab" for y in "AB"]])
    c = K.compile_machine(m)
    y = c.tokens("ABBA", "out")
    want = (list("abba"), pytest.approx(4 * math.log(0.8)))
    for method in ("beam", "prefix", "viterbi"):
        assert D.METHODS[method](c, y) == want
    rng = np.random.default_rng(3)
    assert D.mcmc(c, y, rng, 20)[0] == list("abba") and D.mcmc(c, y, rng, 20, cool=True)[0] == list("abba")
    drawn = [D.random_prefix(c, c.tokens("A", "out"), rng)[0] for _ in range(400)]
    assert abs(drawn.count(["a"]) / 400 - 8 / 9) < 0.06


def test_regex():
    def accepts(pattern, text, abc="abcd0"):
        return score(regex(pattern, abc), text, "") > -K.INF

    assert accepts("^a(b|c)*d{1,2}$", "abcdd") and not accepts("^a(b|c)*d{1,2}$", "abcddd")
    assert accepts("bc", "abcd") and not accepts("^bc", "abcd") and accepts("[^ab]+$", "aacd")
    assert accepts(r"^\d$", "0") and not accepts(r"^\d$", "a") and accepts(r"^\x61\142$", "ab") and accepts("^[a-c]{2}$", "cb")
    assert score(regex("^(a|a)$", "a"), "a", "") == pytest.approx(math.log(2))
    for bad in ("(a", "a)", "*a", "a{2,1}"):
        with pytest.raises(ValueError):
            regex(bad, "a")


def test_envelopes():
    path = [["0", "0"], ["0", "0"], ["0", ""], ["", "1"], ["1", "1"], ["1", "1"]]
    assert S.envelope(path, 1) == [(0, 2), (0, 4), (1, 5), (1, 5), (2, 6), (4, 6)]
    assert S.envelope(None, None, (2, 1)) == [(0, 3), (0, 3)]
    with pytest.raises(ValueError):
        S.pair_from_json({"input": {"sequence": ["1"]}, "alignment": [["0", "0"]]})


def test_profiles():
    header, rows = ["A", "C", "G", "T"], [[20, 10, 20, 40, 10], [10, 10, 10, 10, 60]]
    m = S.profile_machine(header, rows)
    assert score(m, "", "A") == pytest.approx(math.log(20 * 60 + 10 * 10))
    merged = S.merged_profile(["a"], [[0.5, 0.5], [0.5, 0.5]])
    assert score(merged, "a", "") == pytest.approx(math.log(0.75)) and score(merged, "", "") == pytest.approx(math.log(0.25))
    c = K.compile_machine(Machine([[Edge(0, "A", "", 0.7), Edge(0, "C", "", 0.3)]]))
    soft = np.array([[0.5, 0.5], [1.0, 0.0]])
    assert K.Grid(c, K.SUM).fill([soft], [np.zeros(0, int)])[0] == pytest.approx(math.log(0.5 * 0.7))
    j = S.jumping_profile(["AC", "GT"])
    assert math.exp(score(j, "", "AT", {"jump": 0.1})) == pytest.approx(0.05)


def toy_hmm():
    t = "  ".join(["0.1", "3.0", "3.0", "0.3", "1.2", "0.2", "1.6"])
    out = ["HMMER3/f", "HMM          A        C", "            m->m     m->i", "        1.0 1.0", f"        {t}"]
    for k in (1, 2, 3):
        out += [f"      {k}   0.3 1.3   {k} a - - -", "        0.7 0.7", f"        {t if k < 3 else t.replace('3.0', '*', 2)}"]
    return "\n".join([*out, "//"]) + "\n"


def test_hmmer_topology():
    h = S.read_hmmer(toy_hmm())
    assert len(h["nodes"]) == 4 and h["nodes"][1]["match"] == pytest.approx([math.exp(-0.3), math.exp(-1.3)])
    assert len(S.hmmer_machine(h, "global")) == 5 * 3 + 4 and len(S.hmmer_machine(h, "plan7", True)) == 5 * 3 + 4 + 8
    echo = A.wild("echo", "AC")
    m = S.hmmer_machine(h, "plan7")
    assert score(P.fuse(m, echo), "", "ACA") == pytest.approx(score(m, "", "ACA"))


def test_fused_counts_deletions_exactly():
    gen = Machine([[Edge(0, "", "a", 0.4), Edge(1, weight=0.6)], []])
    drop = Machine([[Edge(0, "a", "", 0.3), Edge(0, "a", "b", 0.7)]])
    # an output b costs 0.4 * 0.7 between any number of dropped symbols
    r = 1 / (1 - 0.4 * 0.3)
    assert math.exp(score(P.fuse(gen, drop), "", "bb")) == pytest.approx(0.6 * (0.28 * r) ** 2 * r)


def test_position_dependent_and_aligned():
    c = K.compile_machine(M(RUNS), RUN)
    x, y = c.tokens("uu", "in"), c.tokens("uuu", "out")
    pm = P.PositionMachine.from_machine(c, x, y)
    for ring in (K.SUM, K.MAX):
        assert pm.score(2, 3, ring) == pytest.approx(float(K.Grid(c, ring).fill([x], [y])[0]))
    all_ways = [ops for k in range(6) for ops in itertools.product((0, 1, 2), repeat=k) if sum(o != 2 for o in ops) == 2 and sum(o != 1 for o in ops) == 3]
    assert np.logaddexp.reduce([P.aligned(c, x, y, o) for o in all_ways]) == pytest.approx(float(K.Grid(c, K.SUM).fill([x], [y])[0]))
    with pytest.raises(ValueError):
        P.check_alignment([0, 0], 2, 3)


def test_null_sums_and_closure():
    m = Machine([[Edge(0, weight=0.5), Edge(1, weight=0.25)], []])
    assert K.null_sums(K.compile_machine(m))[0, 1] == pytest.approx(0.5)
    assert score(m, "", "") == pytest.approx(math.log(0.5)) and score(G.sort(m), "", "") == pytest.approx(math.log(0.5))
    assert score(G.sort(A.plus(A.weight(0.3))), "", "") == pytest.approx(math.log(0.3 / 0.7))
    with pytest.raises(ValueError):
        score(Machine([[Edge(0, weight=1.5), Edge(1)], []]), "", "")


def test_mixture_aligner_is_a_conditional_law():
    """Outputs of any input add up to 1, and a run of omissions is a mixture of geometric lengths."""
    m = Gen.mixture_aligner("AC", gaps=2, asymmetric=True)
    v = {"insOpen": 0.2, "insMix1": 0.7, "insMix2": 0.3, "insExtend1": 0.1, "insExtend2": 0.6, "delOpen": 0.25, "delMix1": 0.4, "delMix2": 0.6, "delExtend1": 0.5, "delExtend2": 0.8}
    v |= {"eqmA": 0.3, "eqmC": 0.7, "subAA": 0.9, "subAC": 0.1, "subCA": 0.2, "subCC": 0.8}
    assert m.params() == set(v)
    for x in ("", "A", "CA", "ACCA"):
        assert score(A.silence_output(m), x, "", v) == pytest.approx(0, abs=1e-9)
    # all but the last letter omitted
    for k in range(1, 5):
        run = sum(v[f"delMix{c}"] * v[f"delExtend{c}"] ** (k - 1) * (1 - v[f"delExtend{c}"]) for c in (1, 2))
        want = 0.8 * 0.25 * run * 0.9 * 0.8
        assert math.exp(score(m, "C" * k + "A", "A", v)) == pytest.approx(want + sum(_elsewhere(v, k)), rel=1e-9)


def _elsewhere(v, k):
    """The other ways to write A for k times C and A: the kept letter is an earlier one, or an insertion."""
    c1, c2 = (1, 2)
    gap = lambda n, ends: 1.0 if n == 0 else sum(v[f"delMix{c}"] * v[f"delExtend{c}"] ** (n - 1) * (1.0 if ends else 1 - v[f"delExtend{c}"]) for c in (c1, c2)) * v["delOpen"]
    stay = lambda n: 1 - v["delOpen"] if n == 0 else 1.0
    quiet = 1 - v["insOpen"]
    for at in range(k):  # the C at this place is written as A
        rest = k - at
        yield quiet * gap(at, False) * stay(at) * v["subCA"] * quiet * gap(rest, True)
    insert = v["insOpen"] * v["eqmA"] * sum(v[f"insMix{c}"] * (1 - v[f"insExtend{c}"]) for c in (c1, c2))
    yield insert * gap(k + 1, True)


def test_double_strand_and_trace_from_a_cell():
    m = Machine([[Edge(1, "", "A", 0.5), Edge(1, "", "C", 0.25)], [Edge(2, "", "G", 1.0)], []])
    both = G.double_strand(m)
    assert math.exp(score(both, "", "AG")) == pytest.approx(0.25) and math.exp(score(both, "", "CG")) == pytest.approx(0.25)
    for x, y in (("AG", "CT"), ("CG", "CG"), ("GG", "CC")):  # a sequence and its reverse complement score alike
        assert score(both, "", x) == score(both, "", y) or score(both, "", x) == pytest.approx(score(both, "", y))
    c = K.compile_machine(M(RUNS), RUN)
    x, y = c.tokens("uuu", "in"), c.tokens("uu", "out")
    _, F = K.Grid(c, K.MAX).fill([x], [y], True)
    ll, path = K.trace(c, x, y, start=(2, 1, 1))
    assert ll == pytest.approx(F[0][2, 1, 1]) == pytest.approx(c.lw[path].sum()) and c.dst[path[-1]] == 1
    assert (c.inp[path] > 0).sum() == 2 and (c.out[path] > 0).sum() == 1


def test_downsampling():
    m = Machine([[Edge(1, "", "a", 0.9), Edge(1, "", "b", 0.1)], []])
    assert G.downsample(m, size=0.5).stats()["transitions"] == 1
    assert G.downsample(m, prob=0.05).stats()["transitions"] == 2
    assert G.downsample_paths(m, paths=1, seed=1).stats()["transitions"] == 1
    assert G.downsample_paths(m, fraction=1.0, seed=1).stats()["transitions"] == 2


def test_merge_goldens():
    m = M({"merge": {"state": [{"id": "A", "trans": [{"to": "B", "out": "x", "weight": 2}, {"to": "B", "out": "x", "weight": 3}]}, {"id": "B"}]}})
    assert m.edges == [[Edge(1, "", "x", 5)], []]
    u = M({"union": [A.generate("a").to_json(), A.generate("a").to_json()]})
    assert score(G.merge_states(u), "", "a") == pytest.approx(math.log(2))


def test_command_line(tmp_path):
    f = tmp_path / "noise.json"
    f.write_text(json.dumps(SLIP))
    p = tmp_path / "p.json"
    p.write_text(json.dumps(KEEP))
    r = cli.run([str(f), "-L", "-P", str(p), "--input-chars", "abc", "--output-chars", "bbc"])
    assert r == [["abc", "bbc", pytest.approx(math.log(0.2 * 0.8**2))]]
    assert cli.run([str(f), "-V", "-P", str(p), "--input-chars", "z", "--output-chars", "abc"])[0][2] == -math.inf
    assert cli.run([str(f), "-C", "-P", str(p), "--input-chars", "abc", "--output-chars", "aba"]) == pytest.approx({"keep": 2, "slip": 1})
    got = cli.run(["(", "--generate-chars", "0", "||", "--generate-chars", "1", ")", "+", "--stats"])
    assert got["states"] > 2
    a = cli.run([str(f), "-A", "-P", str(p), "--input-chars", "ac", "--output-chars", "ba"])[0]
    assert a["alignment"] == [["a", "b"], ["c", "a"]]
    assert cli.run(["--preset", "bintern", "--beam-decode", "--output-chars", "12022212"])[0]["input"]["sequence"] == list("1010101")
    with pytest.raises(ValueError):
        cli.run(["--no-such-thing"])


def test_command_line_sequences_and_options(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text if isinstance(text, str) else json.dumps(text))
        return str(tmp_path / name)

    f, p = put("slip.json", SLIP), put("p.json", KEEP)
    fa, js = put("x.fa", ">one a>b\nab\nc\n>two\nca\n"), put("y.json", {"name": "out", "sequence": ["b", "c", "a"]})
    got = cli.run([f, "-L", "-P", p, "-I", fa, "--output-json", js])
    assert got == [["one", "out", pytest.approx(3 * math.log(0.2))], ["two", "out", -math.inf]]
    assert len(cli.run([f, "-V", "-P", p, "--input-json", js, "-O", fa])) == 2
    # an alignment confines the paths of an insertion and a deletion
    m = put("free.json", {"state": [{"trans": [{"to": 0, "in": "a", "out": "a", "weight": 0.5}, {"to": 0, "in": "a", "weight": 0.1}, {"to": 0, "out": "a", "weight": 0.1}]}]})
    d = put("data.json", [{"alignment": [["a", "a"], ["a", "a"]]}])
    tight, loose, free = (cli.run([m, "-L", "-D", d, *o])[0][2] for o in (["-R", "0"], ["-R", "5"], []))
    assert math.exp(tight) == pytest.approx(0.25) and tight < loose == pytest.approx(free)
    assert cli.run(["--preset", "hamming31", "--prefix-decode", "--prefix-backtrack", "3", "--output-chars", "111000"])[0]["input"]["sequence"] == ["1", "0"]
    two = put("two.json", {"state": [{"trans": [{"to": 0, "in": "a", "weight": 0.5}, {"to": 0, "in": "b", "weight": 0.5}]}]})
    assert cli.run([two, "-G", "--dot-no-merge"]).count("->") == 2 and cli.run([two, "-G"]).count("->") == 1
