"""Further registered queries: constructors, rewrites, weights and encodings of the engine, each held against SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weft.functions import generators as Gen
from weft.functions.presets import preset
from weft.operators import algebra as A
from weft.operators import decode as D
from weft.operators import graph as G
from weft.operators import infer as I
from weft.plans.machine import Edge, Machine
from weft.queries import EVENTS, SQL, SQL_DNA, _rows, dna, event_model, event_sequences, letters, query, rounded, table
from weft.sources import formats as S

UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _finite(df, name="loglike"):
    """Impossible rows as null: SQL has no logarithm of 0."""
    return df.withColumn(name, F.when(F.col(name) > float("-inf"), F.round(name, 6) + F.lit(0.0)))


def _scored(df, machines: dict, label: str, keys: list[str], seq: str, values: dict | None = None):
    """A row for each row and named machine with its log score."""
    each = [_finite(I.score(df, m, seq, None, values)).select(*keys, F.lit(k).alias(label), "loglike") for k, m in machines.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


# constructors
@query("""SELECT o_orderkey, m AS machine, CASE m WHEN 'wild' THEN 0.0::DOUBLE WHEN 'iid' THEN round(length(p) * ln(0.25::DOUBLE), 6) WHEN 'uniform' THEN round(-length(p) * ln(38::DOUBLE), 6)
 WHEN 'one' THEN CASE WHEN length(p) = 1 THEN 0.0::DOUBLE END WHEN 'recognize' THEN CASE WHEN p = '1-URGENT' THEN 0.0::DOUBLE END WHEN 'weight' THEN round(ln(0.5::DOUBLE), 6) WHEN 'null' THEN NULL WHEN 'geometric' THEN round(length(p) * ln(0.9::DOUBLE) + ln(0.1::DOUBLE), 6) END AS loglike
 FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders), (VALUES ('wild'), ('iid'), ('uniform'), ('one'), ('recognize'), ('weight'), ('null'), ('geometric')) v(m)""")
def constructor_scores(spark, sf_dir):
    abc = UPPER + DIGITS + "- "
    wild = A.wild("recognize", abc)
    made = {
        "wild": wild, "iid": A.iid("recognize", abc, "0.25"), "uniform": A.uniform("recognize", abc), "one": A.one("recognize", abc), "recognize": A.recognize("1-URGENT"),
        "weight": A.concat(A.weight(0.5), wild), "null": A.concat(A.null(), A.zero()), "geometric": A.weight_input_geom(wild, "0.9"),
    }
    return _scored(table(spark, sf_dir, "orders").select("o_orderkey", S.chars("o_orderpriority").alias("x")), made, "machine", ["o_orderkey"], "x")


PATTERNS = {
    "digit-words": "[0-9]-[A-Z ]*",
    "optional digit": "[0-9]?[-A-Z ]+",
    "four letters": "[0-9]-[A-Z]{4}",
    "flanked O": ".*O.*",
    "two words": "[0-9]-[A-Z]+( [A-Z]+)+",
    "ends in T": ".*T",
}


@query(f"SELECT o_orderkey, v.name AS pattern, regexp_full_match(o_orderpriority, v.re) AS accepted FROM orders, (VALUES {_rows(list(PATTERNS.items()))}) v(name, re)")
def algebra_members(spark, sf_dir):
    """Concatenation, quantifiers, repeats, loops and flanks as machines against regular expressions."""
    digit, word, blank, dash = (A.one("recognize", x) for x in (DIGITS, UPPER, " ", "-"))
    letter, any_ = A.one("recognize", UPPER + " "), A.wild("recognize", UPPER + DIGITS + "- ")
    rest = A.one("recognize", UPPER + "- ")
    made = {
        "digit-words": A.concat(digit, A.concat(dash, A.star(letter))),
        "optional digit": A.concat(A.optional(digit), A.plus(rest)),
        "four letters": A.concat(A.concat(digit, dash), A.repeat(word, 4)),
        "flanked O": A.flank(A.recognize("O"), any_),
        "two words": A.concat(A.concat(digit, dash), A.concat(A.plus(word), A.plus(A.concat(blank, A.plus(word))))),
        "ends in T": A.concat(any_, A.recognize("T")),
    }
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.chars("o_orderpriority").alias("x"))
    each = [I.accepts(o, m, "x").select("o_orderkey", F.lit(k).alias("pattern"), "accepted") for k, m in made.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("SELECT p_partkey, round((length(p_name) - length(replace(p_name, 'a', ''))) * ln(0.5::DOUBLE), 6) + 0.0 AS loglike FROM part")
def count_copies(spark, sf_dir):
    """Copies of a letter counted by a parameter: the score under a half is the number of copies times its logarithm."""
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars("p_name").alias("x"))
    others = A.star(A.one("recognize", [c for c in letters(table(spark, sf_dir, "part"), "p_name") if c != "a"]))
    m = A.concat(others, A.count_copies(A.concat(A.recognize("a"), others), "n"))
    return _finite(I.score(p, m, "x", None, {"n": 0.5}).select("p_partkey", "loglike"))


@query("SELECT p_partkey, kind, CASE kind WHEN 'weighted' THEN 1 ELSE -1 END * round(length(p_brand) * ln(0.25::DOUBLE), 6) AS loglike FROM part, (VALUES ('weighted'), ('reciprocal')) v(kind)")
def reciprocal_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars("p_brand").alias("x"))
    m = A.weight_input(A.wild("recognize", letters(table(spark, sf_dir, "part"), "p_brand")), "0.25")
    return _scored(p, {"weighted": m, "reciprocal": A.reciprocal(m)}, "kind", ["p_partkey"], "x")


@query("SELECT n_nationkey, how, n_name AS copied FROM nation, (VALUES ('inputs'), ('outputs')) v(how)")
def copied_labels(spark, sf_dir):
    """A recogniser whose inputs are copied to its outputs (and a generator the other way) transduces a name to itself."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", S.chars("n_name").alias("x"))
    abc = letters(table(spark, sf_dir, "nation"), "n_name")
    made = {"inputs": A.copy_input_to_output(A.wild("recognize", abc)), "outputs": A.copy_output_to_input(A.wild("generate", abc))}
    each = [D.decode(n, A.concat(m, A.null()), "x", "viterbi", encode=True).select("n_nationkey", F.lit(k).alias("how"), F.array_join("decoded", "").alias("copied")) for k, m in made.items()]
    return each[0].unionByName(each[1])


# rewrites that keep what a machine computes
REWRITES = {
    "eliminate_silent": G.eliminate_silent, "eliminate_states": G.eliminate_states, "merge_states": G.merge_states, "accumulate": G.accumulate, "ergodic": G.ergodic, "waiting": G.waiting,
    "sort": G.sort, "sort_fast": lambda m: G.sort(m, "break"), "sort_cyclic": lambda m: G.sort(m, "leave"), "advance_sort": G.advance_sort, "decode_sort": G.decode_sort, "encode_sort": G.encode_sort, "full_sort": G.full_sort, "sum_cycles": G.sum_cycles,
    "pad": A.pad, "strip_names": A.strip_names, "twice_transposed": lambda m: A.transpose(A.transpose(m)), "twice_reversed": lambda m: A.reverse(A.reverse(m)), "silenced_output": A.silence_output,
    "json": lambda m: Machine.from_json(m.to_json()), "json_named": lambda m: Machine.from_json(m.to_json(name_states=True)), "json_expressions": lambda m: Machine.from_json(m.to_json(define_exprs=True)), "evaluated": lambda m: m.evaluated(),
    "composed": lambda m: G.compose(m, A.null()), "composed_echo": lambda m: G.compose(A.wild("echo", EVENTS), m), "composed_fast": lambda m: G.compose(A.wild("echo", EVENTS), m, "break"), "composed_cyclic": lambda m: G.compose(A.wild("echo", EVENTS), m, "leave"),
    "intersected": lambda m: G.intersect(m, A.wild("recognize", EVENTS)),
}


@query(f"WITH base AS ({SQL['forward_events']}) SELECT user_id, v.name AS rewrite, loglike FROM base, (VALUES {_rows([(k,) for k in REWRITES])}) v(name)")
def rewrite_scores(spark, sf_dir):
    s = event_sequences(spark, sf_dir)
    return _scored(s, {k: f(event_model()) for k, f in REWRITES.items()}, "rewrite", ["user_id"], "seq").select("user_id", "rewrite", "loglike")


BASES = {"A": 0.4, "C": 0.3, "G": 0.2, "T": 0.1}
_STRAND = " + ".join(f"(length(d) - length(replace(d, '{b}', ''))) * ln({{{c}}}::DOUBLE)" for b, c in (("A", "a"), ("C", "c"), ("G", "g"), ("T", "t")))


@query(f"""WITH s AS (SELECT o_orderkey, {SQL_DNA} AS d FROM orders), t AS (SELECT o_orderkey, {_STRAND.format(a=0.4, c=0.3, g=0.2, t=0.1)} AS one, {_STRAND.format(a=0.1, c=0.2, g=0.3, t=0.4)} AS two FROM s)
 SELECT o_orderkey, round(two, 6) AS revcomp, round(ln(0.5 * exp(one) + 0.5 * exp(two)), 6) AS both FROM t""")
def strand_scores(spark, sf_dir):
    """Reverse complement and double strand of a generator of bases."""
    m = Machine([[Edge(0, "", b, w) for b, w in BASES.items()]])
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.chars(dna(F.col("o_orderkey").cast("string"))).alias("y"))
    s = I.score(I.score(o, G.revcomp(m), None, "y", name="revcomp"), G.double_strand(m), None, "y", name="both")
    return rounded(s.select("o_orderkey", "revcomp", "both"), "revcomp", "both")


# weight expressions
_EXPR = {"click": "ln(0.5 * 0.5 + 0.1::DOUBLE)", "error": "ln(1 / (1 - 0.2::DOUBLE))", "purchase": "ln(1 - 0.3::DOUBLE)", "signup": "ln(0.75 - 0.25 * 0.5::DOUBLE)", "view": "ln(pow(0.5::DOUBLE, 3))"}


@query("SELECT user_id, round(sum(CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _EXPR.items()) + " END), 6) AS loglike FROM events GROUP BY user_id")
def expression_weights(spark, sf_dir):
    """Sums, differences, geometric sums, complements, infix text and definitions as weights, in the JVM."""
    w = {"click": {"+": [{"*": ["h", "h"]}, 0.1]}, "error": {"geomsum": 0.2}, "purchase": {"not": 0.3}, "signup": {"expr": "0.75 - 0.25 * h"}, "view": {"pow": ["h", 3]}}
    m = Machine.from_json({"state": [{"trans": [{"to": 0, "in": s, "weight": w[s]} for s in EVENTS]}], "defs": {"h": {"/": [1, 2]}}})
    return event_sequences(spark, sf_dir).select("user_id", F.round(I.forward_column(m.evaluated(), "seq"), 6).alias("loglike"))


@query("SELECT user_id, CASE WHEN bool_and(event_type <> 'signup') THEN round(count(*) * ln(0.25::DOUBLE), 6) END AS loglike FROM events GROUP BY user_id")
def unknown_symbols(spark, sf_dir):
    """A symbol that the machine doesn't know makes a sequence impossible."""
    m = A.iid("recognize", [s for s in EVENTS if s != "signup"], "1/#")
    return _finite(I.score(event_sequences(spark, sf_dir), m, "seq").select("user_id", "loglike"))


@query("SELECT o_orderkey, 0.0::DOUBLE AS loglike FROM orders")
def aligner_normalises(spark, sf_dir):
    """The outputs of any input add up to 1 under an aligner with a mixture of gap lengths."""
    v = {"gapOpen": 0.2, "gapMix1": 0.6, "gapMix2": 0.4, "gapExtend1": 0.3, "gapExtend2": 0.8, **{f"eqm{b}": w for b, w in BASES.items()}, **{f"sub{a}{b}": 0.85 if a == b else 0.05 for a in BASES for b in BASES}}
    m = A.silence_output(Gen.mixture_aligner("ACGT", gaps=2))
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.chars(dna(F.col("o_orderkey").cast("string"))).alias("x"))
    return _finite(I.score(o, m, "x", None, v).select("o_orderkey", "loglike"))


# encodings
@query("SELECT n_nationkey, upper(n_comment) AS upper_name FROM (SELECT n_nationkey, lower(n_name) AS n_comment FROM nation)")
def beam_encode(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", S.chars(F.lower("n_name")).alias("x"))
    return D.decode(n, preset("toupper"), "x", "beam", encode=True, width=4).select("n_nationkey", F.array_join("decoded", "").alias("upper_name"))


@query("SELECT p_partkey, lower(p_type) AS lower_type FROM part")
def tolower_transduce(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars("p_type").alias("x"))
    return D.decode(p, preset("tolower"), "x", "viterbi", encode=True).select("p_partkey", F.array_join("decoded", "").alias("lower_type"))


@query(f"SELECT o_orderkey, translate({SQL_DNA}, 'ACGT', 'TGCA') AS bases FROM orders")
def complement_transduce(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.chars(dna(F.col("o_orderkey").cast("string"))).alias("x"))
    return D.decode(o, preset("compdna"), "x", "viterbi", encode=True).select("o_orderkey", F.array_join("decoded", "").alias("bases"))


@query("SELECT p_partkey, regexp_replace(bin(p_size), '(.)', '\\1\\1\\1', 'g') AS code FROM part")
def hamming31_encode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars(F.bin("p_size")).alias("x"))
    return D.decode(p, preset("hamming31"), "x", "viterbi", encode=True).select("p_partkey", F.array_join("decoded", "").alias("code"))
