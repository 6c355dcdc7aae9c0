"""Registered queries of the transducer engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.presets import preset
from weft.operators import algebra as A
from weft.operators import decode as D
from weft.operators import graph as G
from weft.operators import infer as I
from weft.operators import relational as R
from weft.operators import train as T
from weft.operators.kernels import MAX, SUM
from weft.plans.machine import Edge, Machine
from weft.sources import formats as S
from weft.sources.regex import regex

EVENTS = ["click", "error", "purchase", "signup", "view"]
#: A two-state model of event sequences: state changes, symbols by state, ways to the end.
CHANGE = [[0.8, 0.2], [0.3, 0.7]]
EMIT = [[0.35, 0.05, 0.1, 0.2, 0.3], [0.1, 0.45, 0.25, 0.05, 0.15]]
STOP = [0.5, 0.4]
#: A two-state transducer of event types: repeats an error, drops a view, marks the rest.
MARK = [(0, 0, "click", "c", 1.0), (0, 1, "error", "e", 0.5), (0, 0, "error", "f", 0.5), (0, 0, "view", "", 0.25), (0, 1, "view", "v", 0.75), (0, 0, "signup", "s", 1.0), (1, 0, "click", "c", 0.5), (1, 1, "purchase", "p", 1.0), (1, 0, "view", "v", 0.5), (1, 1, "error", "e", 1.0)]
EDGE = "src int, dst int, in_sym string, out_sym string, w double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_model() -> Machine:
    return Machine([[*[Edge(d, sym, "", CHANGE[s][d] * EMIT[s][k]) for d in (0, 1) for k, sym in enumerate(EVENTS)], Edge(2, weight=STOP[s])] for s in (0, 1)] + [[]])


def event_sequences(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x["event_type"]).alias("seq"))


def bigrams(spark, sf_dir) -> DataFrame:
    """Edges between event types, weighted by how often one follows the other for a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(w).alias("nxt")).filter("nxt is not null")
    index = F.array(*[F.lit(x) for x in EVENTS])
    at = lambda c: (F.array_position(index, F.col(c)) - 1).cast("int")
    return e.groupBy(at("event_type").alias("src"), at("nxt").alias("dst"), F.col("event_type").alias("in_sym"), F.col("nxt").alias("out_sym")).agg(F.count("*").cast("double").alias("w"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def mark(spark) -> DataFrame:
    return spark.createDataFrame(MARK, EDGE)


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


SQL_SEQ = "seq AS (SELECT user_id, event_type AS sym, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
SQL_BG = f"""ty(sym, idx) AS (VALUES {_rows([(x, k) for k, x in enumerate(EVENTS)])}),
 nx AS (SELECT event_type AS sym, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
 bg AS (SELECT a.idx AS src, b.idx AS dst, nx.sym AS in_sym, nx.nxt AS out_sym, count(*)::DOUBLE AS w FROM nx JOIN ty a ON a.sym = nx.sym JOIN ty b ON b.sym = nx.nxt GROUP BY ALL)"""
SQL_MARK = f"mk(src, dst, in_sym, out_sym, w) AS (VALUES {_rows(MARK)})"
_STEPS = [(s, d, sym, CHANGE[s][d] * EMIT[s][k]) for s in (0, 1) for d in (0, 1) for k, sym in enumerate(EVENTS)]
SQL_TR = f"tr(src, dst, sym, w) AS (VALUES {_rows(_STEPS)}), stop(st, w) AS (VALUES {_rows([(s, STOP[s]) for s in (0, 1)])})"


def _forward(agg: str, extra: str = "", path: str = "") -> str:
    return f"""f(user_id, pos, st, w{extra}) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 1.0::DOUBLE{path and ", []::INTEGER[]"} FROM events
 UNION ALL SELECT f.user_id, f.pos + 1, tr.dst, {agg}(f.w * tr.w){path} FROM f JOIN seq s ON s.user_id = f.user_id AND s.pos = f.pos + 1 JOIN tr ON tr.src = f.st AND tr.sym = s.sym GROUP BY f.user_id, f.pos, tr.dst)"""


SQL_BACK = """len AS (SELECT user_id, max(pos) AS n FROM seq GROUP BY user_id),
 b(user_id, pos, st, w) AS (SELECT user_id, n, st, w FROM len, stop
 UNION ALL SELECT b.user_id, b.pos - 1, tr.src, sum(b.w * tr.w) FROM b JOIN seq s ON s.user_id = b.user_id AND s.pos = b.pos JOIN tr ON tr.dst = b.st AND tr.sym = s.sym GROUP BY b.user_id, b.pos, tr.src)"""
SQL_Z = "z AS (SELECT user_id, w FROM b WHERE pos = 0 AND st = 0)"
SQL_COUNT = "SELECT tr.src, tr.dst, tr.sym, sum(f.w * tr.w * b.w / z.w) AS cnt FROM f JOIN seq s ON s.user_id = f.user_id AND s.pos = f.pos + 1 JOIN tr ON tr.src = f.st AND tr.sym = s.sym JOIN b ON b.user_id = f.user_id AND b.pos = f.pos + 1 AND b.st = tr.dst JOIN z ON z.user_id = f.user_id GROUP BY ALL"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# relational algebra over edge tables
@query("SELECT o_orderkey AS chain, (i - 1)::INT AS src, i::INT AS dst, substr(o_orderpriority, i::INT, 1) AS out_sym FROM orders, generate_series(1, length(o_orderpriority)) t(i)")
def chain_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), F.posexplode(S.chars("o_orderpriority")).alias("src", "out_sym"))
    return o.select("chain", "src", (F.col("src") + 1).alias("dst"), "out_sym")


@query(f"WITH {SQL_BG} SELECT src, dst, in_sym, out_sym, w FROM bg")
def bigram_machine(spark, sf_dir):
    return bigrams(spark, sf_dir)


@query(f"WITH {SQL_BG} SELECT 'in' AS side, in_sym AS sym FROM bg UNION SELECT 'out', out_sym FROM bg")
def alphabet(spark, sf_dir):
    return R.alphabet(bigrams(spark, sf_dir))


@query(f"WITH {SQL_BG} SELECT (SELECT sum(n)::BIGINT FROM (SELECT count(*) n FROM bg GROUP BY in_sym, out_sym)) AS transitions, (SELECT max(n) FROM (SELECT count(*) n FROM bg GROUP BY in_sym, out_sym)) AS conditioned, (SELECT count(*) FROM (SELECT src FROM bg UNION SELECT dst FROM bg)) AS states")
def machine_stats(spark, sf_dir):
    return R.stats(bigrams(spark, sf_dir))


@query(f"WITH {SQL_BG} SELECT src, dst, in_sym, out_sym, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM bg")
def joint_norm(spark, sf_dir):
    return rounded(R.joint_norm(bigrams(spark, sf_dir)), "w")


@query(f"WITH {SQL_BG} SELECT src, dst, in_sym, out_sym, round(w / sum(w) OVER (PARTITION BY src, in_sym), 6) AS w FROM bg")
def cond_norm(spark, sf_dir):
    return rounded(R.cond_norm(bigrams(spark, sf_dir)), "w")


@query(f"WITH {SQL_BG} SELECT src, dst, out_sym AS in_sym, in_sym AS out_sym, w FROM bg")
def transpose(spark, sf_dir):
    return R.transpose(bigrams(spark, sf_dir))


@query(f"WITH {SQL_BG} SELECT 4 - dst AS src, 4 - src AS dst, in_sym, out_sym, w FROM bg")
def reverse(spark, sf_dir):
    return R.reverse(bigrams(spark, sf_dir), 5)


@query(f"WITH {SQL_BG} SELECT src, dst, in_sym, '' AS out_sym, sum(w) AS w FROM bg GROUP BY ALL")
def silence_output(spark, sf_dir):
    return R.collapse(R.silence(bigrams(spark, sf_dir), "out"))


@query(f"WITH {SQL_BG} SELECT src, dst, '' AS in_sym, out_sym, sum(w) AS w FROM bg GROUP BY ALL")
def silence_input(spark, sf_dir):
    return R.collapse(R.silence(bigrams(spark, sf_dir), "in"))


@query(f"WITH {SQL_BG}, {SQL_MARK} SELECT src, dst, in_sym, out_sym, w FROM bg UNION ALL SELECT src + 5, dst + 5, in_sym, out_sym, w FROM mk UNION ALL SELECT 4, 5, '', '', 1.0")
def concat(spark, sf_dir):
    return R.concat(bigrams(spark, sf_dir), 5, mark(spark))


@query(f"WITH {SQL_BG}, {SQL_MARK} SELECT src + 1 AS src, dst + 1 AS dst, in_sym, out_sym, w FROM bg UNION ALL SELECT src + 6, dst + 6, in_sym, out_sym, w FROM mk UNION ALL SELECT * FROM (VALUES (0, 1, '', '', 0.25::DOUBLE), (0, 6, '', '', 0.75::DOUBLE), (5, 8, '', '', 1::DOUBLE), (7, 8, '', '', 1::DOUBLE))")
def union(spark, sf_dir):
    return R.union(bigrams(spark, sf_dir), 5, mark(spark), 2, 0.25)


@query(f"WITH {SQL_BG} SELECT src + 1 AS src, dst + 1 AS dst, in_sym, out_sym, w FROM bg UNION ALL SELECT * FROM (VALUES (0, 1, '', '', 1::DOUBLE), (5, 1, '', '', 1::DOUBLE), (5, 6, '', '', 1::DOUBLE), (0, 6, '', '', 1::DOUBLE))")
def star(spark, sf_dir):
    return R.star(bigrams(spark, sf_dir), 5)


@query(f"WITH {SQL_BG}, {SQL_MARK} SELECT src, dst, in_sym, out_sym, w FROM bg UNION ALL SELECT src + 5, dst + 5, in_sym, out_sym, w FROM mk UNION ALL SELECT * FROM (VALUES (4, 5, '', '', 1::DOUBLE), (4, 7, '', '', 1::DOUBLE), (6, 0, '', '', 1::DOUBLE))")
def loop(spark, sf_dir):
    return R.loop(bigrams(spark, sf_dir), 5, mark(spark), 2)


SQL_COMP = f"{SQL_BG}, {SQL_MARK}, cp AS (SELECT a.src * 2 + b.src AS src, a.dst * 2 + b.dst AS dst, a.in_sym, b.out_sym, sum(a.w * b.w) AS w FROM bg a JOIN mk b ON a.out_sym = b.in_sym GROUP BY ALL)"


@query(f"WITH {SQL_COMP} SELECT src, dst, in_sym, out_sym, round(w, 6) AS w FROM cp")
def compose_edges(spark, sf_dir):
    return rounded(R.compose(bigrams(spark, sf_dir), mark(spark), 2), "w")


@query(f"WITH {SQL_BG}, {SQL_MARK} SELECT a.src * 2 + b.src AS src, a.dst * 2 + b.dst AS dst, a.in_sym, '' AS out_sym, round(a.w * b.w, 6) AS w FROM bg a JOIN mk b ON a.in_sym = b.in_sym")
def intersect_edges(spark, sf_dir):
    a, b = R.silence(bigrams(spark, sf_dir), "out"), R.silence(mark(spark), "out")
    return rounded(R.intersect(a, b, 2), "w")


@query(f"WITH RECURSIVE {SQL_COMP}, r(state) AS (SELECT 0 UNION SELECT cp.dst FROM cp JOIN r ON cp.src = r.state) SELECT state FROM r")
def reachable_states(spark, sf_dir):
    start = spark.createDataFrame([(0,)], "state int")
    return R.reachable(R.compose(bigrams(spark, sf_dir), mark(spark), 2), start)


@query("""WITH e AS (SELECT l_orderkey AS src, l_linenumber::INT AS dst, l_returnflag AS in_sym, l_linestatus AS out_sym, count(*) AS w FROM lineitem GROUP BY ALL),
 s AS (SELECT src, string_agg(dst || ',' || in_sym || ',' || out_sym || ',' || w, ';' ORDER BY dst, in_sym, out_sym, w) AS sig FROM e GROUP BY src)
 SELECT min(src) AS state, count(*) AS states FROM s GROUP BY sig""")
def merge_states_signature(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_linenumber").cast("int").alias("dst"), F.col("l_returnflag").alias("in_sym"), F.col("l_linestatus").alias("out_sym")).agg(F.count("*").cast("double").alias("w"))
    return R.signatures(e)


# inference over sequences
@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('sum')} SELECT f.user_id, round(ln(sum(f.w * stop.w)), 6) AS loglike FROM f JOIN stop ON stop.st = f.st JOIN (SELECT user_id, max(pos) n FROM seq GROUP BY 1) l ON l.user_id = f.user_id AND l.n = f.pos GROUP BY f.user_id")
def forward_events(spark, sf_dir):
    s = event_sequences(spark, sf_dir)
    return s.select("user_id", F.round(I.forward_column(event_model(), "seq"), 6).alias("loglike"))


@query(SQL["forward_events"])
def forward_events_kernel(spark, sf_dir):
    s = I.score(event_sequences(spark, sf_dir), event_model(), "seq")
    return rounded(s.select("user_id", "loglike"), "loglike")


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('max')} SELECT f.user_id, round(ln(max(f.w * stop.w)), 6) AS loglike FROM f JOIN stop ON stop.st = f.st JOIN (SELECT user_id, max(pos) n FROM seq GROUP BY 1) l ON l.user_id = f.user_id AND l.n = f.pos GROUP BY f.user_id")
def viterbi_events(spark, sf_dir):
    s = event_sequences(spark, sf_dir)
    return s.select("user_id", F.round(I.forward_column(event_model(), "seq", ring=MAX), 6).alias("loglike"))


@query(SQL["forward_events"])
def forward_chunked(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).alias("pos"))
    return rounded(I.forward_chunks(rows, event_model(), "user_id", "pos", "event_type", chunk=16), "loglike")


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {SQL_BACK} SELECT user_id, pos::INT AS in_pos, st AS state_idx, round(ln(w), 6) AS loglike FROM b")
def backward_events(spark, sf_dir):
    c = I.cells(event_sequences(spark, sf_dir), event_model(), ["user_id"], "seq", backward=True).filter("state_idx < 2")
    return rounded(c.select("user_id", "in_pos", "state_idx", "loglike"), "loglike")


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('sum')}, {SQL_BACK}, {SQL_Z} SELECT f.user_id, f.pos::INT AS in_pos, f.st AS state_idx, round(f.w * b.w / z.w, 6) AS p FROM f JOIN b ON b.user_id = f.user_id AND b.pos = f.pos AND b.st = f.st JOIN z ON z.user_id = f.user_id")
def posterior_states(spark, sf_dir):
    p = I.posteriors(event_sequences(spark, sf_dir), event_model(), ["user_id"], "seq").filter("state_idx < 2")
    return rounded(p.select("user_id", "in_pos", "state_idx", "p"), "p")


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('sum')}, {SQL_BACK}, {SQL_Z} SELECT src, dst, sym, round(cnt, 4) AS cnt FROM ({SQL_COUNT})")
def edge_counts(spark, sf_dir):
    return _edge_counts(spark, sf_dir).withColumn("cnt", F.round("cnt", 4))


def _edge_counts(spark, sf_dir):
    m = event_model()
    c = I.edge_counts(event_sequences(spark, sf_dir), m, "seq")
    names = spark.createDataFrame([(s, k, e.dst, e.inp) for s, k, e in m.all_edges() if e.inp], "src int, ord int, dst int, sym string")
    return c.join(F.broadcast(names), ["src", "ord"]).select("src", "dst", "sym", "cnt")


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('sum')}, {SQL_BACK}, {SQL_Z} SELECT src, dst, round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY src), 6) AS p FROM ({SQL_COUNT}) GROUP BY src, dst")
def em_step(spark, sf_dir):
    return rounded(R.shares(_edge_counts(spark, sf_dir), ["src"], ["dst"]), "p")


_PATH = ", arg_max(list_append(f.path, tr.dst::INTEGER), f.w * tr.w)"


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('max', ', path', _PATH)} SELECT f.user_id, array_to_string(arg_max(f.path, f.w * stop.w), '') AS states FROM f JOIN stop ON stop.st = f.st JOIN (SELECT user_id, max(pos) n FROM seq GROUP BY 1) l ON l.user_id = f.user_id AND l.n = f.pos GROUP BY f.user_id")
def viterbi_path_events(spark, sf_dir):
    p = I.paths(event_sequences(spark, sf_dir), event_model(), ["user_id"], "seq").filter("in_sym <> ''")
    p = p.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("step", "dst"))).alias("p"))
    return p.select("user_id", F.array_join(F.transform("p", lambda x: x["dst"].cast("string")), "").alias("states"))


# two tapes
def part_pairs(spark, sf_dir, col):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col(col).alias("a"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(nxt, "p_partkey")


def letters(df: DataFrame, *cols) -> list[str]:
    """The distinct characters of some columns (at most a character set's size)."""
    u = df.select(F.explode(F.array_distinct(F.concat(*[S.chars(c) for c in cols]))).alias("c")).distinct()
    return sorted(r.c for r in u.collect())


@query("SELECT p.p_partkey, round((length(p.p_brand) - hamming(p.p_brand, n.p_brand)) * ln(0.9::DOUBLE) + hamming(p.p_brand, n.p_brand) * ln(0.1::DOUBLE), 6) AS loglike FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1 AND length(n.p_brand) = length(p.p_brand)")
def bsc_loglike(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir, "p_brand").filter("length(a) = length(b)")
    abc = letters(pairs, "a", "b")
    m = Machine([[Edge(0, x, y, "p" if x == y else "q") for x in abc for y in abc]])
    s = I.score(pairs.select("p_partkey", S.chars("a").alias("x"), S.chars("b").alias("y")), m, "x", "y", {"p": 0.9, "q": 0.1})
    return rounded(s.select("p_partkey", "loglike"), "loglike")


@query("SELECT p.p_partkey, round((-levenshtein(p.p_name, n.p_name))::DOUBLE, 6) AS loglike FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1")
def edit_distance_viterbi(spark, sf_dir):
    pairs = part_pairs(spark, sf_dir, "p_name")
    abc = letters(pairs, "a", "b")
    cost = {"exp": -1}
    m = Machine([[*[Edge(0, x, y, 1 if x == y else cost) for x in abc for y in abc], *[Edge(0, x, "", cost) for x in abc], *[Edge(0, "", x, cost) for x in abc]]])
    s = I.score(pairs.select("p_partkey", S.chars("a").alias("x"), S.chars("b").alias("y")), m, "x", "y", ring=MAX)
    return rounded(s.select("p_partkey", "loglike"), "loglike")


PAIR_EDGES = [(0, 0, "M", 0.6), (0, 1, "I", 0.1), (0, 1, "D", 0.08), (1, 0, "M", 0.5), (1, 1, "I", 0.2), (1, 1, "D", 0.15)]


def _pair_sql(agg: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT p.p_partkey AS k, p.p_type AS s, n.p_type AS t FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1),
 tr(src, dst, kind, w) AS (VALUES {_rows(PAIR_EDGES)}),
 mv AS (SELECT src, dst, kind, (kind <> 'I')::INT AS di, (kind <> 'D')::INT AS dk, (kind = 'M')::INT AS need, w FROM tr
  UNION ALL SELECT st, st, 'carry', 0, 0, 0, 1.0::DOUBLE FROM (VALUES (0), (1)) v(st)),
 f(k, i, o, st, lag, w) AS (SELECT k, 0, 0, 0, 0, 1.0::DOUBLE FROM p
  UNION ALL SELECT f.k, f.i + di, f.o + dk, mv.dst, (kind = 'carry')::INT,
   {agg}(f.w * mv.w * CASE WHEN kind <> 'M' THEN 1.0::DOUBLE WHEN substr(s, f.i + 1, 1) = substr(t, f.o + 1, 1) THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END)
  FROM f JOIN mv ON mv.src = f.st AND mv.need = f.lag JOIN p USING (k)
  WHERE f.i + di <= length(s) AND f.o + dk <= length(t) AND NOT (kind = 'carry' AND f.lag = 1) GROUP BY ALL)
 SELECT k AS p_partkey, round(ln({agg}(w)), 6) AS loglike FROM f JOIN p USING (k) WHERE i = length(s) AND o = length(t) AND lag = 0 GROUP BY k"""


def _pair_score(spark, sf_dir, ring):
    pairs = part_pairs(spark, sf_dir, "p_type")
    abc = letters(pairs, "a", "b")
    edges: list[list[Edge]] = [[], [], []]
    for s, d, kind, w in PAIR_EDGES:
        if kind == "M":
            edges[s] += [Edge(d, x, y, w if x == y else w * 0.05) for x in abc for y in abc]
        else:
            edges[s] += [Edge(d, "", x, w) if kind == "I" else Edge(d, x, "", w) for x in abc]
    for s in (0, 1):
        edges[s].append(Edge(2))
    s = I.score(pairs.select("p_partkey", S.chars("a").alias("x"), S.chars("b").alias("y")), Machine(edges), "x", "y", ring=ring)
    return rounded(s.select("p_partkey", "loglike"), "loglike")


@query(_pair_sql("sum"))
def forward_pairs(spark, sf_dir):
    return _pair_score(spark, sf_dir, SUM)


@query(_pair_sql("max"))
def viterbi_pairs(spark, sf_dir):
    return _pair_score(spark, sf_dir, MAX)


PATTERN = r"^[A-Z]+ (BURNISHED|PLATED|POLISHED|BRUSHED) .*(TIN|STEEL|[A-Z]{4})$"


@query("SELECT p_partkey, regexp_full_match(p_type, '[A-Z]+ (BURNISHED|PLATED|POLISHED|BRUSHED) .*(TIN|STEEL|[A-Z]{4})') AS accepted FROM part")
def regex_accepts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars("p_type").alias("x"))
    return I.accepts(p, regex(PATTERN), "x").select("p_partkey", "accepted")


@query("SELECT p_partkey, upper(p_name) AS upper_name FROM part")
def toupper_transduce(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars("p_name").alias("x"))
    return D.decode(p, preset("toupper"), "x", "viterbi", encode=True).select("p_partkey", F.array_join("decoded", "").alias("upper_name"))


def dna(col):
    """A digit string as bases."""
    return F.translate(col, "0123456789", "ACGTACGTAC")


SQL_DNA = "translate(o_orderkey::VARCHAR, '0123456789', 'ACGTACGTAC')"


@query(f"SELECT o_orderkey, reverse(translate({SQL_DNA}, 'ACGT', 'TGCA')) AS bases FROM orders")
def revcomp_transduce(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.reverse(S.chars(dna(F.col("o_orderkey").cast("string")))).alias("x"))
    return D.decode(o, preset("compdna"), "x", "viterbi", encode=True).select("o_orderkey", F.array_join("decoded", "").alias("bases"))


@query(f"SELECT o_orderkey, translate({SQL_DNA}, 'T', 'U') AS bases FROM orders")
def dna2rna(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.chars(dna(F.col("o_orderkey").cast("string"))).alias("x"))
    return D.decode(o, preset("dna2rna"), "x", "viterbi", encode=True).select("o_orderkey", F.array_join("decoded", "").alias("bases"))


WEIGHTS = {"A": 0.4, "C": 0.3, "G": 0.2, "T": 0.1}


@query("""WITH s AS (SELECT vec_id, i // 4 AS pos, sum(CASE i % 4 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END * (1 + embedding[i + 1]::DOUBLE * embedding[i + 1]::DOUBLE)) AS p
 FROM embeddings, generate_series(0, 63) t(i) GROUP BY ALL) SELECT vec_id, round(sum(ln(p)), 6) AS loglike FROM s GROUP BY vec_id""")
def profile_forward(spark, sf_dir):
    """Vectors as soft sequences: sixteen positions of four weights."""
    e = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64")
    sq = F.transform("embedding", lambda x: 1 + x.cast("double") * x.cast("double"))
    soft = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(sq, k * 4 + 1, 4))
    m = Machine([[Edge(0, c, "", w) for c, w in WEIGHTS.items()]])
    return rounded(I.score(e.select("vec_id", soft.alias("x")), m, "x").select("vec_id", "loglike"), "loglike")


@query("SELECT p_partkey, substr(p_name, i::INT, 3) AS kmer, list((i - 1)::INT ORDER BY i) AS positions FROM part, generate_series(1, length(p_name) - 2) t(i) GROUP BY ALL")
def kmer_index(spark, sf_dir):
    return S.kmers(table(spark, sf_dir, "part"), 3, "p_name", "p_partkey")


@query("SELECT r_name, n_name FROM region, nation")
def pairs_cross(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), S.chars("r_name").alias("sequence"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), S.chars("n_name").alias("sequence"))
    return S.cross_pairs(a, b).select(F.col("input.name").alias("r_name"), F.col("output.name").alias("n_name"))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus AS sym, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
 SELECT o_custkey, string_agg(CASE sym WHEN 'F' THEN 'f' WHEN 'O' THEN 'o' ELSE 'p' END, '' ORDER BY k) AS decoded FROM s GROUP BY o_custkey""")
def beam_decode_orders(spark, sf_dir):
    """Statuses read through a noisy channel whose inputs are lower case; the beam finds the likeliest input."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("o"))
    m = Machine([[Edge(0, x, y, 0.8 if x == y.lower() else 0.1) for x in "fop" for y in "FOP"]])
    d = D.decode(o.select("o_custkey", F.transform("o", lambda x: x["o_orderstatus"]).alias("y")), m, "y", "beam", width=16)
    return d.select("o_custkey", F.array_join("decoded", "").alias("decoded"))


@query("""WITH a AS (SELECT p.p_partkey, p.p_brand AS x, n.p_brand AS y, o FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1, generate_series(0, length(n.p_brand)) t(o))
 SELECT p_partkey, o::INT AS out_pos, greatest(o - 1, 0)::INT AS in_start, (least(o + 1, length(x)) + 1)::INT AS in_end FROM a WHERE length(x) = length(y)""")
def envelope_rows(spark, sf_dir):
    """Envelopes one match wide around gapless alignments of neighbouring brands."""
    p = part_pairs(spark, sf_dir, "p_brand").filter("length(a) = length(b)").select("p_partkey", S.chars("a").alias("x"), S.chars("b").alias("y"))
    p = p.withColumn("columns", F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    e = S.envelopes(p, "x", "y", "columns", 1).select("p_partkey", F.posexplode("envelope").alias("out_pos", "e"))
    return e.select("p_partkey", "out_pos", F.col("e.lo").alias("in_start"), F.col("e.hi").alias("in_end"))


# results that SQL can't express: goldens and laws are in the tests
@query()
def sample_paths(spark, sf_dir):
    p = I.paths(event_sequences(spark, sf_dir), event_model(), ["user_id"], "seq", seed=7)
    return p.groupBy("user_id").agg(F.count("*").alias("steps"), F.sum((F.col("dst") == 1).cast("long")).alias("busy"))


@query()
def em_fit(spark, sf_dir):
    m = Machine([[Edge(0, s, "", {"*": ["stay", f"e{s}"]}) for s in EVENTS] + [Edge(1, weight={"not": "stay"})], []], None, {}, {"norm": [[f"e{s}" for s in EVENTS]], "prob": ["stay"]})
    p, _ = T.fit(event_sequences(spark, sf_dir), m, "seq")
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(p.items())], "param string, value double")


@query()
def mcmc_decode(spark, sf_dir):
    m = G.compose(A.wild("echo", "01"), preset("bintern"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", S.chars(F.conv(F.col("n_nationkey").cast("string"), 10, 3)).alias("y"))
    return D.decode(n, m, "y", "mcmc", steps=5).select("n_nationkey", F.array_join("decoded", "").alias("bits"), "decoded_ll")


@query()
def random_encode(spark, sf_dir):
    m = Machine([[Edge(0, x, y, 0.9 if x == y else 0.05) for x in "FOP" for y in "FOP"]])
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("o"))
    return D.decode(o.select("o_custkey", F.transform("o", lambda x: x["o_orderstatus"]).alias("y")), m, "y", "random", encode=True).select("o_custkey", F.array_join("decoded", "").alias("drawn"))


@query()
def prefix_decode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.chars(F.conv(F.col("p_size").cast("string"), 10, 2)).alias("x"))
    e = D.decode(p, preset("hamming31"), "x", "viterbi", encode=True).select("p_partkey", "x", F.col("decoded").alias("y"))
    return D.decode(e, preset("hamming31"), "y", "prefix").select("p_partkey", F.array_join("x", "").alias("bits"), F.array_join("decoded", "").alias("decoded"))


@query()
def fused_plan7(spark, sf_dir):
    """A small profile with flanks, written through a noisy copier, against order keys as bases."""
    from weft.operators.position import fused_score

    stay = {"mm": 0.9, "mi": 0.05, "md": 0.05, "im": 0.7, "ii": 0.3, "dm": 0.8, "dd": 0.2}
    emit = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.1, 0.1, 0.1, 0.7]]
    nodes = [{"ins": [0.25] * 4, **stay}, *[{"match": e, "ins": [0.25] * 4, **stay} for e in emit]]
    profile = S.hmmer_machine({"alphabet": list("ACGT"), "nodes": nodes}, "plan7", True, 20)
    noise = Machine([[Edge(0, a, b, 0.94 if a == b else 0.02) for a in "ACGT" for b in "ACGT"]])
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.chars(dna(F.col("o_orderkey").cast("string"))).alias("y"))
    return rounded(fused_score(o, profile, noise, "y").select("o_orderkey", "loglike"), "loglike")


# more of the algebra on edge tables
FACTORS = [("click", 0.5), ("error", 2.0), ("view", 0.25)]


@query(f"WITH {SQL_BG}, fa(sym, factor) AS (VALUES {_rows(FACTORS)}) SELECT src, dst, in_sym, out_sym, w * coalesce(factor, 1.0::DOUBLE) AS w FROM bg LEFT JOIN fa ON sym = in_sym")
def weight_input(spark, sf_dir):
    return R.weight_by_symbol(bigrams(spark, sf_dir), spark.createDataFrame(FACTORS, "sym string, factor double"))


@query(f"WITH {SQL_BG} SELECT src + 1 AS src, dst + 1 AS dst, in_sym, out_sym, w FROM bg UNION ALL SELECT * FROM (VALUES (0, 1, '', '', 1::DOUBLE), (5, 1, '', '', 1::DOUBLE), (5, 6, '', '', 1::DOUBLE))")
def kleene_plus(spark, sf_dir):
    return R.plus(bigrams(spark, sf_dir), 5)


@query(f"WITH {SQL_BG}, k AS (SELECT src, max(w) AS top FROM bg GROUP BY src) SELECT bg.src, dst, in_sym, out_sym, w FROM bg JOIN k ON k.src = bg.src AND w >= 0.95::DOUBLE * top")
def subgraph(spark, sf_dir):
    """Edges flagged as likely, kept by a semi-join."""
    t = bigrams(spark, sf_dir)
    flags = t.withColumn("top", F.max("w").over(Window.partitionBy("src"))).filter(F.col("w") >= F.lit(0.95) * F.col("top")).select("src", "dst", "in_sym", "out_sym")
    return R.subgraph(t, flags)


@query(f"WITH {SQL_COMP} SELECT src, dst, string_agg(in_sym || '/' || out_sym, ',' ORDER BY in_sym, out_sym) AS label FROM cp GROUP BY src, dst")
def dot_labels(spark, sf_dir):
    """Edge labels of a drawing: parallel edges share one arrow."""
    return R.labels(R.compose(bigrams(spark, sf_dir), mark(spark), 2))


@query(f"WITH {SQL_BG} SELECT s.src AS state, count(*) FILTER (in_sym = '') = 0 AS waits, count(*) FILTER (in_sym <> '') = 0 AS continues, count(*) AS edges FROM (SELECT src, in_sym FROM bg UNION ALL SELECT src, '' FROM bg WHERE src < 2) s GROUP BY s.src")
def state_predicates(spark, sf_dir):
    t = bigrams(spark, sf_dir).select("src", "in_sym")
    return R.predicates(t.unionByName(t.filter("src < 2").withColumn("in_sym", F.lit(""))))


CHANGES = {f"c{s}{d}": CHANGE[s][d] for s in (0, 1) for d in (0, 1)}


def parametric_model() -> Machine:
    return Machine([[*[Edge(d, sym, "", {"*": [f"c{s}{d}", EMIT[s][k]]}) for d in (0, 1) for k, sym in enumerate(EVENTS)], Edge(2, weight=STOP[s])] for s in (0, 1)] + [[]])


@query(f"WITH RECURSIVE {SQL_SEQ}, {SQL_TR}, {_forward('sum')}, {SQL_BACK}, {SQL_Z} SELECT 'c' || src || dst AS param, round(sum(cnt), 4) AS cnt FROM ({SQL_COUNT}) GROUP BY src, dst")
def param_counts(spark, sf_dir):
    m = parametric_model()
    got = I.param_counts(I.edge_counts(event_sequences(spark, sf_dir), m, "seq", values=CHANGES), m, CHANGES)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in sorted(got.items())], "param string, cnt double")


@query(f"WITH {SQL_SEQ} SELECT user_id, bool_and(sym <> 'signup' OR pos < n) AS accepted FROM seq GROUP BY user_id")
def language_members(spark, sf_dir):
    """Users whose last event isn't a signup: membership in a regular language, as a column."""
    m = Machine([[*[Edge(0, s) for s in EVENTS], *[Edge(1, s) for s in EVENTS if s != "signup"]], []])
    s = event_sequences(spark, sf_dir)
    return s.select("user_id", (I.forward_column(m, "seq", ring=MAX) > float("-inf")).alias("accepted"))


@query("SELECT n_name AS name, upper(n_name) AS generated FROM nation")
def generated_strings(spark, sf_dir):
    """Chains of nation names composed with the upper-case machine: the one string each product writes."""
    rows = []
    for r in table(spark, sf_dir, "nation").select("n_name").collect():  # one machine a nation, a fixed dimension
        m = G.compose(A.generate(r.n_name), preset("toupper"))
        rows.append((r.n_name, "".join(e.out for _, _, e in m.all_edges())))
    return spark.createDataFrame(rows, "name string, generated string")


@query("SELECT user_id, round(sum(CASE event_type WHEN 'error' THEN ln(0.5::DOUBLE) WHEN 'view' THEN ln(0.25::DOUBLE) ELSE 0 END), 6) AS loglike FROM events GROUP BY user_id")
def evaluated_weights(spark, sf_dir):
    """Symbolic weights (definitions, powers, exponentials) evaluated into a one-state machine."""
    m = Machine([[Edge(0, s, "", {"error": "half", "view": {"pow": ["half", 2]}}.get(s, {"exp": {"log": 1}})) for s in EVENTS]], None, {"half": {"/": [1, 2]}})
    s = event_sequences(spark, sf_dir)
    return s.select("user_id", F.round(I.forward_column(m.evaluated(), "seq"), 6).alias("loglike"))


@query(f"SELECT word, CASE WHEN word LIKE '%C' THEN 2 ELSE 1 END::BIGINT AS derivations FROM (SELECT DISTINCT substr({SQL_DNA}, 1, n) AS word FROM orders, (VALUES (1), (2)) v(n)) WHERE regexp_full_match(word, 'A?[CG]')")
def derivations(spark, sf_dir):
    """Weights as numbers of derivations: (A)?(C|G|C) over the first one and two bases of order keys."""
    m = A.concat(A.optional(A.recognize("A")), A.union(A.recognize("C"), A.union(A.recognize("G"), A.recognize("C"))))
    bases = dna(F.col("o_orderkey").cast("string"))
    o = table(spark, sf_dir, "orders")
    words = o.select(F.explode(F.array(F.substring(bases, 1, 1), F.substring(bases, 1, 2))).alias("word")).distinct()
    s = I.score(words.withColumn("x", S.chars("word")), G.eliminate_silent(m), "x").filter("loglike > double('-infinity')")
    return s.select("word", F.round(F.exp("loglike")).cast("long").alias("derivations"))
