"""Sequence and model files: FASTA/FASTQ, sequence pairs, profiles, HMMER3, alignments, PAF."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weft.functions import weights as W
from weft.operators import algebra as A
from weft.plans.machine import Edge, Machine

NAMED = "struct<name:string,sequence:array<string>>"
PAIRS = f"input {NAMED}, output {NAMED}, alignment array<array<string>>, meta string"


def chars(c):
    """A string column as an array of its characters (empty for null)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


# FASTA and FASTQ: records are cut by the reader, fields by expressions
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, qual of each record; compressed files are fine; an empty file gives no rows."""
    # records are cut before a ">" that starts a line; the first one of a file keeps its own
    r = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^\\s*>", "").alias("value")).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 2)"), r"\s", "")
    return r.select(_name(head).alias("name"), _comment(head).alias("comment"), body.alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line records."""
    r = spark.read.text(path, wholetext=True).select(F.explode(F.expr(r"regexp_extract_all(value, '@([^\\n]*\\n[^\\n]*\\n\\+[^\\n]*\\n[^\\n]*)', 1)")).alias("v"))
    p = r.select(F.split("v", "\n").alias("p"))
    return p.select(_name(F.col("p")[0]).alias("name"), _comment(F.col("p")[0]).alias("comment"), F.col("p")[1].alias("seq"), F.col("p")[3].alias("qual"))


def _name(head):
    return F.regexp_extract(head, r"^(\S*)", 1)


def _comment(head):
    return F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1))


def write_fasta(df: DataFrame, path: str, width: int = 50) -> None:
    """FASTA, or FASTQ where a row has qualities."""
    title = F.concat_ws(" ", "name", F.when(F.col("comment") != "", F.col("comment")))
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    fasta = F.concat(F.lit(">"), title, F.lit("\n"), wrapped)
    fastq = F.concat(F.lit("@"), title, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    df.select(F.when(F.col("qual").isNotNull(), fastq).otherwise(fasta).alias("value")).write.text(path)


def kmers(df: DataFrame, k: int, seq: str = "seq", name: str = "name") -> DataFrame:
    """k-mer to sorted positions (from 0), per sequence."""
    last = F.length(seq) - k
    at = df.filter(last >= 0).select(name, seq, F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    at = at.select(name, F.expr(f"substring({seq}, pos + 1, {k})").alias("kmer"), "pos")
    return at.groupBy(name, "kmer").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


# sequence pairs
def pair_from_json(x: dict) -> dict:
    """Input, output and alignment columns; missing sequences come from the alignment, given ones must agree with it."""
    out = {}
    cols = x.get("alignment")
    if cols is not None and any(len(c) != 2 for c in cols):
        raise ValueError("an alignment column has two cells")
    for k, side in enumerate(("input", "output")):
        s = dict(x.get(side) or {})
        if cols is not None:
            seq = [c[k] for c in cols if c[k]]
            if "sequence" in s and s["sequence"] != seq:
                raise ValueError(f"alignment and {side} sequence differ")
            s["sequence"] = seq
        if "sequence" not in s:
            raise ValueError(f"no {side} sequence")
        out[side] = {"name": s.get("name", ""), "sequence": list(s["sequence"])}
    out["alignment"], out["meta"] = cols, json.dumps(x["meta"]) if "meta" in x else None
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Sequence pairs of JSON files: one pair or a list of them in each; files are read where they lie."""

    def run(batches):
        for b in batches:
            rows = [pair_from_json(p) for text in b.column("value").to_pylist() for x in [json.loads(text)] for p in (x if isinstance(x, list) else [x])]
            yield from pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)).to_batches()

    schema = spark.createDataFrame([], PAIRS).schema
    return spark.read.text(path, wholetext=True).mapInArrow(run, schema)


def cross_pairs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every input with every output (name, sequence each): the one product that pairing means."""
    a = inputs.select(F.struct("name", "sequence").alias("input"))
    b = outputs.select(F.struct("name", "sequence").alias("output"))
    return a.crossJoin(b)


def envelope(alignment, width: int | None = None, lengths: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Half-open input interval of each output position (0 to its length).

    Without an alignment the full one. With ``width`` the path's interval grows
    by that many matches on either side.
    """
    if alignment is None:
        return [(0, lengths[0] + 1)] * (lengths[1] + 1)
    cells, i, o = [(0, 0, 0)], 0, 0
    match = 0
    for a, b in alignment:
        i, o = i + bool(a), o + bool(b)
        match += bool(a and b)
        cells.append((i, o, match))
    width = 0 if width is None else width
    out = []
    for pos in range(o + 1):
        here = [c for c in cells if c[1] == pos]
        lo, hi = min(c[2] for c in here) - width, max(c[2] for c in here) + width
        near = [c[0] for c in cells if lo <= c[2] <= hi]
        out.append((min(near), max(near) + 1))
    return out


def envelopes(df: DataFrame, inp: str, out: str, alignment: str | None = None, width: int | None = None) -> DataFrame:
    """Add ``envelope``, array<struct<lo,hi>> by output position, from array<string> columns and an array<struct<a,b>> alignment (empty strings are gaps)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for b in batches:
            cols = b.column(alignment).to_pylist() if alignment else [None] * b.num_rows
            sizes = [(len(x or ()), len(y or ())) for x, y in zip(b.column(inp).to_pylist(), b.column(out).to_pylist(), strict=True)]
            made = [envelope(None if a is None else [(c["a"], c["b"]) for c in a], width, n) for a, n in zip(cols, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[{"lo": lo, "hi": hi} for lo, hi in e] for e in made], kind)], [*b.schema.names, "envelope"])

    return df.mapInArrow(run, f"{kinds}, envelope array<struct<lo:int,hi:int>>")


# position profiles
def read_profile(spark: SparkSession, path: str) -> tuple[list[str], list[list[float]]]:
    """Header symbols and rows; a data row's further column is the gap."""
    lines = [r[0] for r in spark.read.text(path).collect() if r[0].strip()]
    header = lines[0].split(",")
    return header, [[float(x) for x in line.split(",")] for line in lines[1:]]


def profile_machine(header, rows, kind: str = "generate") -> Machine:
    io = {"generate": lambda c: ("", c), "recognize": lambda c: (c, "")}[kind]
    cols = [*header, ""] if rows and len(rows[0]) > len(header) else list(header)
    return Machine([*[[Edge(k + 1, *(io(c) if c else ("", "")), w) for c, w in zip(cols, r, strict=False) if w] for k, r in enumerate(rows)], []])


def merged_profile(header, rows) -> Machine:
    """Recogniser of a profile whose repeats merge: a symbol after itself is read once; the gap separates."""
    cols = [*header, ""]
    states = {(0, ""): 0}
    for k in range(1, len(rows) + 1):
        for c in cols:
            states[k, c] = len(states)
    edges = [[] for _ in range(len(states) + 1)]
    for (k, last), s in states.items():
        if k == len(rows):
            edges[s].append(Edge(len(states)))
            continue
        for c, w in zip(cols, rows[k], strict=False):
            if w:
                edges[s].append(Edge(states[k + 1, c], "" if c == last else c, "", w))
    return Machine(edges)


# HMMER3
# Background amino-acid frequencies used by the flanks.
BACKGROUND = {
    "A": 0.0825, "C": 0.0138, "D": 0.0546, "E": 0.0673, "F": 0.0386, "G": 0.0708, "H": 0.0227, "I": 0.0592, "K": 0.0581, "L": 0.0965,
    "M": 0.0241, "N": 0.0405, "P": 0.0473, "Q": 0.0393, "R": 0.0553, "S": 0.0663, "T": 0.0535, "V": 0.0686, "W": 0.0109, "Y": 0.0292,
}


def read_hmmer(text: str) -> dict:
    """Alphabet and nodes; node 0 has the begin transitions; numbers are exp(-score), ``*`` is 0."""
    p = lambda x: 0.0 if x == "*" else math.exp(-float(x))
    lines = text.splitlines()
    at = next(k for k, line in enumerate(lines) if re.match(r"HMM\s", line))
    alphabet = lines[at].split()[1:]
    n, at = len(alphabet), at + 2
    if lines[at].split()[0] == "COMPO":
        at += 1
    names = ("mm", "mi", "md", "im", "ii", "dm", "dd")
    nodes = [{"ins": [p(x) for x in lines[at].split()[:n]], **dict(zip(names, map(p, lines[at + 1].split()), strict=False))}]
    at += 2
    while not lines[at].startswith("//"):
        match = lines[at].split()
        nodes.append({"match": [p(x) for x in match[1 : n + 1]], "ins": [p(x) for x in lines[at + 1].split()[:n]], **dict(zip(names, map(p, lines[at + 2].split()), strict=False))})
        at += 3
    return {"alphabet": alphabet, "nodes": nodes}


def hmmer_machine(hmm: dict, mode: str = "local", multihit: bool = False, length: float = 400) -> Machine:
    """mode: local, global, or plan7 (flanks; with ``multihit`` also re-entry)."""
    nodes, alpha = hmm["nodes"], hmm["alphabet"]
    K = len(nodes) - 1
    flank = ["S", "Nx", "N"] if mode == "plan7" else []
    tail = ["Cx", "C", "Jx", "J", "T"] if mode == "plan7" else []
    ids = [*flank, "B", "I0", "Ix0", *[f"{s}{k}" for k in range(1, K + 1) for s in ("M", "Mx", "I", "Ix", "D")], "E", *tail]
    at = {s: k for k, s in enumerate(ids)}
    edges: list[list[Edge]] = [[] for _ in ids]

    def put(a, b, w=1.0, out=""):
        if w:
            edges[at[a]].append(Edge(at[b], "", out, w))

    for k in range(K + 1):
        v, nxt = nodes[k], k + 1
        if k:
            for c, w in zip(alpha, v["match"], strict=True):
                put(f"M{k}", f"Mx{k}", w, c)
            put(f"Mx{k}", f"I{k}", v["mi"])
            if k < K:
                put(f"Mx{k}", f"M{nxt}", v["mm"])
                put(f"Mx{k}", f"D{nxt}", v["md"])
                put(f"D{k}", f"M{nxt}", v["dm"])
                put(f"D{k}", f"D{nxt}", v["dd"])
        for c, w in zip(alpha, v["ins"], strict=True):
            put(f"I{k}", f"Ix{k}", w, c)
        put(f"Ix{k}", f"I{k}", v["ii"])
        put(f"Ix{k}", f"M{nxt}" if k < K else "E", v["im"])
    if mode == "global":
        put("B", "M1", nodes[0]["mm"])
        put("B", "I0", nodes[0]["mi"])
        put("B", "D1", nodes[0]["md"])
        put(f"Mx{K}", "E", nodes[K]["mm"])
        put(f"D{K}", "E", nodes[K]["dm"])
    else:
        occ = [0.0, nodes[0]["mi"] + nodes[0]["mm"]]
        for k in range(2, K + 1):
            occ.append(occ[-1] * (nodes[k]["mm"] + nodes[k]["mi"]) + (1 - occ[-1]) * nodes[k]["dm"])
        z = sum(occ[k] * (K - k + 1) for k in range(1, K + 1))
        for k in range(1, K):
            put("B", f"M{k}", occ[k] / z)
        for k in range(1, K + 1):
            put(f"M{k}", "E")
            put(f"D{k}", "E")
    if mode == "plan7":
        stay, go = length / (length + 1), 1 / (length + 1)
        put("S", "Nx")
        put("Nx", "N", stay)
        put("Nx", "B", go)
        put("E", "Cx", 0.5 if multihit else 1.0)
        put("Cx", "C", stay)
        put("Cx", "T", go)
        if multihit:
            put("E", "Jx", 0.5)
            put("Jx", "J", stay)
            put("Jx", "B", go)
        for s in ("N", "C", "J")[: 3 if multihit else 2]:
            for c in alpha:
                put(s, f"{s}x", BACKGROUND.get(c, 1 / len(alpha)), c)
    return Machine(edges, ids)


# jumping profile of a flush alignment
def jumping_profile(rows: list[str]) -> Machine:
    """Copy one alignment row, jumping to another between columns with parameter ``jump``; gaps are written as they stand."""
    n, cols = len(rows), len(rows[0])
    if any(len(r) != cols for r in rows):
        raise ValueError("the alignment isn't flush")
    end = n * cols + 1
    at = lambda r, c: 1 + c * n + r
    stay = {"not": "jump"} if n > 1 else 1
    move = W.div("jump", n - 1) if n > 1 else 0
    edges = [[Edge(at(r, 0), weight=W.div(1, n)) for r in range(n)]]
    for c in range(cols):
        for r in range(n):
            if c == cols - 1:
                edges.append([Edge(end, "", rows[r][c])])
            else:
                edges.append([Edge(at(q, c + 1), "", rows[r][c], stay if q == r else move) for q in range(n)])
    return Machine([*edges, []], None, {}, {"prob": ["jump"]} if n > 1 else {})


# PAF
def paf_pairs(paf: DataFrame, queries: DataFrame, targets: DataFrame, stride: int = 1, group: int = 0) -> DataFrame:
    """Alignment columns of PAF rows (one text column ``value``) with a cg:Z: CIGAR; names join to (name, seq) tables.

    ``stride``/``group`` keep every stride-th row of a stable numbering by content hash.
    """
    f = F.split("value", "\t")
    p = paf.select(
        f[0].alias("q"), f[2].cast("int").alias("qs"), f[3].cast("int").alias("qe"), f[4].alias("strand"), f[5].alias("t"), f[7].cast("int").alias("ts"),
        F.regexp_extract("value", r"cg:Z:(\S+)", 1).alias("cigar"), F.xxhash64("value").alias("h"),
    )
    p = p.filter((F.pmod("h", F.lit(stride)) == group) & (F.col("cigar") != ""))
    p = p.join(queries.select(F.col("name").alias("q"), F.col("seq").alias("qseq")), "q").join(targets.select(F.col("name").alias("t"), F.col("seq").alias("tseq")), "t")
    part = F.expr("substring(qseq, qs + 1, qe - qs)")
    p = p.withColumn("qpart", F.when(F.col("strand") == "-", F.reverse(F.translate(part, "ACGTacgt", "TGCAtgca"))).otherwise(part))
    runs = F.expr(r"transform(regexp_extract_all(cigar, '(\\d+[MIDNX=])', 1), x -> struct(cast(substring(x, 1, length(x) - 1) as int) as n, substring(x, -1, 1) as op))")
    fold = """aggregate(runs, struct(0 as i, ts as o, cast(array() as array<struct<i:string,o:string>>) as c), (a, r) -> struct(
      a.i + if(r.op in ('D', 'N'), 0, r.n) as i, a.o + if(r.op = 'I', 0, r.n) as o,
      concat(a.c, transform(sequence(0, r.n - 1), k -> struct(if(r.op in ('D', 'N'), '', substring(qpart, a.i + k + 1, 1)) as i, if(r.op = 'I', '', substring(tseq, a.o + k + 1, 1)) as o))) as c), a -> a.c)"""
    return p.withColumn("runs", runs).select(F.col("q").alias("input_name"), F.col("t").alias("output_name"), F.expr(fold).alias("alignment"))


def load_machine_source(kind: str, text: str) -> Machine:
    """Linear machine of a named sequence: kind generate, recognize or echo; ``text`` its JSON."""
    x = json.loads(text)
    return A._chain(x["sequence"], kind, x.get("name"))
