import gzip
import json
import math
import os

import duckdb
import pytest
from machines import SLIP
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weft import algebra_queries  # noqa: F401  registers its queries
from weft import queries as Q
from weft.operators import infer as I
from weft.operators import position as P
from weft.operators.kernels import MAX
from weft.plans.machine import Edge, Machine
from weft.sources import formats as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(Q.SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    want = sorted(repr(tuple(r[at.index(c)] for c in cols)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_prefix_decode_returns_its_input(spark):
    assert Q.prefix_decode(spark, SF).filter("bits <> decoded").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_column_and_kernel_agree_on_silent_machines(spark):
    m = Machine([[Edge(0, "a", "", 0.5), Edge(1, weight=0.3)], [Edge(2, "b", "", 0.4), Edge(0, weight=0.2)], [Edge(2, "a", "", 0.1)]])
    df = spark.createDataFrame([(list(x),) for x in ("ab", "aaab", "abaa", "", "b", "zz")], "x array<string>")
    for ring in (None, MAX):
        opt = {"ring": ring} if ring else {}
        rows = I.score(df, m, "x", **opt).withColumn("c", I.forward_column(m, "x", **opt)).collect()
        for r in rows:
            assert r.c == r.loglike or r.c == pytest.approx(r.loglike)


def test_envelope_confines_cells(spark):
    m = Machine.from_json(SLIP)
    m.edges[0] += [Edge(0, "a", "", 0.1), Edge(0, "", "a", 0.1)]
    df = spark.createDataFrame([(list("aa"), list("aa"))], "x array<string>, y array<string>")
    df = df.withColumn("e", F.expr("array(named_struct('lo', 0, 'hi', 1), named_struct('lo', 1, 'hi', 2), named_struct('lo', 2, 'hi', 3))"))
    v = {"keep": 0.5, "slip": 0.5}
    r = I.score(df, m, "x", "y", v, envelopes="e").first()
    assert r.loglike == pytest.approx(2 * math.log(0.5))
    assert I.score(df, m, "x", "y", v).first().loglike > r.loglike


def test_aligned_rows(spark):
    df = spark.createDataFrame([(list("ab"), list("ab"), [0, 0])], "x array<string>, y array<string>, o array<int>")
    r = P.score_aligned(df, Machine.from_json(SLIP), "x", "y", "o", {"keep": 0.9, "slip": 0.1}).first()
    assert r.loglike == pytest.approx(2 * math.log(0.9))


def test_sequence_files(spark, tmp_path):
    f = tmp_path / "a.fa.gz"
    with gzip.open(f, "wt") as h:
        h.write(">one first seq\nACG\nT\n>two\nGG\n")
    got = [tuple(r) for r in S.read_fasta(spark, str(f)).orderBy("name").collect()]
    assert got == [("one", "first seq", "ACGT", None), ("two", "", "GG", None)]
    (tmp_path / "empty.fa").write_text("")
    assert S.read_fasta(spark, str(tmp_path / "empty.fa")).count() == 0
    (tmp_path / "b.fq").write_text("@r1 c\nAC\n+\nII\n@r2\nG\n+\nI\n")
    q = S.read_fastq(spark, str(tmp_path / "b.fq"))
    assert [tuple(r) for r in q.orderBy("name").collect()] == [("r1", "c", "AC", "II"), ("r2", "", "G", "I")]
    S.write_fasta(S.read_fasta(spark, str(f)), str(tmp_path / "out"), 2)
    back = S.read_fasta(spark, str(tmp_path / "out")).orderBy("name").collect()
    assert [r.seq for r in back] == ["ACGT", "GG"]
    k = S.kmers(S.read_fasta(spark, str(f)), 1).filter("name = 'two'").first()
    assert k.positions == [0, 1]


def test_pair_files(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text(json.dumps([{"input": {"name": "a"}, "output": {"name": "b"}, "alignment": [["0", "1"], ["1", ""]]}]))
    r = S.read_pairs(spark, str(f)).first()
    assert r.input.sequence == ["0", "1"] and r.output.sequence == ["1"]


def test_paf(spark):
    row = "q\t6\t1\t5\t+\tt\t8\t2\t6\t3\t4\t60\tcg:Z:2M1I1D1M"
    paf = spark.createDataFrame([(row,)], "value string")
    q, t = spark.createDataFrame([("q", "AACGTT")], "name string, seq string"), spark.createDataFrame([("t", "CCACTTGG")], "name string, seq string")
    got = [tuple(c) for c in S.paf_pairs(paf, q, t).first().alignment]
    assert got == [("A", "A"), ("C", "C"), ("G", ""), ("", "T"), ("T", "T")]


def test_stream(spark, tmp_path):
    from weft.streaming import forward_stream

    m = Machine([[Edge(0, "a", "", 0.5), Edge(0, "b", "", 0.25)]])
    src, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "k long, t long, s string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k long, t long, s string").option("maxFilesPerTrigger", 1).parquet(src)
    q = forward_stream(stream, m, "k", "s", order="t").writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 2, "a")], "k long, t long, s string").coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    last = {r.k: (r.n, r.loglike) for r in out}
    assert last[1] == (3, pytest.approx(math.log(0.5 * 0.25 * 0.5))) and last[2] == (1, pytest.approx(math.log(0.5)))


def test_letters_decode_like_paths(spark):
    from weft.operators import decode as D
    from weft.operators import kernels as K

    m = Machine([[Edge(0, "a", "x", 0.3), Edge(0, "b", "x", 0.6), Edge(0, "b", "y", 0.4), Edge(0, "a", "z", 0.4), Edge(0, "c", "z", 0.4), Edge(0, "", "w", 0.1)]])
    df = spark.createDataFrame([(list(s),) for s in ("xyz", "", "wzw", "xq")] + [(None,)], "y array<string>")
    c = K.compile_machine(m)
    for r in D.decode(df, m, "y", "viterbi").collect():
        t = c.tokens(r.y or [], "out")
        want = (None, float("-inf")) if t is None else D.viterbi(c, t)
        assert r.decoded == want[0] and r.decoded_ll == pytest.approx(want[1])


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one a>b note\nAC\nGT\n\n>two\nGG\n")
    (tmp_path / "b.fa").write_text("\n>three\nTT")
    got = S.read_fasta(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.comment, r.seq) for r in got) == [("one", "a>b note", "ACGT"), ("three", "", "TT"), ("two", "", "GG")]


def test_pairs_of_several_files(spark, tmp_path):
    one = {"input": {"name": "x", "sequence": ["a"]}, "output": {"name": "y", "sequence": ["b", "c"]}}
    (tmp_path / "1.json").write_text(json.dumps(one))
    (tmp_path / "2.json").write_text(json.dumps([one, one]))
    got = S.read_pairs(spark, str(tmp_path)).collect()
    assert len(got) == 3 and got[0].output.sequence == ["b", "c"]
