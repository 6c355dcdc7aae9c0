import itertools
import re

import corpus_pipeline as pipeline
import duckdb
import pytest

from weft.llm import common
from weft.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.durable(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = c.execute(SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    assert sorted(repr(tuple(r[k] for k in cols)) for r in df.collect()) == sorted(repr(tuple(r[at.index(k)] for k in cols)) for r in cur.fetchall())


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_awkward_rows(spark, documents, name, stage):
    """Nulls, empties, ties, repeated rows, long texts, clashing columns and empty tables in every stage."""
    docs = common.durable(documents.unionByName(documents.limit(1).selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "lang", "source", "n_chars", "size", "bucket", "level")))
    out = common.durable(stage(spark, docs, SF))
    if name != "pack_sequences":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert stage(spark, docs.filter("false"), SF).count() == 0
    rows, got = docs.collect(), out.collect()
    if name == "quality_rules":
        assert {r.doc_id for r in got} <= {r.doc_id for r in rows} and not {200, 201, 202, 203} & {r.doc_id for r in got}
    elif name == "line_dedup":
        text = {}
        for r in got:
            text.setdefault(r.doc_id, []).append(r.text)
        assert None in text[200] and text[201] == [""] and text[205] == [r.text for r in rows if r.doc_id == 205]
        assert all(r.text is None or r.n_chars == len(r.text) for r in got)
        seen = [frozenset(WORD.findall(lower(x))) for r in got if r.text for x in r.text.split("\n") if WORD.search(x)]
        assert len(seen) == len(set(seen))  # no two lines of one word set are left
    elif name == "near_dedup":
        sets = [shingles(r.text) for r in got]
        assert not any(4 * len(a & b) >= 3 * len(a | b) and a for a, b in itertools.combinations(sets, 2))
        everything = [shingles(r.text) for r in rows]
        assert all(not s or any(len(s & k) for k in sets) for s in everything) and sum(not s for s in sets) == sum(not s for s in everything)
    elif name == "mix_sources":
        assert {r.doc_id for r in got} <= {r.doc_id for r in rows} and not {200, 201, 202} & {r.doc_id for r in got}
    else:
        per = {}
        for r in got:
            per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
        assert max(per.values()) <= 1024
        ends = sorted(str(r.doc_id) for r in got if r.start + r.length == r.doc_tokens)
        assert ends == sorted(str(r.doc_id) for r in rows)


def test_near_dedup_keeps_the_first_row_of_each_group(spark, documents):
    got = pipeline.near_dedup(spark, documents, SF).collect()
    ids = sorted(r.doc_id for r in got)
    assert len(ids) == len(set(ids)) and set(range(30)) <= set(ids) and not set(range(100, 105)) & set(ids)
