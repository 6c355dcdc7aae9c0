"""Near-duplicate documents: bottom-k sketches, inverted lists, exact verification.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; fewer
words: the whole sequence). One hash function gives each set the sketch of its
k smallest values. Equal sets are one class. Inverted lists of retained values
generate class pairs: a class enters only the lists of its rarest retained
values, enough of them that any pair sharing ``need`` values meets (sets of at
most k values are their own sketch, so this is exact; for larger ones a pair at
the threshold shares 3k/4 on average, and fewer than k/2 with a chance of about
1e-6). The Jaccard estimate from the union's sketch filters pairs, full sets
confirm them, and connected components give each document its group.

Defined cases: null or empty text has no shingles and is linked with nothing;
rows that repeat a doc_id are one node; a null doc_id joins the class of its
text, or is its own group (component_id null, kept) when no document with an
id shares it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Bloom, durable, hashed_counts, longs, release, slices, strings
from weft.llm.kernels import U, Words, distinct, mix, set_digest, windows
from weft.llm.simjoin import DEN, NUM, components, finish, first_pairs, hot_groups, lists, verify

K = 64


def _sets(data, offsets, k):
    """Distinct shingle hashes of each text, ascending, and where each text's begin (then the end)."""
    w = Words(data, offsets, lower=True)
    s, d = distinct(*windows(w, k))
    return s, np.searchsorted(d, np.arange(len(offsets)))


def sketches(docs: DataFrame, shingle: int = 5, k: int = K) -> DataFrame:
    """Durable doc_id, n_shingles, set digest (d1, d2) and bottom-k sketch of every document."""

    def run(batches):
        for b in batches:
            data, offsets = strings(b.column("text"))
            for i, j in slices(offsets):
                s, at = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1], shingle)
                d1, d2 = set_digest(s, at)
                n = np.diff(at)
                keep = np.minimum(n, k)
                first = np.concatenate([[0], np.cumsum(keep)])
                take = np.repeat(at[:-1] - first[:-1], keep) + np.arange(first[-1])
                sk = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), longs(s[take]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(n), longs(d1), longs(d2), sk], ["doc_id", "n_shingles", "d1", "d2", "sketch"]
                )

    return durable(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch array<bigint>"))


def _flat(b):
    col = b.column("sketch")
    first = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False).view(U)[first[0] : first[-1]], first - first[0]


def list_entries(classes: DataFrame, k: int = K, log2: int = 20) -> DataFrame:
    """Inverted-list entries of each class's rarest retained values."""

    def values(batches):
        for b in batches:
            yield mix(_flat(b)[0])

    counts = hashed_counts(classes.select("sketch"), values, log2)
    bound = classes.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = bound.value
        for b in batches:
            v, first = _flat(b)
            size = np.diff(first)
            n = b.column("n_shingles").to_numpy()
            need = np.minimum(k // 2, -(-NUM * n // DEN))
            group = np.repeat(np.arange(len(size)), size)
            rarity = counts[(mix(v) >> U(64 - log2)).astype(np.int64)]
            order = np.lexsort((v, rarity, group))
            place = np.arange(len(v)) - np.repeat(first[:-1], size)
            keep = place < np.repeat(size - need + 1, size)
            keep &= rarity[order] > 1
            g = group[keep]
            yield pa.RecordBatch.from_arrays(
                [longs(v[order][keep]), b.column("doc").take(pa.array(g)), pa.array(np.zeros(len(g), np.int32)), pa.array(n[g].astype(np.int32)), pa.array(np.zeros(len(g), np.int32))],
                ["v", "doc", "line", "n", "pos"],
            )

    return durable(classes.select("doc", "n_shingles", "sketch").mapInArrow(run, "v bigint, doc bigint, line int, n int, pos int"))


def sketch_filter(pairs: DataFrame, classes: DataFrame, k: int = K, margin: float = 0.3) -> DataFrame:
    """Pairs whose union sketch estimates a Jaccard of at least the threshold less ``margin`` (5.5 standard errors at k = 64)."""
    s = classes.select("doc", "sketch")
    both = pairs.join(s.toDF("a_doc", "a_k"), "a_doc").join(s.toDF("b_doc", "b_k"), "b_doc")

    def run(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column("a_k"), t.column("b_k"), strict=True)):
                x, y = x.values.to_numpy(zero_copy_only=False).view(U), y.values.to_numpy(zero_copy_only=False).view(U)
                u = np.concatenate([x, y])
                u.sort()
                same = np.zeros(len(u), bool)
                same[:-1] = u[1:] == u[:-1]
                second = np.zeros(len(u), bool)
                second[1:] = same[:-1]
                low = same[~second][:k]  # the union's k smallest: whether both have the value
                keep[i] = len(low) > 0 and low.sum() >= (NUM / DEN - margin) * len(low)
            yield pa.RecordBatch.from_arrays([t.column(c) for c in names], names).filter(pa.array(keep))

    names = ["a_doc", "a_line", "b_doc", "b_line"]
    return both.mapInArrow(run, "a_doc bigint, a_line int, b_doc bigint, b_line int")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc, line, s) of the wanted documents only: a bounded Bloom filter spares the others the work."""
    bloom = Bloom.collect(wanted, "doc")
    bound = docs.sparkSession.sparkContext.broadcast(bloom.bits)

    def run(batches):
        bloom = Bloom(bound.value)
        for b in batches:
            b = b.filter(pa.array(bloom.has(b.column("doc_id").fill_null(0).to_numpy())))
            if not b.num_rows:
                continue
            data, offsets = strings(b.column("text"))
            for i, j in slices(offsets):
                s, at = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1], shingle)
                off = pa.array((at * 8).astype(np.int32)).buffers()[1]
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, off, pa.py_buffer(s.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.zeros(j - i, np.int32)), blob], ["doc", "line", "s"])

    ids = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = ids.mapInArrow(run, "doc bigint, line int, s binary")
    return durable(found.join(wanted.select("doc").distinct(), "doc", "left_semi"))


def near_duplicates(docs: DataFrame, shingle: int = 5, k: int = K, cap: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document (rows as in ``docs``)."""
    measured = sketches(docs, shingle, k)
    classes = measured.filter("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = durable(classes)
    nodes = classes.filter("doc is not null")
    listed = list_entries(nodes, k)
    rows, listed = listed, lists(listed)
    # documents of one id with several texts are one node
    edges = durable(classes.join(measured.select("d1", "d2", "doc_id").filter("doc_id is not null"), ["d1", "d2"]).filter("doc <> doc_id").select(F.col("doc").alias("u"), F.col("doc_id").alias("v")).distinct()) if _repeats(measured) else None

    def confirm(pairs):
        pairs = durable(sketch_filter(pairs, nodes, k))
        wanted = durable(pairs.select(F.col("a_doc").alias("doc")).unionByName(pairs.select(F.col("b_doc").alias("doc"))).distinct())
        sets = full_sets(docs, wanted, shingle)
        out = durable(verify(pairs, sets).select(F.col("a_doc").alias("u"), F.col("b_doc").alias("v")).distinct())
        release(docs.sparkSession, [pairs, wanted, sets])
        return out

    pairs, entries = first_pairs(listed, cap)
    links = confirm(pairs)
    if edges is not None:
        links = durable(links.unionByName(edges))
    comp = components(links)
    # hot groups that still hold several components are finished exactly
    open_ = entries.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("g", F.coalesce("comp", "doc")).drop("comp")
    hot = hot_groups(open_.withColumn("id", F.col("doc")))
    if not hot.isEmpty():
        more = finish(hot, full_sets(docs, hot, shingle), False).select(F.col("a_doc").alias("u"), F.col("b_doc").alias("v"))
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    release(docs.sparkSession, [rows, pairs, entries])
    of_class = durable(classes.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("d1", "d2", F.coalesce("comp", "doc").alias("component")))
    out = measured.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", linked)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeats(measured: DataFrame) -> bool:
    """Whether any doc_id stands for several texts."""
    return bool(measured.filter("doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).filter("a <> b").limit(1).count())
