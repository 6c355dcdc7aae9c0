"""Exact set-similarity self-join on inverted lists, without all pairs of a hot list.

Nodes are (doc, line). An entry says that a node of ``n`` distinct values has
value ``v`` at place ``pos`` of its prefix. Lists of up to ``cap`` entries give
all their pairs that pass the length and positional filters. A longer list
first gives pairs with leaders only (the first node, and one for each further
length band); what those leave open is done exactly afterwards: long lists that
share nodes are one hot group, and its open nodes meet all its nodes in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import durable, lookup_join

PAIR = "a_doc bigint, a_line int, b_doc bigint, b_line int"
#: Similarity threshold as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 3, 4


def least_overlap(na, nb):
    """Smallest intersection of sets of these sizes that reaches the threshold."""
    return -(-NUM * (na + nb) // (NUM + DEN))


def prefix_length(n):
    """Values of which one at least is shared with every similar set."""
    return n - -(-NUM * n // DEN) + 1


def lists(entries: DataFrame) -> DataFrame:
    """Entries (v, doc, line, n, pos) dealt by value and sorted by value (one long: a radix sort); kernels order lists by node."""
    return entries.repartition("v").sortWithinPartitions("v")


def _runs(batches, columns, rows: int = 100_000):
    """Batches joined and re-cut so that no list is split: tuples of numpy columns."""
    held, n = [], 0

    def cut(cols):
        order = np.lexsort((cols[2], cols[1], cols[0]))
        return [c[order] for c in cols]

    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            n += b.num_rows
        if n < rows:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        held, n = [[c[last:] for c in cols]], len(cols[0]) - last
        if last:
            yield cut([c[:last] for c in cols])
        else:
            rows = max(rows, 2 * n)  # a list longer than that: gather more before looking again
    if n:
        yield cut([np.concatenate(c) for c in zip(*held, strict=True)])


def _unlike(i, j, n, s1, s2):
    """Whether two sets' 128-bit word signatures differ in more bits than similar sets can have different values."""
    apart = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
    return apart > (DEN - NUM) * (n[i].astype(np.int64) + n[j]) // (DEN + NUM)


def _fits(na, nb, pa_, pb, positional):
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    ok = DEN * lo >= NUM * hi
    if positional:
        ok &= 1 + np.minimum(na - pa_, nb - pb) >= least_overlap(na, nb)
    return ok


def _order(cols, i, j):
    """Each pair with the earlier node first; pairs of a node with itself (repeated rows) left out."""
    doc, line = cols[1], cols[2]
    back = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
    i, j = np.where(back, j, i), np.where(back, i, j)
    two = (doc[i] != doc[j]) | (line[i] != line[j])
    return i[two], j[two]


def _emit(cols, i, j):
    none = np.zeros(len(i), np.int32)
    out = [none + PAIRED, cols[1][i], cols[2][i].astype(np.int32), cols[1][j], cols[2][j].astype(np.int32), none]
    if len(i) > 1:  # one copy of a pair per call is enough
        order = np.lexsort(out[::-1])
        out = [o[order] for o in out]
        new = np.ones(len(i), bool)
        new[1:] = np.logical_or.reduce([o[1:] != o[:-1] for o in out])
        out = [o[new] for o in out]
    return pa.RecordBatch.from_arrays([pa.array(o) for o in out], FIRST_NAMES)


FIRST_NAMES = ["kind", "a_doc", "a_line", "b_doc", "b_line", "pos"]
FIRST = f"kind int, {PAIR}, pos int"
#: Kinds of rows: a pair, an entry of a long list.
PAIRED, ENTRY = 0, 1


def list_pairs(cols, cap: int):
    """Pairs and long-list entries of sorted list columns (v, doc, line, n, pos)."""
    v, _, _, n, pos = cols

    def good(i, j):
        ok = _fits(n[i], n[j], pos[i], pos[j], False)
        return i[ok], j[ok]

    m = len(v)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[start, m])
    place = (np.arange(m) - np.repeat(start, size)).astype(np.int32)
    place[np.repeat(size, size) > cap] = -1
    found = []
    alive = np.flatnonzero(place >= 1)
    for d in range(1, int(min(cap, size.max(initial=1)))):
        alive = alive[place[alive] >= d]
        if not len(alive):
            break
        found.append(good(alive - d, alive))
    for s, k in zip(start[size > cap], size[size > cap], strict=True):
        j = s + np.lexsort((cols[2][s : s + k], cols[1][s : s + k]))
        band = np.floor(np.log(n[j]) / np.log(DEN / NUM) * 2).astype(np.int64)
        for b in np.unique(band):
            for near in (b - 1, b):  # a leader of the band, and of the next shorter one
                at = np.flatnonzero(band == near)
                if len(at):
                    o = j[band == b]
                    found.append(good(o, np.full(len(o), j[at[0]])))
        # neighbours in order of node: copies made one after another
        found.append(good(j[:-1], j[1:]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (np.full(k, ENTRY, np.int32), cols[1][j], cols[2][j].astype(np.int32), v[j].view(np.int64), n[j].astype(np.int32), pos[j].astype(np.int32))], FIRST_NAMES
        )
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    i, j = _order(cols, i, j)
    if len(i):
        yield _emit(cols, i, j)


def first_pairs(listed: DataFrame, cap: int = 32) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a before b): all of short lists, leader pairs of long ones; and the entries of long lists.

    One pass over the lists writes both results, so the entries are dealt out once.
    """

    def run(batches):
        for cols in _runs(batches, ["v", "doc", "line", "n", "pos"]):
            yield from list_pairs(cols, cap)

    out = durable(listed.mapInArrow(run, FIRST))
    return durable(out.filter(F.col("kind") == PAIRED).select("a_doc", "a_line", "b_doc", "b_line").distinct()), long_entries(out)


def long_entries(out: DataFrame) -> DataFrame:
    return out.filter(F.col("kind") == ENTRY).select(F.col("b_doc").alias("v"), F.col("a_doc").alias("doc"), F.col("a_line").alias("line"), F.col("b_line").alias("n"), "pos")


def hot_groups(entries: DataFrame) -> DataFrame:
    """Nodes of long lists that hold several groups: (doc, line, n, g, hot, size, main), durable.

    ``entries``: (v, id, doc, line, n, g). Lists that share nodes are one hot
    group; ``size`` counts its nodes and ``main`` is its most frequent g.
    """
    mixed = entries.groupBy("v").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("id").alias("u")).filter("lo <> hi").select("v", "u")
    # entries stay where they lie unless there are many such lists: a hot value isn't brought to one task
    met = durable(lookup_join(entries, durable(mixed), ["v"], "inner"))
    hot = components(met.select("u", F.col("id").alias("v"))).toDF("id", "hot")
    nodes = met.select("id", "doc", "line", "n", "g").distinct().join(hot, "id", "left").withColumn("hot", F.coalesce("hot", "id"))
    nodes = durable(nodes.drop("id"))
    sizes = nodes.groupBy("hot", "g").count().groupBy("hot").agg(F.sum("count").alias("size"), F.max_by("g", F.struct("count", "g")).alias("main"))
    return durable(nodes.join(sizes, "hot"))


def finish(nodes: DataFrame, sets: DataFrame, earlier: bool, block: int = 512) -> DataFrame:
    """Links that hot groups still hide: nodes outside a group's main g against all its nodes, on full sets.

    A group is dealt out in blocks of about ``block`` nodes; the nodes outside
    the main g go to every block, so the work spreads however large the group.
    One link is given for each node and other g; with ``earlier`` only links
    from an earlier node (doc, line) to a later one.
    """
    cols = ["doc", "line", "g", "s"]
    full = durable(nodes.join(sets, ["doc", "line"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    there = full.select("hot", F.pmod(F.xxhash64("doc", "line"), F.col("blocks")).cast("int").alias("block"), *cols)
    here = full.filter("g <> main").select("hot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *cols)

    def meet(x, y):
        out = [[], [], [], []]
        if x.num_rows and y.num_rows:
            doc, line, g = (y.column(c).to_numpy() for c in ("doc", "line", "g"))
            each = [np.frombuffer(v.as_buffer(), np.uint64) for v in y.column("s")]
            size = np.array([len(e) for e in each])
            first = np.concatenate([[0], np.cumsum(size)])
            names, codes = np.unique(np.concatenate(each), return_inverse=True)
            for d, k, h, s in zip(*(x.column(c).to_numpy() for c in ("doc", "line", "g")), x.column("s"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                at = np.searchsorted(names, s)
                at[at == len(names)] = 0
                mask = np.zeros(len(names), np.int64)
                mask[at[names[at] == s]] = 1
                shared = np.add.reduceat(mask[codes], first[:-1])
                ok = (g != h) & (DEN * shared >= NUM * (size + len(s) - shared))
                if earlier:
                    ok &= (doc < d) | ((doc == d) & (line < k))
                hit = np.flatnonzero(ok)
                if len(hit):
                    hit = hit[:1] if earlier else hit[np.unique(g[hit], return_index=True)[1]]
                    for o, v in zip(out, (doc[hit], line[hit], np.full(len(hit), d), np.full(len(hit), k)), strict=True):
                        o.append(v)
        flat = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.table([pa.array(f.astype(np.int64)).cast(t) for f, t in zip(flat, kinds, strict=True)], ["a_doc", "a_line", "b_doc", "b_line"])

    return durable(here.groupBy("hot", "block").cogroup(there.groupBy("hot", "block")).applyInArrow(meet, PAIR))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Longs of a binary column, and where each row's begin."""
    size = np.array([len(v.as_buffer()) for v in column], np.int64) // 8
    data = np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint64) if len(size) else np.zeros(0, np.uint64)
    return data, np.concatenate([[0], np.cumsum(size)])


def _spans(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    size = first[rows + 1] - first[rows]
    at = np.concatenate([[0], np.cumsum(size)])
    return np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(first[rows], size)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with their exact intersection, of those that reach the threshold; ``sets``: (doc, line, s), s sorted longs as binary."""
    a, b = sets.toDF("a_doc", "a_line", "a_s"), sets.toDF("b_doc", "b_line", "b_s")
    # one plan at every size: both sides grow with the corpus
    both = pairs.join(a.hint("merge"), ["a_doc", "a_line"]).join(b.hint("merge"), ["b_doc", "b_line"])

    def run(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            (x, xs), (y, ys) = (_flat(t.column(c)) for c in ("a_s", "b_s"))
            nx, ny = np.diff(xs), np.diff(ys)
            fit = np.flatnonzero(DEN * np.minimum(nx, ny) >= NUM * np.maximum(nx, ny))
            for at in range(0, len(fit), 512):
                some = fit[at : at + 512]
                pair = np.concatenate([np.repeat(some, nx[some]), np.repeat(some, ny[some])])
                value = np.concatenate([x[_spans(xs, some)], y[_spans(ys, some)]])
                order = np.lexsort((value, pair))
                pair, value = pair[order], value[order]
                twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][twice], minlength=t.num_rows)[some]
                keep[some] = DEN * shared >= NUM * (nx[some] + ny[some] - shared)
            yield pa.RecordBatch.from_arrays([t.column(c) for c in names], names).filter(pa.array(keep))

    names = ["a_doc", "a_line", "b_doc", "b_line"]
    return both.mapInArrow(run, PAIR)


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node each reaches: hooking and pointer jumping."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return names, names[root]
        hi, lo = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def _contract(edges: DataFrame) -> DataFrame:
    """A task's edges as stars of its own components: the same reachability in at most one edge a node."""

    def run(batches):
        got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if got:
            node, comp = _roots(*(np.concatenate(x) for x in zip(*got, strict=True)))
            keep = node != comp
            yield pa.RecordBatch.from_arrays([pa.array(comp[keep]), pa.array(node[keep])], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = 1_000_000) -> DataFrame:
    """(node, comp): the smallest node reachable; ``edges``: (u, v) longs.

    Tasks first contract their own edges. If at most ``one_task`` edges are
    left (counted, 16 MB), one task finishes; more go through alternating
    large-star and small-star steps, each a shuffle by node.
    """
    e = durable(_contract(edges.filter("u <> v")))
    n = e.count()
    if n <= one_task:
        return durable(_contract(e.coalesce(1)).select(F.col("v").alias("node"), F.col("u").alias("comp")))
    e = durable(e.distinct())
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, hang on the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = joined.select(F.col("m").alias("u"), F.col("v")).unionByName(joined.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
        new = durable(small)
        sums = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        done = sums(new) == sums(e)
        e = new
        if done:
            return e.select(F.col("v").alias("node"), F.col("u").alias("comp"))
    raise RuntimeError("components did not settle")
