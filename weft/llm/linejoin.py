"""Lists of an exact set-similarity join whose keys are as long as their words are frequent.

Words are ordered by rarity. Two similar sets share enough words that their
first common one lies in the prefix of both, the second one in a prefix that is
longer by one, and so on. So a list's key is a line's prefix word where that
word is rare; where it is frequent the key is a pair of words, or three: the
first common words of two similar sets are a key of both. A pair of sets meets
under the same key whatever else is in the corpus, lists stay short however
frequent single words are, and what is shuffled stays in proportion to the
lines.

A list that is long all the same (a cluster of near copies) is recognised from
a hashed sample of the sets and dealt out in blocks. Blocks, lists of more than
``dense`` entries and lines with many likely partners only give their likeliest
pairs at first; a line for which none is confirmed then meets all blocks of its
lists (:func:`open_pairs`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Bloom, durable, longs, lookup_join
from weft.llm.kernels import U, mix
from weft.llm.simjoin import DEN, NUM, _fits, _order, _unlike, prefix_length

#: A list entry: list (key and block), line, set size, place in the prefix, 128-bit signature of the set.
ENTRY = np.dtype([("v", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("s1", "<u8"), ("s2", "<u8")])
#: Kinds of rows that lists give: a later line's likeliest pair, another pair, a line that may have further earlier
#: partners, and a run of packed entries of a list in which that is so.
BEST, OTHER, LATE, REST = 0, 1, 2, 3
NAMES = ["kind", "a_doc", "a_line", "b_doc", "b_line", "apart", "v", "part", "blob"]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
SCHEMA = "kind int, a_doc bigint, a_line int, b_doc bigint, b_line int, apart int, v bigint, part int, blob binary"

#: Entries in one REST row.
RUN = 4096

#: Counts fit a byte: exact to 16, then eight steps a doubling.
COUNT = np.array([float(k) for k in range(17)] + [16 * 2 ** (k / 8) for k in range(1, 240)])


def node(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + line.astype(U))


def node_keys(nodes: DataFrame) -> DataFrame:
    """(doc, line) as one hashed key each."""
    return nodes.select("doc", "line").mapInArrow(
        lambda it: (pa.RecordBatch.from_arrays([longs(node(b.column("doc").to_numpy(), b.column("line").to_numpy()))], ["k"]) for b in it), "k bigint"
    )


def count_class(counts: np.ndarray) -> np.ndarray:
    """Smallest class (index of COUNT) that isn't below each count."""
    return np.minimum(np.searchsorted(COUNT, counts, "left"), 255).astype(np.uint8)


def by_rarity(line: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Order of words by (line, rarity class, place); places ascend by hash within a line, so the order is the corpus's."""
    key = (line.astype(U) << U(40)) | (rare.astype(U) << U(32)) | np.arange(len(line), dtype=U)
    key.sort()
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def signatures(spread: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits a set, each member flips one of the 128: sets differ in at least as many members as bits."""
    n = np.diff(at)
    full = np.flatnonzero(n)  # reduceat needs each start below the next one and below the end
    bit = spread & U(127)
    one = U(1) << (bit & U(63))
    out = []
    for half in (0, 1):
        s = np.zeros(len(n), U)
        if len(full):
            s[full] = np.bitwise_xor.reduceat(np.where((bit >> U(6)) == half, one, U(0)), at[full])
        out.append(s)
    return out[0], out[1]


def _steps(size: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each of the sizes."""
    first = np.concatenate([[0], np.cumsum(size)])
    return np.arange(first[-1]) - np.repeat(first[:-1], size)


def prefix_keys(word: np.ndarray, rare: np.ndarray, at: np.ndarray, use: np.ndarray, limit: float, lines: int):
    """List keys of the sets ``use``: (key, set, place from 1); words of a set lie by rarity from ``at``.

    A key's expected number of lines is its words' counts multiplied up as if
    they were independent; keys grow until that is ``limit`` or they have three
    words. A set needs three members at least.
    """
    size = prefix_length(np.diff(at)[use])
    line, pos = np.repeat(use, size), _steps(size)
    here = at[line] + pos
    count = COUNT[rare[here]]
    one = np.flatnonzero((count > 1) & (count <= limit))
    keys, owner, place = [mix(word[here[one]])], [line[one]], [pos[one]]
    hot = np.flatnonzero(count > limit)
    if len(hot):
        upto = np.repeat(size, size)  # the prefix for two common words ends one later
        m = upto[hot] - pos[hot]
        a = np.repeat(hot, m)
        j = pos[a] + 1 + _steps(m)
        there = at[line[a]] + j
        both = count[a] * COUNT[rare[there]] / max(lines, 1)
        pair = mix(word[here[a]] * U(0x9E3779B97F4A7C15) ^ mix(word[there]))
        two = both <= limit
        keys.append(pair[two]), owner.append(line[a[two]]), place.append(j[two] - 1)
        a, j, pair = a[~two], j[~two], pair[~two]
        m = upto[a] + 1 - j
        b = np.repeat(np.arange(len(a)), m)
        k = j[b] + 1 + _steps(m)
        keys.append(mix(pair[b] * U(0xD6E8FEB86659FD93) ^ mix(word[at[line[a[b]]] + k])))
        owner.append(line[a[b]]), place.append(k - 2)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(place) + 1


def _zip(entries: np.ndarray) -> bytes:
    """Byte planes of the entries, compressed."""
    planes = entries.view(np.uint8).reshape(len(entries), ENTRY.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def packed(entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries dealt to buckets by list: one row a bucket, so millions of entries are some thousand rows to Spark."""
    bucket = (mix(entries["v"]) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(cut[1:], len(order))
    entries = entries[order]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[cut]].astype(np.int32)), pa.array([_zip(entries[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "blob"])


def unpacked(blobs) -> np.ndarray:
    unzip = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(unzip(x.as_buffer()), np.uint8).reshape(ENTRY.itemsize, -1).T for x in blobs]
    return np.ascontiguousarray(np.concatenate(parts)).view(ENTRY).reshape(-1) if parts else np.zeros(0, ENTRY)


def _rows(m: int, **columns) -> pa.RecordBatch:
    """``m`` rows with the given columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, columns[c]) if np.isscalar(columns[c]) else columns[c], t) if c in columns else pa.nulls(m, t) for c, t in zip(NAMES, TYPES, strict=True)], NAMES)


def _named(doc, line, i, j) -> np.ndarray:
    """Numbers of the lines of entries ``i`` and ``j``: one number a (doc, line), 0 for all other entries."""
    met = np.zeros(len(doc), bool)
    met[i] = met[j] = True
    met = np.flatnonzero(met)
    order = met[np.lexsort((line[met], doc[met]))]
    new = np.ones(len(order), np.int64)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
    out = np.zeros(len(doc), np.int64)
    out[order] = np.cumsum(new)
    return out


def _apart(sig, i, j) -> np.ndarray:
    return np.bitwise_count(sig[0][i] ^ sig[0][j]).astype(np.int64) + np.bitwise_count(sig[1][i] ^ sig[1][j])


def _likeliest(sig, i, j, keep: int):
    """Of each later entry's pairs the ``keep`` whose signatures differ least, and the later entries that have more."""
    order = np.lexsort((_apart(sig, i, j), j))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
    size = np.diff(np.r_[start, len(j)])
    ok = np.arange(len(j)) - np.repeat(start, size) < keep
    return i[ok], j[ok], j[start[size > keep]]


class _Lists:
    """Comparisons within lists of entries."""

    def __init__(self, e: np.ndarray):
        self.cols = [np.ascontiguousarray(e[c]) for c in ENTRY.names]
        self.v, self.doc, self.line, self.n, self.pos, *self.sig = self.cols
        # sets that first meet at these places share ``left / (NUM + DEN)`` members at most, and need ``need / (NUM + DEN)``
        self.left, self.need = (NUM + DEN) * (self.n - self.pos + 1), NUM * self.n

    def good(self, i, j):
        """Pairs that pass the filters, earlier line first."""
        ok = np.flatnonzero(np.minimum(self.left[i], self.left[j]) >= self.need[i] + self.need[j])
        return self.alike(i[ok], j[ok])

    def alike(self, i, j):
        ok = np.flatnonzero(~_unlike(i, j, self.n, *self.sig))
        return _order(self.cols, i[ok], j[ok])

    def useful(self, at: np.ndarray) -> np.ndarray:
        """Entries that by their set sizes and places have a partner among ``at``."""
        key, which, times = np.unique(self.n[at].astype(np.int64) << 32 | self.pos[at], return_inverse=True, return_counts=True)
        if len(key) > 1024:
            return at
        one = at[np.unique(which, return_index=True)[1]]
        fits = np.minimum.outer(self.left[one], self.left[one]) >= np.add.outer(self.need[one], self.need[one])
        alone = np.flatnonzero(times == 1)
        fits[alone, alone] = False
        return at[fits.any(axis=1)[which]]

    def all_pairs(self, at: np.ndarray, keep: int):
        """Every pair among ``at`` that passes; where there are over eight an entry only ``keep`` a later entry, and those that have more."""
        n = self.n
        by, held, many, more = at[np.argsort(n[at], kind="stable")], [], 0, [np.zeros(0, np.int64)]
        upto = np.searchsorted(n[by], n[by] * DEN // NUM, "right")
        left, need = self.left[by], self.need[by]
        # the shorter of two similar sets meets the other within a shorter prefix, that of sets of its own size
        rows = np.flatnonzero(left >= 2 * need)
        k, step = len(at), max(64, (1 << 19) // max(len(at), 1))
        for a in range(0, len(rows), step):
            x = rows[a : a + step]
            first, last = int(x[0]), int(upto[x[-1]])  # longer sets can't be similar to any of the rows
            fits = np.minimum(left[x, None], left[None, first:last]) >= need[x, None] + need[None, first:last]
            fits &= np.arange(first, last) > x[:, None]
            i, j = np.nonzero(fits)
            i, j = x[i], first + j
            held.append(self.alike(by[i], by[j]))
            many += len(held[-1][0])
            if many > 8 * k:
                i, j, late = _likeliest(self.sig, *(np.concatenate(c) for c in zip(*held, strict=True)), keep)
                held, many = [(i, j)], 0
                more.append(late)
        return held, np.unique(np.concatenate(more))


def list_pairs(e: np.ndarray, cap: int, dense: int, split: np.ndarray, keep: int = 2):
    """Rows (NAMES) of the lists in ``e``, sorted by list; ``split``: sorted lists that are blocks of a longer one.

    Every pair of a list that passes the length, positional and signature
    filters is given. Exceptions give their likeliest pairs and are told by
    LATE and REST rows: lines of clusters, with over ``keep`` likely partners;
    lists of over ``dense`` entries and blocks, compared within runs of
    ``dense`` lines and with the first lines.
    """
    x = _Lists(e)
    m = len(x.v)
    start = np.flatnonzero(np.r_[True, x.v[1:] != x.v[:-1]])
    size = np.diff(np.r_[start, m])
    block = np.isin(x.v[start], split) if len(split) else np.zeros(len(start), bool)
    short = (size <= cap) & ~block
    place = (np.arange(m) - np.repeat(start, size)).astype(np.int32)
    place[~np.repeat(short, size)] = -1
    found, rest, late = [], [], np.zeros(m, bool)
    alive = np.flatnonzero(place >= 1)
    for d in range(1, int(min(cap, size.max(initial=1)))):
        alive = alive[place[alive] >= d]
        if not len(alive):
            break
        found.append(x.good(alive - d, alive))
    for s, k, part in zip(start[~short], size[~short], block[~short], strict=True):
        every = np.arange(s, s + k)
        at = x.useful(every) if k > 256 else every
        if len(at) <= dense:
            held, more = x.all_pairs(at, keep)
            found += held
        else:
            at = at[np.lexsort((x.line[at], x.doc[at]))]
            run = max(dense, 16)
            more = [at[run:]]
            for a in range(0, len(at), run):
                held, some = x.all_pairs(at[a : a + run], keep)
                found += held
                more.append(some)
            for lead in at[:16]:
                found.append(x.alike(np.full(len(at), lead), at))
            for step in (1, 2):
                found.append(x.alike(at[:-step], at[step:]))
            more = np.concatenate(more)
        if part:
            more = at = every
        if len(more):
            late[more] = True
            rest.append(at)
    if rest:
        for at in rest:
            runs = range(0, len(at), RUN)
            yield _rows(len(runs), kind=REST, v=np.full(len(runs), x.v[at[0]]).view(np.int64), part=np.arange(len(runs)), blob=[_zip(e[at[a : a + RUN]]) for a in runs])
        name = _named(x.doc, x.line, at := np.flatnonzero(late), at)
        at = at[np.unique(name[at], return_index=True)[1]]
        yield _rows(len(at), kind=LATE, a_doc=x.doc[at], a_line=x.line[at])
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    if len(i):
        apart = _apart(x.sig, i, j)
        name = _named(x.doc, x.line, i, j)  # a pair that meets in several lists is given once
        order = np.lexsort((name[i], apart, name[j]))
        i, j, apart = i[order], j[order], apart[order]
        new = np.ones(len(i), bool)
        new[1:] = (name[i[1:]] != name[i[:-1]]) | (name[j[1:]] != name[j[:-1]])
        i, j, apart = i[new], j[new], apart[new]
        kind = np.full(len(i), BEST)
        kind[1:][name[j[1:]] == name[j[:-1]]] = OTHER
        yield _rows(len(i), kind=kind, a_doc=x.doc[i], a_line=x.line[i], b_doc=x.doc[j], b_line=x.line[j], apart=apart)


def pairs(blocks: DataFrame, split: np.ndarray, cap: int, dense: int) -> DataFrame:
    """Durable rows of :func:`list_pairs` of packed entries (bucket int, blob binary)."""
    bound = blocks.sparkSession.sparkContext.broadcast(split)

    def run(key, table):
        e = unpacked(table.column("blob"))
        e = e[np.argsort(e["v"])]
        out = list(list_pairs(e, cap, dense, bound.value))
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in TYPES], NAMES)

    out = durable(blocks.groupBy("bucket").applyInArrow(run, SCHEMA))
    bound.destroy()
    return out


def open_pairs(found: DataFrame, gone: DataFrame, lists: DataFrame | None) -> DataFrame:
    """Likely pairs (a before b) of LATE lines not in ``gone`` with all earlier ones of their lists.

    ``found``: rows of :func:`pairs`; ``lists``: (v, whole) names blocks' whole
    list. A list stays in the runs it was written in; only lines that are still
    open go to every run of their lists.
    """
    spark = found.sparkSession
    names, kinds = ["a_doc", "a_line", "b_doc", "b_line"], [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    pair = "a_doc bigint, a_line int, b_doc bigint, b_line int"
    late = found.filter(F.col("kind") == LATE).select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).distinct()
    late = durable(late.join(gone, ["doc", "line"], "left_anti"))
    n = late.count()
    if not n:
        return spark.createDataFrame([], pair)
    bound = spark.sparkContext.broadcast(Bloom.collect(node_keys(late), "k", n=n).bits)
    rest = found.filter(F.col("kind") == REST).select("v", "part", "blob")

    def entries(batches):
        still = Bloom(bound.value)
        for b in batches:
            for blob in b.column("blob"):
                e = unpacked([blob])
                e = e[still.has(node(e["doc"], e["line"]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c]).view(t)) for c, t in ((c, ENTRY[c].str.replace("u", "i")) for c in ENTRY.names)], list(ENTRY.names))

    left = rest.select("blob").mapInArrow(entries, "v bigint, doc bigint, line int, n int, pos int, s1 bigint, s2 bigint")
    left = durable(lookup_join(left, late, ["doc", "line"], "left_semi"))
    runs = rest.select("v", "part")
    if lists is not None:
        runs, left = (lookup_join(t, lists, ["v"]).withColumn("whole", F.coalesce("whole", "v")) for t in (runs, left))
    else:
        runs, left = runs.withColumn("whole", F.col("v")), left.withColumn("whole", F.col("v"))
    hot = durable(left.select("whole").distinct())
    runs = durable(lookup_join(runs, hot, ["whole"], "left_semi"))
    here = runs.join(left.drop("v"), "whole").drop("whole")
    there = lookup_join(rest, durable(runs.select("v").distinct()), ["v"], "left_semi")
    here, there = here.toDF(*here.columns), there.toDF(*there.columns)

    def meet(x, y):
        out = [[np.zeros(0, np.int64)] for _ in names]
        if x.num_rows and y.num_rows:
            e = unpacked(y.column("blob"))
            cols = [np.concatenate([x.column(c).to_numpy(), e[c].view(ENTRY[c].str.replace("u", "i"))]) for c in ("doc", "line", "n", "pos", "s1", "s2")]
            doc, line, n, pos = cols[:4]
            sig, m = [c.view(U) for c in cols[4:]], x.num_rows
            for at in range(0, m, 128):
                i, j = np.repeat(np.arange(at, min(m, at + 128)), len(e)), np.tile(np.arange(m, m + len(e)), min(m, at + 128) - at)
                ok = np.flatnonzero(((doc[j] < doc[i]) | ((doc[j] == doc[i]) & (line[j] < line[i]))) & _fits(n[i], n[j], pos[i], pos[j], True))
                ok = ok[~_unlike(i[ok], j[ok], n, *sig)]
                for o, c in zip(out, (doc[j[ok]], line[j[ok]], doc[i[ok]], line[i[ok]]), strict=True):
                    o.append(c)
        return pa.table([pa.array(np.concatenate(o)).cast(t) for o, t in zip(out, kinds, strict=True)], names)

    met = durable(here.groupBy("v", "part").cogroup(there.groupBy("v", "part")).applyInArrow(meet, pair))
    bound.destroy()
    return durable(met.distinct())
