"""Corpus-wide line dedup: an exact set-similarity join on lines.

A line's set holds its distinct words (A-Z lower-cased). Words are ordered by
rarity over the whole corpus (hashed counts in classes; any total order is
right, a rare-first one is fast). A line enters the inverted lists of its
prefix, under one rare word or two or three frequent ones (see ``linejoin``);
length, positional and signature filters thin the pairs; full sets verify
Jaccard >= 0.75. A line goes if an earlier line, by (doc_id, line number), is
similar to it; earlier means any earlier line, kept or not.

Every line with a word takes part. A set of one or two words is similar to the
equal set only, which grouping by digest finds, so it has no list entries.
Callers can exempt lines of fewer than ``min_words`` distinct words.

Defined cases: null or empty text has no lines to compare; blank lines stay;
where doc_ids are null, repeated or no integers every row is a document of its
own, in order of doc_id (nulls last) and a hash of the text, so a repeated row loses all its
lines with a word; an empty table gives no rows; extra columns are carried
along or ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Bloom, durable, longs, lookup_join, numbered, release, slices, strings, text_bytes
from weft.llm.kernels import U, Words, distinct, mix, set_digest
from weft.llm.linejoin import BEST, ENTRY, OTHER, by_rarity, count_class, node, node_keys, open_pairs, packed, pairs, prefix_keys, signatures
from weft.llm.simjoin import verify

#: What the first scan gives: digests, lines known to go, word counts, a sample of the sets.
DIGEST, GONE, WORDS, SAMPLE = 0, 1, 2, 3
LINE = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("doc", "<i8"), ("line", "<i4")])
#: One set of this many, by digest, tells which lists will be long.
SAMPLED = 64
PAGE = 1 << 16


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, first byte and end (with its newline) of each line; a text has one line more than newlines."""
    offsets = offsets - offsets[0]
    feed = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(feed, offsets)) + 1
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(doc)) - np.repeat(first, n)
    start = np.empty(len(doc), np.int64)
    start[first] = offsets[:-1]
    start[number > 0] = feed + 1
    return doc, number, start, np.append(start[1:], len(data))[: len(start)]


class Lines:
    """Lines of some texts with their distinct word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.doc, self.number, self.start, self.end = split_lines(data, offsets)
        w = Words(data, offsets, lower=True)
        first = np.append(np.searchsorted(w.start, self.start), len(w.start))
        self.word, self.line = distinct(w.hash, np.repeat(np.arange(len(self.doc)), np.diff(first)))
        self.at = np.searchsorted(self.line, np.arange(len(self.doc) + 1))


def _firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines (LINE) in order of digest and place, and which of them are the first of their set."""
    x = x[np.lexsort((x["line"], x["doc"], x["d2"], x["d1"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1])
    return x, new


def _blocks(kind: int, bucket: np.ndarray, rows: np.ndarray):
    """(kind, bucket, blob) with the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(cut[1:], len(order))
    rows = rows[order]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cut), kind, np.int32)), pa.array(bucket[order[cut]].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
        ["kind", "bucket", "blob"],
    )


def _count_blob(at: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(at, prepend=0).astype("<u2")
    return zlib.compress(len(at).to_bytes(4, "little") + gaps.tobytes() + counts.astype("<u4").tobytes(), 1)


def _add_counts(blobs) -> np.ndarray:
    acc = np.zeros(PAGE, np.int64)
    for x in blobs:
        raw = zlib.decompress(x.as_buffer())
        m = int.from_bytes(raw[:4], "little")
        at = np.cumsum(np.frombuffer(raw, "<u2", m, 4).astype(np.int64))
        acc[at] += np.frombuffer(raw, "<u4", m, 4 + 2 * m)
    return acc


def first_scan(docs: DataFrame, min_words: int, log2: int, buckets: int, hold: int = 200_000) -> DataFrame:
    """Durable (kind, bucket, blob) of the lines of (doc_id, text): digests dealt by bucket, later copies within a task, word counts, sampled sets.

    A task adds up its words and its equal sets before anything is shuffled.
    """

    def digests(held):
        x, new = _firsts(np.concatenate(held))
        if not new.all():
            late = x[~new]
            yield _blocks(GONE, np.zeros(len(late), np.int64), late)
        x = x[new]
        yield _blocks(DIGEST, ((x["d1"] >> U(32)) % U(buckets)).astype(np.int64), x)

    def words(sums):
        at, n = np.concatenate([k for k, _ in sums]), np.concatenate([c for _, c in sums])
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        return [(at[cut], np.add.reduceat(n, cut))] if len(cut) else []

    def run(batches):
        held, m, sums, k = [], 0, [], 0
        for b in batches:
            data, offsets = strings(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in slices(offsets):
                x = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                at, c = np.unique(mix(x.word) >> U(64 - log2), return_counts=True)
                sums.append((at.astype(np.int64), c))
                k += len(at)
                if k > 1_000_000:
                    sums = words(sums)
                    k = sum(len(a) for a, _ in sums)
                n = np.diff(x.at)
                d1, d2 = set_digest(x.word, x.at)
                use = np.flatnonzero(n >= min_words)
                rows = np.empty(len(use), LINE)
                rows["d1"], rows["d2"], rows["doc"], rows["line"] = d1[use], d2[use], ids[i + x.doc[use]], x.number[use]
                held.append(rows)
                m += len(rows)
                some = use[(n[use] > 2) & (d1[use] % U(SAMPLED) == 0)]
                if len(some):
                    size = n[some].astype("<u4")
                    first = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
                    w = x.word[np.repeat(x.at[some] - first[:-1], size) + np.arange(first[-1])]
                    blob = len(some).to_bytes(4, "little") + size.tobytes() + d1[some].tobytes() + w.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([SAMPLE], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], ["kind", "bucket", "blob"])
                if m >= hold:
                    yield from digests(held)
                    held, m = [], 0
        if m:
            yield from digests(held)
        for at, c in words(sums) if sums else []:
            page = at // PAGE
            cut = np.flatnonzero(np.diff(page, prepend=-1))
            ends = np.append(cut[1:], len(at))
            blobs = [_count_blob(at[a:z] % PAGE, c[a:z]) for a, z in zip(cut, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), WORDS, np.int32)), pa.array(page[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])

    return durable(docs.mapInArrow(run, "kind int, bucket int, blob binary"))


def word_classes(told: DataFrame, log2: int) -> np.ndarray:
    """Each counter's class of frequency, one byte: added up by page, then one bounded table comes to the driver."""

    def add(key, table):
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([zlib.compress(count_class(_add_counts(table.column("blob"))).tobytes(), 1)], pa.binary())})

    out = np.zeros(max(PAGE, 1 << log2), np.uint8)
    for r in told.filter(F.col("kind") == WORDS).select(F.col("bucket").alias("page"), "blob").groupBy("page").applyInArrow(add, "page int, c binary").toLocalIterator():
        out[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(zlib.decompress(bytes(r["c"])), np.uint8)
    return out[: 1 << log2]


def line_classes(told: DataFrame) -> DataFrame:
    """Durable (first, several, d1, doc, line): the first line of each set, and all later ones met on the way."""
    names = ["first", "several", "d1", "doc", "line"]

    def table(x, first, several):
        return pa.table([pa.array(first), pa.array(several), longs(x["d1"]), pa.array(np.ascontiguousarray(x["doc"])), pa.array(np.ascontiguousarray(x["line"]))], names)

    def group(key, t):
        x, new = _firsts(np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in t.column("blob")), LINE))
        last = np.append(new[1:], True)
        return table(x, new, ~(new & last))

    def late(batches):
        for b in batches:
            for v in b.column("blob"):
                x = np.frombuffer(v.as_buffer(), LINE)
                yield from table(x, np.zeros(len(x), bool), np.ones(len(x), bool)).to_batches()

    schema = "first boolean, several boolean, d1 bigint, doc bigint, line int"
    across = told.filter(F.col("kind") == DIGEST).select("bucket", "blob").groupBy("bucket").applyInArrow(group, schema)
    return durable(across.unionByName(told.filter(F.col("kind") == GONE).select("blob").mapInArrow(late, schema)))


def long_lists(told: DataFrame, classes, log2: int, limit: float, lines: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists that the sample says have over ``block`` entries, sorted, and in how many blocks each is dealt out.

    At most one key for ``block / SAMPLED`` entries of the sample: a bounded share of a bounded share.
    """

    def run(batches):
        for b in batches:
            for v in b.column("blob"):
                raw = v.as_py()
                m = int.from_bytes(raw[:4], "little")
                size, d1 = np.frombuffer(raw, "<u4", m, 4).astype(np.int64), np.frombuffer(raw, "<u8", m, 4 + 4 * m)
                word = np.frombuffer(raw, "<u8", -1, 4 + 12 * m)
                at = np.concatenate([[0], np.cumsum(size)])
                line = np.repeat(np.arange(m), size)
                rare = classes.value[(mix(word) >> U(64 - log2)).astype(np.int64)]
                order = by_rarity(line, rare)
                key, owner, _ = prefix_keys(word[order], rare[order], at, np.arange(m), limit, lines)
                yield pa.RecordBatch.from_arrays([longs(key), longs(d1[owner])], ["v", "d1"])

    keys = told.filter(F.col("kind") == SAMPLE).select("blob").mapInArrow(run, "v bigint, d1 bigint").distinct()
    rows = keys.groupBy("v").count().filter(F.col("count") > block // SAMPLED).toArrow()
    v = rows.column("v").to_numpy().view(U)
    order = np.argsort(v)
    return v[order], -(-rows.column("count").to_numpy()[order] * SAMPLED // block)


def line_entries(docs: DataFrame, classes, several, firsts, heavy, min_words: int, log2: int, limit: float, lines: int, buckets: int) -> DataFrame:
    """Packed list entries of the prefix of each distinct line, with a 128-bit signature of its words.

    ``several`` and ``firsts`` are Bloom filters of the sets that occur on
    several lines and of the first line of every set that ``several`` says yes
    to, rightly or not: only later copies are left out (a false yes of
    ``firsts`` lets one in, which costs time only).
    """

    def run(batches):
        rare_of, some, first_of, (long_keys, blocks) = classes.value, Bloom(several.value), Bloom(firsts.value), heavy.value
        for b in batches:
            data, offsets = strings(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in slices(offsets):
                x = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                n = np.diff(x.at)
                d1, _ = set_digest(x.word, x.at)
                doc = ids[i + x.doc]
                use = np.flatnonzero(n >= max(min_words, 3))  # smaller sets have no similar ones but equal ones
                use = use[~some.has(d1[use]) | first_of.has(node(doc[use], x.number[use]))]
                spread = mix(x.word)
                rare = rare_of[(spread >> U(64 - log2)).astype(np.int64)]
                order = by_rarity(x.line, rare)
                s1, s2 = signatures(spread, x.at)
                key, line, pos = prefix_keys(x.word[order], rare[order], x.at, use, limit, lines)
                if len(long_keys):
                    k = np.searchsorted(long_keys, key)
                    k[k == len(long_keys)] = 0
                    hit = np.flatnonzero(long_keys[k] == key)
                    part = mix(d1[line[hit]]) % blocks[k[hit]].astype(U)
                    key[hit] = mix(key[hit] ^ (part + U(1)) * U(0x632BE59BD9B4E019))
                out = np.empty(len(key), ENTRY)
                for c, col in zip(ENTRY.names, (key, doc[line], x.number[line], n[line], pos, s1[line], s2[line]), strict=True):
                    out[c] = col
                if len(out):
                    yield packed(out, buckets)

    return docs.mapInArrow(run, "bucket int, blob binary")


def _first_lines(sets: DataFrame, several: np.ndarray) -> DataFrame:
    """Keys of the first line of each set that the filter ``several`` says yes to, sets on one line included."""
    bound = sets.sparkSession.sparkContext.broadcast(several)

    def run(batches):
        several = Bloom(bound.value)
        for b in batches:
            at = several.has(b.column("d1").to_numpy())
            yield pa.RecordBatch.from_arrays([longs(node(b.column("doc").to_numpy()[at], b.column("line").to_numpy()[at]))], ["k"])

    return sets.filter("first").select("d1", "doc", "line").mapInArrow(run, "k bigint")


def later_matches(docs: DataFrame, min_words: int = 1, cap: int = 32, dense: int = 4096, limit: float = 2048, block: int = 32_768) -> DataFrame:
    """Durable (doc, line), rows may repeat, of the lines of (doc_id bigint, text) that an earlier line matches."""
    spark = docs.sparkSession
    tell = spark.sparkContext.broadcast
    size = text_bytes(docs)
    log2 = int(np.clip(np.ceil(np.log2(max(size, 1) / 64)), 16, 26))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = first_scan(docs, max(min_words, 1), log2, max(parts, size // (64 << 20)))
    sets = line_classes(told)
    lines = sets.filter("first").count()
    repeated = sets.filter("first and several").count()
    several = Bloom.collect(sets.filter("first and several"), "d1", n=repeated).bits
    firsts = Bloom.collect(_first_lines(sets, several), "k", n=repeated + lines // 100).bits
    bound = [tell(word_classes(told, log2)), tell(several), tell(firsts)]
    heavy = long_lists(told, bound[0], log2, limit, lines, block)
    bound.append(tell(heavy))
    # a bucket holds some 200,000 entries: there is one for about 40 bytes of text
    found = pairs(line_entries(docs, *bound, min_words, log2, limit, lines, max(parts, size // (8 << 20))), _split_lists(heavy), cap, dense)
    release(spark, [told], bound)
    names = ["a_doc", "a_line", "b_doc", "b_line"]

    # the word sets of all lines that may match another: one more scan of the texts
    likely = found.filter(F.col("kind").isin(BEST, OTHER)).select(*names)
    wanted = durable(_ends(likely).distinct())
    words = line_sets(docs, wanted)

    def confirm(some, sets):
        return durable(verify(some, sets).select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")))

    # one match is enough: each later line's likeliest pair first, its other pairs only if that fails
    best = found.filter(F.col("kind") == BEST).select(*names).dropDuplicates(["b_doc", "b_line"])
    gone = confirm(durable(best), words)
    other = durable(likely.join(gone.toDF("b_doc", "b_line"), ["b_doc", "b_line"], "left_anti").distinct())
    if not other.isEmpty():
        gone = gone.unionByName(confirm(other, lookup_join(words, durable(_ends(other).distinct()), ["doc", "line"], "left_semi")))
    # a line that is not gone yet may need all earlier ones of its long lists
    more = open_pairs(found, gone, _whole_lists(spark, heavy) if len(heavy[0]) else None)
    if not more.isEmpty():
        ends = durable(_ends(more).distinct())
        missing = durable(ends.join(wanted, ["doc", "line"], "left_anti"))
        sets_ = lookup_join(words, ends, ["doc", "line"], "left_semi")
        gone = gone.unionByName(confirm(more, sets_ if missing.isEmpty() else sets_.unionByName(line_sets(docs, missing))))
    # of a set on several lines all but the first go
    gone = durable(gone.unionByName(sets.filter("not first").select("doc", "line")))
    release(spark, [found, wanted, words, other, sets])
    return gone


def _ends(pairs_: DataFrame) -> DataFrame:
    """(doc, line) of both lines of each pair."""
    return pairs_.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).unionByName(pairs_.select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")))


def _parts(heavy):
    keys, blocks = heavy
    for key, m in zip(keys, blocks, strict=True):
        yield key, mix(key ^ (np.arange(1, m + 1, dtype=U) * U(0x632BE59BD9B4E019)))


def _split_lists(heavy) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, U), *[p for _, p in _parts(heavy)]]))


def _whole_lists(spark, heavy) -> DataFrame:
    """(v, whole): the blocks of long lists and the list each belongs to."""
    rows = [(int(v.view(np.int64)), int(key.view(np.int64))) for key, p in _parts(heavy) for v in p]
    return spark.createDataFrame(rows, "v bigint, whole bigint")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, s) of the wanted lines; bounded Bloom filters spare other documents and lines the work."""
    n = wanted.count()
    by_doc = Bloom.collect(wanted, "doc", n=n).bits
    by_line = Bloom.collect(node_keys(wanted), "k", n=n).bits
    bound = docs.sparkSession.sparkContext.broadcast((by_doc, by_line))

    def run(batches):
        by_doc, by_line = (Bloom(x) for x in bound.value)
        for b in batches:
            b = b.filter(pa.array(by_doc.has(b.column("doc_id").to_numpy())))
            if not b.num_rows:
                continue
            data, offsets = strings(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in slices(offsets):
                doc, line, start, end = split_lines(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                doc = ids[i + doc]
                use = np.flatnonzero(by_line.has(node(doc, line)))
                if not len(use):
                    continue
                # only the wanted lines' words are looked for, each line a text of its own
                size = end[use] - start[use]
                first = np.concatenate([[0], np.cumsum(size)])
                w = Words(data[offsets[i] + np.repeat(start[use] - first[:-1], size) + np.arange(first[-1])], first, lower=True)
                s, owner = distinct(w.hash, w.doc)
                first = np.searchsorted(owner, np.arange(len(use) + 1))
                off = pa.array((first * 8).astype(np.int32)).buffers()[1]
                blob = pa.Array.from_buffers(pa.binary(), len(use), [None, off, pa.py_buffer(s.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(line[use].astype(np.int32)), blob], ["doc", "line", "s"])

    # a line that only the filters' false yes lets in meets no pair later
    out = durable(docs.mapInArrow(run, "doc bigint, line int, s binary"))
    bound.destroy()
    return out


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """Durable (doc, gone): the removed line numbers (from 0, ascending) of each document (doc_id bigint, text) that loses any."""
    gone = later_matches(docs, **options)
    out = durable(gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    release(docs.sparkSession, [gone])
    return out


def _without(text: str, gone: list[int]) -> str:
    lines = text.split("\n")
    for k in reversed(gone):
        del lines[k]
    return "\n".join(lines)


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("text is not null").select(F.col("__node").alias("doc_id"), "text")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, removed (line numbers), kept_crc32 of what stays.

    Only texts that lose lines (by a Bloom filter of bounded size, so a few
    others too) travel to their line numbers.
    """
    rows = numbered(docs.select("doc_id", "text"))
    gone = removed_lines(_nodes(rows), **options)
    touched = docs.sparkSession.sparkContext.broadcast(Bloom.collect(gone, "doc", n=gone.count()).bits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        touched_ = Bloom(touched.value)
        for b in batches:
            texts, node = b.column("text"), b.column("__node")
            n = pc.add(pc.count_substring(texts, "\n"), 1).fill_null(0).cast(pa.int64())
            there = touched_.has(node.to_numpy())
            crc = [None if x else zlib.crc32(t.as_buffer()) if t.is_valid else 0 for x, t in zip(there, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), node, n, pa.array(crc, pa.int64()), pc.if_else(pa.array(there), texts, pa.scalar(None, texts.type))], ["doc_id", "__node", "n_lines", "crc", "text"])

    def finish(batches):
        for b in batches:
            removed, crc = b.column("gone").to_pylist(), b.column("crc").to_pylist()
            crc = [zlib.crc32(_without(t.as_py() or "", g or ()).encode()) if c is None else c for c, t, g in zip(crc, b.column("text"), removed, strict=True)]
            cols = [b.column("doc_id"), b.column("n_lines"), pa.array([len(g or ()) for g in removed], pa.int64()), pa.array([g or [] for g in removed], pa.list_(pa.int32())), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_removed", "removed", "kept_crc32"])

    measured = rows.mapInArrow(measure, f"doc_id {kind}, __node bigint, n_lines bigint, crc bigint, text string")
    joined = measured.join(gone.withColumnRenamed("doc", "__node").hint("merge"), "__node", "left")
    return durable(joined.select("doc_id", "n_lines", "crc", "text", "gone").mapInArrow(finish, f"doc_id {kind}, n_lines bigint, n_removed bigint, removed array<int>, kept_crc32 bigint"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without later matching lines, columns as they were (n_chars made anew); a document left without any word goes if it lost lines."""
    rows = numbered(docs)
    gone = removed_lines(_nodes(rows), **options).withColumnRenamed("gone", "__gone").withColumnRenamed("doc", "__node")
    names = docs.columns
    rows = rows.join(gone.hint("merge"), "__node", "left").drop("__node")

    def run(batches):
        for b in batches:
            removed = b.column("__gone").to_pylist()
            if not any(removed):
                yield b.select(names)
                continue
            texts = [_without(t, g) if g else t for t, g in zip(b.column("text").to_pylist(), removed, strict=True)]
            keep = pa.array([not g or bool(t.strip(" \t\n\x0b\x0c\r")) for t, g in zip(texts, removed, strict=True)])
            cols = {c: b.column(c) for c in names}
            cols["text"] = pa.array(texts, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pc.if_else(pa.array([bool(g) for g in removed]), pc.utf8_length(cols["text"]).cast(cols["n_chars"].type), cols["n_chars"])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names).filter(keep)

    return rows.mapInArrow(run, docs.schema)
