"""Language-model scores from the lattice of all subword segmentations.

A text is its words (A-Z lower-cased) and one end symbol. A word's lattice has
all segmentations of a space and its bytes into pieces of an existing
vocabulary (its normal pieces, and all single bytes), closed by an end-of-word
symbol. Log-space forward recursion adds all paths up.

The vocabulary's own scores (ranks, as a Zipf law) weight all segmentations
first, and forward-backward under those weights gives each piece's expected
count over all occurrences of all training words. A piece's weight is its
expected count and ``prior`` pseudo-counts dealt out by the vocabulary's scores,
so existing scores rule where the corpus says little. ``rounds=0`` keeps the
existing scores as they are.

With ``words`` the lattice of a word that the training corpus has also holds the
edge of the whole word: an absolute-discounted count; the discounted mass is the
weight of the subword paths. Without, only subword paths count.

Weights are kept for each of the most frequent values of ``lang`` among training
documents (at most COMPONENTS - 1, the rest pooled). A document's probability is
the marginal over segmentations and components: its own ``lang`` isn't looked at.

The base is the add-half word unigram. Word counts are exact and stay
distributed: the most frequent words (bounded number) are broadcast, all others
are joined by hash, for the base and for the whole-word edges alike.

Defined cases: null text is empty (the end symbol only); a null doc_id counts
as the empty string for the fold; a null or absent lang is the pooled
component; repeated rows are scored each; without training documents all
counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import durable, longs, slices, strings
from weft.llm.kernels import R, RINV, U, Words, _pow

SPREAD = U(0xD6E8FEB86659FD93)
#: Words beyond this many bytes take the per-word path.
LONG = 48
#: Words whose counts are broadcast.
HEAD = 1 << 20
#: Mixture components, the pooled one included.
COMPONENTS = 6
DISCOUNT = 0.6


class Pieces:
    """A piece vocabulary with hashed lookup of byte strings."""

    def __init__(self, names: list[bytes], ranks: np.ndarray):
        self.names, self.ranks = names, ranks
        lens = np.array([len(x) for x in names])
        data = np.frombuffer(b"".join(names), np.uint8)
        off = np.concatenate([[0], np.cumsum(lens)])
        powers = _pow(R, int(lens.max()))
        keys = np.array([(data[a:b].astype(U) + U(1)) @ powers[: b - a] for a, b in zip(off[:-1], off[1:], strict=True)], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[((self.keys * SPREAD) >> U(44)).astype(np.int64)] = True
        self.byte = np.zeros(256, np.int64)
        for i, x in enumerate(names):
            if len(x) == 1:
                self.byte[x[0]] = i
        self.longest = int(lens.max())

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            x = sp.id_to_piece(i).replace("▁", " ").encode()
            x = bytes(c + 32 if 65 <= c <= 90 else c for c in x)
            if b" " not in x[1:]:
                names[x] = min(names.get(x, np.inf), -sp.get_score(i))
        worst = max(names.values(), default=0.0) + 1
        for b in range(256):
            names.setdefault(bytes([b]), worst)
        return cls(list(names), np.array(list(names.values())))

    def first_weights(self) -> np.ndarray:
        """Log probabilities from the vocabulary's ranks (Zipf), the end of a word last."""
        w = 1 / (self.ranks + 20.0)
        w = np.append(w, w.sum() / 3)
        return np.log(w / w.sum())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``h`` that are pieces, and which."""
        rows = np.flatnonzero(self.maybe[((h * SPREAD) >> U(44)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[rows])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[rows]
        return rows[ok], self.ids[k[ok]]


def lattice(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces, logp: np.ndarray, weight: np.ndarray | None = None):
    """Natural-log probability of each word's subword paths under each row of ``logp`` (components, words).

    With ``weight`` (and one component) also the expected piece counts. The
    last entry of a row of ``logp`` is the end of a word.
    """
    out = np.zeros((len(logp), len(start)))
    expected = np.zeros(len(pieces.names)) if weight is not None else None
    size = end - start + 1
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, z in zip(cuts, np.append(cuts[1:], len(order))[: len(cuts)], strict=True):
        L = int(size[order[a]])
        step = max(1, (1 << 20) // L)
        for k in range(a, z, step):
            rows = order[k : min(z, k + step)]
            if L > LONG:
                for r in rows:
                    word = np.concatenate([[np.uint8(32)], data[start[r] : end[r]]])
                    out[:, r] = _long(word, pieces, logp, expected, None if weight is None else weight[r])
                continue
            text = np.empty((L, len(rows)), np.uint8)
            text[0] = 32
            for i in range(1, L):
                text[i] = data[start[rows] + i - 1]
            out[:, rows] = _block(text, pieces, logp, expected, None if weight is None else weight[rows])
    out += logp[:, -1:]
    return (out, expected) if weight is not None else out


def _add(a, b):
    """log(exp(a) + exp(b)) of finite values."""
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def _block(text, pieces, logp, expected, weight):
    L, n = text.shape
    powers, inverse = _pow(R, LONG + 1), _pow(RINV, LONG + 1)
    total = np.zeros((L + 1, n), U)
    for i in range(L):
        total[i + 1] = total[i] + (text[i].astype(U) + U(1)) * powers[i]
    edges = []  # found once, used for every component
    for j in range(1, L + 1):
        edges.append((j, j - 1, slice(None), pieces.byte[text[j - 1]]))
        for i in range(j - 2, max(-1, j - pieces.longest - 1), -1):
            rows, ids = pieces.find((total[j] - total[i]) * inverse[i])
            if len(rows):
                edges.append((j, i, rows, ids))
    out = np.empty((len(logp), n))
    for c, lp in enumerate(logp):
        alpha = np.empty((L + 1, n))
        alpha[0] = 0
        for j, i, rows, ids in edges:
            if i == j - 1:
                alpha[j] = alpha[i] + lp[ids]
            else:
                alpha[j, rows] = _add(alpha[j, rows], alpha[i, rows] + lp[ids])
        out[c] = alpha[L]
    if weight is not None:
        beta = np.full((L + 1, n), -1e30)
        beta[L] = 0
        for j, i, rows, ids in reversed(edges):
            after = beta[j, rows] + lp[ids]
            beta[i, rows] = _add(beta[i, rows], after)
            expected += np.bincount(ids, np.exp(alpha[i, rows] + after - alpha[L, rows]) * weight[rows], len(expected))
    return out


def _long(word, pieces, logp, expected, weight):
    """One long word: edges for all places at once, then a recursion over short windows."""
    L, m = len(word), pieces.longest
    total = np.zeros(L + 1, U)
    np.cumsum((word.astype(U) + U(1)) * _pow(R, L)[:L], out=total[1:])
    inverse = _pow(RINV, L)[:L]
    edge = np.full((L + 1, m + 1), -1)
    edge[1:, 1] = pieces.byte[word]
    for k in range(2, min(m, L) + 1):
        rows, ids = pieces.find((total[k:] - total[:-k]) * inverse[: L - k + 1])
        edge[rows + k, k] = ids
    lp = np.where(edge >= 0, logp[:, edge], -1e30)  # (components, places, lengths)
    alpha = np.full((len(logp), L + 1), -1e30)
    alpha[:, 0] = 0
    for j in range(1, L + 1):
        k = min(m, j)
        c = alpha[:, j - k : j][:, ::-1] + lp[:, j, 1 : k + 1]
        top = c.max(axis=1)
        alpha[:, j] = top + np.log(np.exp(c - top[:, None]).sum(axis=1))
    if weight is not None:
        beta = np.full(L + 1, -1e30)
        beta[L] = 0
        for j in range(L, 0, -1):
            k = min(m, j)
            beta[j - k : j] = _add(beta[j - k : j], (beta[j] + lp[0, j, 1 : k + 1])[::-1])
        j, k = np.nonzero(edge >= 0)
        share = np.exp(alpha[0, j - k] + lp[0, j, k] + beta[j] - alpha[0, L]) * weight
        expected += np.bincount(edge[j, k], share, len(expected))
    return alpha[:, L]


def fold(doc_id):
    """Remainder that tells held-out documents (1) from training ones."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def components(docs: DataFrame) -> list[str]:
    """The most frequent languages (ties by name); one more component pools the rest."""
    if "lang" not in docs.columns:
        return []
    rows = docs.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(COMPONENTS - 1).collect()
    return [r["lang"] for r in rows]


def train(docs: DataFrame, pieces: Pieces, rounds: int = 1, prior: float = 2000.0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Exact word counts of the training documents (h, n in all, n0.. by component), documents by component, and log piece weights (components, pieces + end of word)."""
    spark = docs.sparkSession
    training = docs.filter(fold(F.col("doc_id")) != 1)
    langs = components(training)
    K = len(langs) + 1
    which = F.lit(K - 1)
    for k, x in enumerate(langs):
        which = F.when(F.col("lang") == x, k).otherwise(which)
    text = training.select(F.coalesce("text", F.lit("")).alias("text"), which.cast("int").alias("k"))
    existing = pieces.first_weights()
    logp, words, ends = np.tile(existing, (K, 1)), None, np.zeros(K, np.int64)
    for r in range(max(rounds, 1)):
        bound = spark.sparkContext.broadcast((pieces, logp))

        def run(batches, first=(r == 0)):
            pieces, logp = bound.value
            P = len(pieces.names)
            total, ends = np.zeros((K, P + 1)), np.zeros(K, np.int64)
            for b in batches:
                data, offsets = strings(b.column("text"))
                kinds = b.column("k").to_numpy()
                ends += np.bincount(kinds, minlength=K)
                for i, j in slices(offsets, 8 << 20):
                    w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1], lower=True)
                    kind = kinds[i + w.doc]
                    for k in range(K):
                        mine = np.flatnonzero(kind == k)
                        if not len(mine):
                            continue
                        h, at, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                        at = mine[at]
                        # every occurrence counts, so how files and batches cut the texts doesn't matter
                        total[k, :P] += lattice(w.data, w.start[at], w.end[at], pieces, logp[k : k + 1], n.astype(float))[1]
                        total[k, P] += n.sum()
                        if first:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), longs(h), pa.array(n), pa.nulls(len(h), pa.float64())], names)
            k, p = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(p), pa.nulls(len(k), pa.int64()), pa.array(total[k, p])], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(K, dtype=np.int32)), pa.nulls(K, pa.int64()), pa.array(ends), pa.nulls(K, pa.float64())], names)

        names = ["k", "h", "n", "e"]
        told = durable(text.mapInArrow(run, "k int, h bigint, n bigint, e double"))
        total = np.zeros((K, len(pieces.names) + 1))
        for row in told.filter("e is not null").groupBy("k", "h").agg(F.sum("e").alias("e")).toArrow().to_pylist():
            total[row["k"], row["h"]] = row["e"]
        if r == 0:
            by = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(K)]
            words = durable(told.filter("h is not null and e is null").groupBy("h").agg(F.sum("n").alias("n"), *by))
            for row in told.filter("h is null").groupBy("k").agg(F.sum("n").alias("n")).collect():
                ends[row["k"]] = row["n"]
        bound.destroy()
        if rounds:
            pooled = prior * np.exp(existing) + total.sum(axis=0)  # a component's prior: the vocabulary's scores and a little of all components' use
            total += prior * np.exp(existing) + prior * pooled / pooled.sum()
            logp = np.log(total / total.sum(axis=1, keepdims=True))
    return words, ends, logp


def score(docs: DataFrame, pieces: Pieces, words: DataFrame, ends: np.ndarray, logp: np.ndarray, head: int = HEAD, whole_words: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    K, by = len(ends), [f"n{k}" for k in range(len(ends))]
    sums = words.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *by]], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"v{c}") for c in by]).first()
    seen = int(ends.sum())
    V, N = sums["v"] + (seen > 0), int(sums["n"]) + seen
    level, room = 1, head
    for r in sorted(words.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect(), key=lambda r: -r["n"]):
        room -= r["count"]
        if room < 0:
            level = r["n"] + 1
            break
    top = words.filter(F.col("n") >= level).toArrow()
    key = top.column("h").to_numpy().view(U)
    order = np.argsort(key)
    counts = np.stack([top.column(c).to_numpy()[order].astype(np.uint32 if sums["n"] < 2**32 else np.int64) for c in ["n", *by]])
    bound = spark.sparkContext.broadcast((pieces, logp, key[order], counts))
    whole = len(key) == sums["v"]
    norm = float(np.log10(N + 0.5 * (V + 1)))
    size = np.array([sums[c] for c in by], float)
    kept = np.array([sums[c] - DISCOUNT * sums[f"v{c}"] for c in by]) * whole_words
    spelled = np.log(np.maximum(1 - kept / np.maximum(size, 1), 1e-6))  # weight of the subword paths
    size = np.maximum(size, 1)
    each = size if whole_words else np.full(K, np.inf)  # what counts are divided by on whole-word edges
    go, stop = np.log10(size / (size + np.maximum(ends, 1))), np.log10(np.maximum(ends, 1) / (size + np.maximum(ends, 1)))
    share = np.log10((ends + 0.5) / (ends + 0.5).sum())

    def run(batches):
        pieces, logp, key, counts = bound.value
        part, at = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            data, offsets = strings(b.column("text"))
            for i, j in slices(offsets, 8 << 20):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1], lower=True)
                h, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
                texts = j - i
                k = np.searchsorted(key, h)
                k[k == len(key)] = 0
                known = key[k] == h if len(key) else np.zeros(len(h), bool)
                here = known | whole
                ll = lattice(w.data, w.start[first], w.end[first], pieces, logp)
                doc = np.empty((K, texts))
                for c in range(K):
                    p = np.exp(ll[c] + spelled[c])
                    if len(key):
                        p += np.where(known, np.maximum(counts[c + 1][k] - DISCOUNT, 0) / each[c], 0)
                    p = np.where(p > 1e-290, np.log10(np.maximum(p, 1e-300)), (ll[c] + spelled[c]) / np.log(10))
                    doc[c] = np.bincount(w.doc, np.where(here, p, 0)[which], texts) + w.count * go[c] + stop[c] + share[c]
                base = np.where(here, np.log10(np.where(known, counts[0][k] if len(key) else 0, 0) + 0.5) - norm, 0)
                ref = part + at + np.arange(texts)
                at += texts
                rows = [
                    pa.array(ref), b.column("doc_id").slice(i, texts), b.column("held_out").slice(i, texts), pa.array(w.count + 1),
                    pa.array(np.bincount(w.doc, known[which], texts).astype(np.int64) + (seen > 0)),
                    pa.array(np.bincount(w.doc, base[which], texts) + np.log10(seen + 0.5) - norm), *map(pa.array, doc), pa.nulls(texts, pa.int64()), pa.nulls(texts, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(rows, names)
                rest = np.flatnonzero(~here[which])
                if len(rest):  # (text, word) pairs with their counts and the word's subword paths
                    pair, n = _pairs(w.doc[rest], which[rest], len(h))
                    none = [pa.nulls(len(n), t) for t in (b.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64())]
                    paths = [pa.array(ll[c][pair[1]] + spelled[c]) for c in range(K)]
                    yield pa.RecordBatch.from_arrays([pa.array(ref[pair[0]]), *none, *paths, longs(h[pair[1]]), pa.array(n.astype(np.int64))], names)

    terms = [f"s{k}" for k in range(K)]
    names = ["ref", "doc_id", "held_out", "n_tokens", "n_known", "base", *terms, "h", "n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    told = durable(d.mapInArrow(run, f"ref bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, {', '.join(f'{c} double' for c in terms)}, h bigint, n bigint"))
    out = told.filter("h is null").drop("h", "n")
    if not whole:
        tail = told.filter("h is not null").select("ref", "h", F.col("n").alias("times"), *terms).join(words.filter(F.col("n") < level), "h", "left")
        c = F.coalesce("n", F.lit(0))
        sums = [F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * (F.log10(c + 0.5) - F.lit(norm))).alias("b2")]
        for k in range(K):
            p = F.exp(f"s{k}") + F.greatest(F.coalesce(f"n{k}", F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0)) / F.lit(float(each[k]))
            sums.append(F.sum(F.col("times") * F.when(p > 1e-290, F.log10(p)).otherwise(F.col(f"s{k}") / F.lit(float(np.log(10))))).alias(f"t{k}"))
        out = out.join(tail.groupBy("ref").agg(*sums), "ref", "left").withColumn("n_known", F.col("n_known") + F.coalesce("k2", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("b2", F.lit(0.0)))
        for k in range(K):
            out = out.withColumn(f"s{k}", F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0.0)))
    best = F.array_max(F.array(*terms))
    model = best + F.log10(sum((F.pow(F.lit(10.0), F.col(c) - best) for c in terms), F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), model.alias("score"))


def _pairs(doc, which, words):
    key, n = np.unique(doc.astype(np.int64) * words + which, return_counts=True)
    return np.stack([key // words, key % words]), n


def score_documents(docs: DataFrame, path: str, rounds: int = 1, prior: float = 2000.0, head: int = HEAD, words: bool = True) -> DataFrame:
    pieces = Pieces.load(path)
    counts, ends, logp = train(docs, pieces, rounds, prior)
    return score(docs, pieces, counts, ends, logp, head, words)
