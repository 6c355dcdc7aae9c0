"""Approximate nearest neighbours by additive quantisation.

Unit vectors are sums of one codeword from each of ``books`` full-dimensional
codebooks. Codebooks are fitted on a bounded sample (``sample_rows``, lowest
hashes): residual k-means, then rounds of beam-search encoding and codeword
updates against what the other books leave. Every vector is encoded by beam
search and stored with the norm of its reconstruction. A query scores all codes
by lookup tables (its inner product with every codeword), divides by the norm,
and ranks the best ``rerank`` of them, a fixed number whatever the index's
size, anew by the exact cosine. Shards are dealt by hash, so each holds its
share of the best; a shard reranks that share and four standard deviations.

Equal vectors are one index entry with their smallest ids, enough of them for
any answer, so large groups of copies cost nothing. Queries meet the index as
blocks against shards, grouped by (block, shard).

Defined cases: null, empty, zero vectors and those with null or non-finite
components take no part; vectors meet those of their own length, and lengths
of at most ``few`` vectors are searched exactly; vectors are scaled by powers of two
first, so any magnitude is safe and no digit changes; ties go to the smaller
id; rows that repeat an id with one vector count once; an id with several
vectors is found by its nearest and asks with the smallest (by components);
null ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import durable, lowest


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of vectors, each scaled by a power of two so that its largest component is about 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -e[:, None])


class Codebooks:
    def __init__(self, words: np.ndarray):
        self.words = words  # (books, size, dim)
        self.dots = np.einsum("mkd,njd->mknj", words, words)

    @classmethod
    def fit(cls, x: np.ndarray, books: int, size: int, beam: int, rounds: int, seed: int) -> "Codebooks":
        rng = np.random.default_rng(seed)
        size = max(1, min(size, len(x)))
        rest, words, codes = x.copy(), [], []
        for _ in range(books):
            c = rest[rng.choice(len(rest), size, replace=False)]
            for _ in range(8):
                a = cls._nearest(rest, c)
                n = np.bincount(a, minlength=size)
                total = np.zeros_like(c)
                np.add.at(total, a, rest)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), size)])
            a = cls._nearest(rest, c)
            rest = rest - c[a]
            words.append(c), codes.append(a)
        out = cls(np.stack(words))
        for _ in range(rounds):
            codes = out.encode(x, beam)
            w = out.words.copy()
            for m in range(books):
                left = x - sum(w[j][codes[:, j]] for j in range(books) if j != m)
                n = np.bincount(codes[:, m], minlength=size)
                total = np.zeros_like(w[m])
                np.add.at(total, codes[:, m], left)
                w[m] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], w[m])
            out = cls(w)
        return out

    @staticmethod
    def _nearest(x, c):
        return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes (rows, books) by beam search over books."""
        books, size, _ = self.words.shape
        out = np.zeros((len(x), books), np.int64)
        for at in range(0, len(x), 1024):
            y = x[at : at + 1024]
            n = len(y)
            table = np.einsum("nd,mkd->nmk", y, self.words)
            norm = (self.words**2).sum(axis=2)
            codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
            for m in range(books):
                # |x - s - w|^2 grows by |w|^2 - 2 x.w + 2 s.w
                step = norm[m] - 2 * table[:, m]
                inner = sum(self.dots[j][:, m][codes[:, :, j]] for j in range(m)) if m else 0
                all_ = cost[:, :, None] + step[:, None, :] + 2 * inner
                flat = all_.reshape(n, -1)
                k = min(beam, flat.shape[1])
                best = np.argpartition(flat, k - 1, axis=1)[:, :k]
                cost = np.take_along_axis(flat, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // size)[:, :, None], axis=1) if m else np.zeros((n, k, 0), np.int64), (best % size)[:, :, None]], axis=2)
            out[at : at + n] = codes[np.arange(n), cost.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def usable(vectors: DataFrame) -> DataFrame:
    """Durable (vec_id, vec, dim): distinct pairs of an id and a vector that take part."""
    ok = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    good = "size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vec, x -> x <> 0)"
    return durable(ok.filter(good).distinct().withColumn("dim", F.size("vec")))


def distinct_vectors(ok: DataFrame, k: int) -> DataFrame:
    """Durable (u, ids, vec): each distinct vector with its smallest ids; the limit is applied in every task before the shuffle."""
    key = ok.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec"))
    some = key.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return durable(some.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")).withColumnRenamed("k1", "u").drop("k2"))


def build(distinct: DataFrame, dim: int, books: int = 16, size: int = 256, beam: int = 4, rounds: int = 1, sample_rows: int = 8_192, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(index, codebooks): index rows are (u, ids, vec, codes, norm) of distinct vectors of one length."""

    def fit(batches):
        x = [_vectors(b.column("vec"), dim) for b in batches]
        if x:
            x = np.concatenate(x)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            w = Codebooks.fit(x, books, size, beam, rounds, seed).words
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([w.shape[1]])], ["w", "size"])

    sample = lowest(distinct, "u", sample_rows, seed).select("vec").coalesce(1)
    row = sample.mapInArrow(fit, "w binary, size bigint").first()
    words = np.frombuffer(bytes(row["w"])).reshape(books, row["size"], dim)
    bound = distinct.sparkSession.sparkContext.broadcast(words)

    def encode(batches):
        c = Codebooks(bound.value)
        for b in batches:
            x = _vectors(b.column("vec"), dim)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            codes = c.encode(x, beam)
            norm = np.sqrt((c.decode(codes) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.astype(np.uint16).tobytes() for r in codes], pa.binary()), pa.array(norm)], [*b.schema.names, "codes", "norm"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    out = durable(distinct.mapInArrow(encode, f"{schema}, codes binary, norm double"))
    bound.destroy()
    return out, words


NAMES = ["query_id", "vec_id", "score"]


def _best(out, me, x, norm, X, xn, ids, top, k: int) -> None:
    """Append the ``k`` nearest of the entries ``top`` to query ``me``, ties to the smaller id, each id once."""
    exact = (X[top] * x).sum(axis=1) / (norm * xn[top])
    order = np.argsort(-exact, kind="stable")
    found: dict[int, float] = {}
    last = -np.inf
    for s, c in zip(exact[order], top[order], strict=True):
        if len(found) >= k and s < last:
            break
        for i in ids[c]:
            if i != me:
                found.setdefault(i, s)
        last = s
    for i, s in sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k]:
        out[0].append(me), out[1].append(i), out[2].append(s)


def search(index: DataFrame, queries: DataFrame, words: np.ndarray, k: int, rerank: int = 800, shard_rows: int = 16_384, block_rows: int = 1_024) -> DataFrame:
    """query_id, vec_id, score: the ``k`` nearest of each shard to each query."""
    spark = index.sparkSession
    books, size, dim = words.shape
    shards, blocks = -(-max(index.count(), 1) // shard_rows), -(-max(queries.count(), 1) // block_rows)
    share = int(np.ceil(rerank / shards + 4 * np.sqrt(rerank / shards)))
    bound = spark.sparkContext.broadcast(words.astype(np.float32))
    left = queries.select(F.col("vec_id").alias("query_id"), "vec", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = index.select("ids", "vec", "codes", "norm", F.pmod(F.col("u"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kinds = [queries.schema["vec_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString(), "double"]

    def meet(q, r):
        out = [[], [], []]
        if q.num_rows and r.num_rows:
            words = bound.value.reshape(books * size, dim)
            Q, X = _vectors(q.column("vec").combine_chunks(), dim), _vectors(r.column("vec").combine_chunks(), dim)
            codes = np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint16).reshape(-1, books).astype(np.int32) + np.arange(books, dtype=np.int32) * size
            codes = np.ascontiguousarray(codes.T)
            norm, xn = np.maximum(r.column("norm").to_numpy(), 1e-12).astype(np.float32), np.sqrt((X * X).sum(axis=1))
            ids = r.column("ids").to_pylist()
            for me, x, t in zip(q.column("query_id").to_pylist(), Q, Q.astype(np.float32) @ words.T, strict=True):
                near = t[codes[0]]
                for c in codes[1:]:
                    near += t[c]
                near /= norm
                top = np.argpartition(-near, share)[:share] if len(near) > share else np.arange(len(near))
                _best(out, me, x, np.sqrt((x * x).sum()), X, xn, ids, top, k)
        return pa.table([pa.array(v, t) for v, t in zip(out, (q.schema.field("query_id").type, r.schema.field("ids").type.value_type, pa.float64()), strict=True)], NAMES)

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(meet, ", ".join(f"{n} {t}" for n, t in zip(NAMES, kinds, strict=True)))
    out = durable(found)
    bound.destroy()
    return out


def search_exactly(distinct: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same for lengths of few vectors, each length's in one task: (dim, vec, ids) against (dim, vec, vec_id)."""
    kinds = [queries.schema["vec_id"].dataType.simpleString(), distinct.schema["ids"].dataType.elementType.simpleString(), "double"]

    def meet(key, q, r):
        out = [[], [], []]
        if q.num_rows and r.num_rows:
            dim = key[0].as_py()
            Q, X = _vectors(q.column("vec").combine_chunks(), dim), _vectors(r.column("vec").combine_chunks(), dim)
            xn, ids = np.sqrt((X * X).sum(axis=1)), r.column("ids").to_pylist()
            for me, x in zip(q.column("vec_id").to_pylist(), Q, strict=True):
                _best(out, me, x, np.sqrt((x * x).sum()), X, xn, ids, np.arange(len(X)), k)
        return pa.table([pa.array(v, t) for v, t in zip(out, (q.schema.field("vec_id").type, r.schema.field("ids").type.value_type, pa.float64()), strict=True)], NAMES)

    sides = queries.groupBy("dim").cogroup(distinct.withColumn("dim", F.size("vec")).groupBy("dim"))
    return durable(sides.applyInArrow(meet, ", ".join(f"{n} {t}" for n, t in zip(NAMES, kinds, strict=True))))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, few: int = 4_096, rerank: int = 800, shard_rows: int = 16_384, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found to every row whose id is divisible by ``every``."""
    ok = usable(vectors)
    ask = durable(ok.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("vec").alias("vec")).groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("vec_id", "q.dim", "q.vec"))
    large = ok.groupBy("dim").count().filter(F.col("count") > few)
    dims = sorted(r["dim"] for r in large.collect())  # at most one for ``few`` rows
    rest = ~F.col("dim").isin(dims) if dims else F.lit(True)
    found = search_exactly(distinct_vectors(ok.filter(rest), k), ask.filter(rest), k)
    for dim in dims:
        index, words = build(distinct_vectors(ok.filter(F.col("dim") == dim), k), dim, **options)
        found = found.unionByName(search(index, ask.filter(F.col("dim") == dim), words, k, rerank, shard_rows))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
