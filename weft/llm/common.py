"""Shared plumbing: durable intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructField, StructType

# Arrow's own pools keep freed batches; the system's gives them back, and executors' memory is shared with the JVM.
pa.set_memory_pool(pa.system_memory_pool())
# With a fixed threshold (M_MMAP_THRESHOLD) glibc gives large freed arrays back too.
if hasattr(libc := ctypes.CDLL(None), "mallopt"):
    libc.mallopt(-3, 4 << 20)

#: Batches between the JVM and kernels while a durable table is written: both sides hold several at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Rows of a keyed lookup table that may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 100_000


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none (tests in one JVM) is a local folder made
    and recorded as the session's setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="weft-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/weft-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor loses no finished work, and row identifiers
    made from partition numbers keep the values that were written.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("weft-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, tables: list[DataFrame], broadcasts=()) -> None:
    """Give back what a finished step holds: durable tables, broadcasts, and shuffle files of plans that nothing refers to."""
    for t in tables:
        drop_durable(t)
    for b in broadcasts:
        b.destroy()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    """About the bytes of all texts, which tables and buckets are sized by: the plan's estimate, or a count where that can't be true."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 54:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 3 * size // 2


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__node``, a long for each row that follows the order of doc_id: doc_id itself where it can be that.

    Where ids are null, repeated or no integers, rows are written in order of
    doc_id, nulls last, and a hash of the text, and numbered by range partition and place.
    """
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        if not docs.groupBy("doc_id").count().agg(F.count(F.when(F.expr("count > 1 or doc_id is null"), 1))).first()[0]:
            return docs.withColumn("__node", F.col("doc_id").cast("bigint"))
    names = docs.columns

    def number(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.arange(at, at + b.num_rows))], [*names, "__node"])
            at += b.num_rows

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    sorted_ = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(sorted_.mapInArrow(number, StructType([*docs.schema.fields, StructField("__node", LongType())])))


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``small`` (one row a key, already durable) onto ``big`` by ``keys``, nulls equal.

    The row count of ``small`` is measured: up to BROADCAST_ROWS it is
    broadcast; a larger one is joined by shuffle, where adaptive execution
    splits skewed partitions of ``big``.
    """
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    renamed = small.select([F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in small.columns])
    cond = None
    for k in keys:
        c = big[k].eqNullSafe(renamed[f"__k_{k}"])
        cond = c if cond is None else cond & c
    out = big.join(renamed, cond, how)
    return out if how == "left_semi" else out.drop(*[f"__k_{k}" for k in keys])


def lowest(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows of lowest key hash: a sample that depends on the data alone.

    Hashes above what the row count makes plausible are dropped in every task
    first, so what is sorted is about the sample, however many tasks there are.
    """
    h = F.xxhash64(F.lit(seed), key)
    n = df.count()
    if n > 4 * rows:
        share = (rows + 8 * rows**0.5) / n
        df = df.filter(h < F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(h, key).limit(rows)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges whose texts hold about ``most`` bytes; one longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def longs(values) -> pa.Array:
    """uint64 hashes as Spark longs (same bits)."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


class Bloom:
    """A set of 64-bit keys in at most ``max_bits`` bits; says yes too often, never no wrongly."""

    def __init__(self, bits: np.ndarray, seeds: int = 3):
        self.bits, self.seeds = bits, seeds

    @staticmethod
    def positions(keys: np.ndarray, m: int, seeds: int):
        from weft.llm.kernels import mix

        for s in range(seeds):
            yield mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (s + 1) & (2**64 - 1))) & np.uint64(m - 1)

    @classmethod
    def collect(cls, keys: DataFrame, column: str, max_log2: int = 28, n: int | None = None) -> "Bloom":
        """Build from a distributed table: each task folds its keys into pages of 8 KB, pages are or-ed.

        The filter's size follows the key count (``n`` if known) up to the fixed
        bound of 2**max_log2 bits (32 MB), the only thing that reaches the driver.
        """
        n = keys.count() if n is None else n
        log2 = int(min(max_log2, max(16, np.ceil(np.log2(max(n, 1) * 12)))))
        page = 1 << 16

        def fold(batches):
            bits = np.zeros(1 << log2, bool)
            for b in batches:
                k = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for p in cls.positions(k, 1 << log2, 3):
                    bits[p] = True
            pages = bits.reshape(-1, page)
            hit = np.flatnonzero(pages.any(axis=1))
            yield pa.record_batch(
                {"page": pa.array(hit.astype(np.int32)), "bits": pa.array([np.packbits(pages[i]).tobytes() for i in hit], pa.binary())}
            )

        def union(key, table):
            acc = None
            for v in table.column("bits"):
                w = np.frombuffer(v.as_py(), np.uint8)
                acc = w.copy() if acc is None else acc | w
            return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([acc.tobytes()], pa.binary())})

        keys = keys.select(F.col(column).cast("long")).na.drop()
        parts = keys.mapInArrow(fold, "page int, bits binary")
        if keys.rdd.getNumPartitions() << log2 > 1 << 28:  # more than 32 MB of pages: or-ed before they come to the driver
            parts = parts.groupBy("page").applyInArrow(union, "page int, bits binary")
        out = np.zeros((1 << log2) // page * (page // 8), np.uint8)
        for r in parts.toLocalIterator():
            w = np.frombuffer(bytes(r["bits"]), np.uint8)
            out[r["page"] * (page // 8) : (r["page"] + 1) * (page // 8)] |= w
        return cls(out)

    def has(self, keys: np.ndarray) -> np.ndarray:
        m = len(self.bits) * 8
        ok = np.ones(len(keys), bool)
        for p in self.positions(keys.view(np.uint64), m, self.seeds):
            ok &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (7 - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return ok


PAGE = 1 << 13


def count_pages(acc: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's counters as compressed pages: numbers and bytes of those that aren't all 0."""
    pages = acc.reshape(-1, PAGE)
    hit = np.flatnonzero(pages.any(axis=1))
    return pa.array(hit.astype(np.int32)), pa.array([zlib.compress(pages[i].astype("<u4").tobytes(), 1) for i in hit], pa.binary())


def add_pages(pages: DataFrame, log2: int) -> np.ndarray:
    """Sum of the tasks' counters (page int, c binary): added by page, then one bounded table comes to the driver."""

    def add(key, table):
        acc = np.zeros(PAGE, np.int64)
        for v in table.column("c"):
            acc += np.frombuffer(zlib.decompress(v.as_py()), "<u4")
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([zlib.compress(np.minimum(acc, 2**32 - 1).astype("<u4").tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << log2, np.int64)
    for r in pages.groupBy("page").applyInArrow(add, "page int, c binary").toLocalIterator():
        out[r["page"] * PAGE : (r["page"] + 1) * PAGE] += np.frombuffer(zlib.decompress(bytes(r["c"])), "<u4")
    return out


def hashed_counts(df: DataFrame, emit, log2: int) -> np.ndarray:
    """Counts of 64-bit keys over all rows, folded into 2**log2 counters.

    ``emit(batches)`` yields uint64 arrays. A counter is an upper bound of its
    keys' counts (up to 2**32 - 1). Each task adds its keys up first.
    """

    def fold(batches):
        acc = np.zeros(1 << log2, np.int64)
        for keys in emit(batches):
            acc += np.bincount((keys >> np.uint64(64 - log2)).astype(np.int64), minlength=1 << log2)
        yield pa.RecordBatch.from_arrays(list(count_pages(acc)), ["page", "c"])

    return add_pages(df.mapInArrow(fold, "page int, c binary"), log2)
