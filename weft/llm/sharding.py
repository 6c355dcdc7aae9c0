"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by doc_id, size, text checksum and text hash (equal rows are
interchangeable), so numbers depend on the data alone, not on files or tasks.
A balanced Feistel network over the smallest even-bit domain that holds the
row count permutes them; values outside the count are walked on. With
``x = perm(row)``, shard = x mod shards and slot = x div shards, so counts are
at most one apart and slots have no gaps; ``locate`` computes shard and slot
of any row number without looking at data, and ``unlocate`` inverts it.

Defined cases: null text has no bytes (size 1, checksum 0); null doc_id sorts
first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import durable
from weft.llm.kernels import mix

ROUNDS = 6


class Feistel:
    """A permutation of 0..n-1 computable in both directions."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        self.keys = [np.uint64(k) for k in keys]

    def _rounds(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        h, m = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & m
        for k in keys:
            if back:
                a, b = b ^ (mix(a ^ k) & m), a
            else:
                a, b = b, a ^ (mix(b ^ k) & m)
        return a << h | b

    def _walk(self, x, keys, back):
        x = np.asarray(x).astype(np.uint64)
        x = self._rounds(x, keys, back)
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = self._rounds(x[out], keys, back)
            out = out[x[out] >= self.n]
        return x.astype(np.int64)

    def forward(self, x):
        return self._walk(x, self.keys, False)

    def inverse(self, x):
        return self._walk(x, self.keys[::-1], True)


def locate(row, n: int, shards: int, seed: int):
    x = Feistel(n, seed).forward(row)
    return (x % shards).astype(np.int32), x // shards


def unlocate(shard, slot, n: int, shards: int, seed: int):
    return Feistel(n, seed).inverse(np.asarray(slot) * shards + np.asarray(shard))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Durable ``rows`` sorted over all partitions, with __part and __at (place in the partition).

    Returns also the offset of each partition: a row's global number is
    ``offset[__part] + __at``. Only one count a partition reaches the driver.
    """
    schema = rows.schema

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], [*b.schema.names, "__part", "__at"]
            )
            at += n

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spread = durable(spread.mapInArrow(number, f"{schema.simpleString()[7:-1]}, __part int, __at bigint"))
    counts = dict(spread.groupBy("__part").count().collect())
    offsets = np.zeros(max(counts, default=0) + 2, np.int64)
    for p, c in counts.items():
        offsets[p + 1] = c
    return spread, np.cumsum(offsets)


def shard(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("__h"),
        )
    )
    ranked, offsets = numbered(rows, ["doc_id", "size", "text_crc32", "__h"])
    n = int(offsets[-1])

    def place(batches):
        for b in batches:
            row = offsets[b.column("__part").to_numpy()] + b.column("__at").to_numpy()
            s, slot = locate(row, n, shards, seed)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "size", "text_crc32")], pa.array(s), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = ranked.mapInArrow(place, f"doc_id {kind}, size bigint, text_crc32 bigint, shard int, slot bigint")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
