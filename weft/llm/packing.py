"""Packing token sequences by cutting-stock column generation.

Documents are cut into pieces of at most ``capacity`` tokens (full pieces, then
the remainder). The histogram of piece lengths, at most ``capacity`` numbers,
goes to the driver; a linear program over cutting patterns (of length classes
a few tokens wide, which converges far sooner than one row a length) is solved by column
generation (dense revised simplex, an unbounded knapsack dynamic program
prices columns) until it is within ``gap`` of a lower bound; rounded-down
patterns plus first-fit-decreasing patterns for the rest hold every piece.
Pieces of one length are ranked over the whole corpus without bringing them
together (rank within a task plus the task's offset), and a rank maps to a
pattern copy and an offset by binary search in the bounded pattern table.

Defined cases: null text counts as empty, which is the single id 0; repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import durable, lookup_join

#: Code points (and run lengths) on which the two BPE engines were compared; other texts take the slower one.
UNUSUAL = re.compile("[^\\x00-ɏ‐-‧‰-›€]|\\s{200}|\\S{4000}")
_encoders: dict = {}


def encoder(path: str):
    """Ids of a text by the vocabulary at ``path``; special tokens' strings are ordinary text."""
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # byte-level vocabularies spell bytes as printable characters
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(spelled[c] for c in w): i for w, i in vocab.items() if all(c in spelled for c in w) and w != "<|endoftext|>"}
        import public_tokenizers

        fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if UNUSUAL.search(text):
                return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
            return np.array(fast.encode_ordinary(text), "<u4")

        _encoders[path] = encode
    return _encoders[path]


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value and how many of each length reach it."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            v = best[c - lengths[:k]] + values[:k]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], choice[c] = v[j], j
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return best[capacity], counts


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible triangular basis: for each length, longest first, one pattern led by it and filled with what is left."""
    m = len(lengths)
    columns, x, left = np.zeros((m, m)), np.zeros(m), demand.astype(float).copy()
    for k in range(m - 1, -1, -1):
        a = columns[:, k]
        if left[k] <= 1e-9:
            a[k] = capacity // lengths[k]
            continue
        lead = 1 if 2 * lengths[k] > capacity or 3 * lengths[k] <= capacity else 2
        a[k] = lead
        x[k] = left[k] / lead
        room, top = capacity - lead * int(lengths[k]), k
        left[k] = 0
        while room > 0:
            top = min(top, int(np.searchsorted(lengths, room, "right")))
            can = np.flatnonzero(left[:top] >= x[k] - 1e-9)
            can = can[left[can] > 1e-9] if len(can) else can
            if not len(can):
                break
            j = int(can[-1])
            n = min(room // int(lengths[j]), int((left[j] + 1e-9) // x[k]))
            a[j] += n
            left[j] = max(0.0, left[j] - n * x[k])
            room -= n * int(lengths[j])
            top = j
    return columns, x


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and amounts of an LP solution within ``gap`` of a lower bound, or after ``most`` columns."""
    columns, x = first_basis(lengths, demand, capacity)
    bound = float((lengths * demand).sum()) / capacity
    if x.sum() > bound * (1 + gap):
        inverse = np.zeros_like(columns)  # of a triangular matrix; plain loops, as threaded BLAS calls may stall beside a JVM
        for j in range(len(x)):
            inverse[j, j] = 1 / columns[j, j]
            inverse[:j, j] = -(inverse[:j, :j] * columns[:j, j]).sum(axis=1) / columns[j, j]
        # idle columns get a little demand of their own, else pivots stall; it is rounded away again
        x = x + np.where(x < 1e-6, np.random.default_rng(1).uniform(0.2, 0.6, len(x)), 0) * min(1.0, x.sum() / len(x) / 4)
        bound = float(((columns.T * lengths).sum(axis=1) * x).sum()) / capacity
        for _ in range(most):
            duals = inverse.sum(axis=0)
            value, a = price(lengths, duals, capacity)
            bound = max(bound, x.sum() / max(value, 1.0))
            if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
                break
            u = (inverse * a).sum(axis=1)
            grow = u > 1e-9
            ratio = np.where(grow, x / np.where(grow, u, 1), np.inf)
            r = int(ratio.argmin())
            t = ratio[r]
            x = np.maximum(x - t * u, 0)
            x[r] = t
            pivot = inverse[r] / u[r]
            inverse -= u[:, None] * pivot
            inverse[r] = pivot
            columns[:, r] = a
    return np.rint(columns).astype(np.int64).T, x


def cutting_stock(lengths, demand, capacity: int = 1024, gap: float = 0.001, most: int = 1500) -> list[tuple[int, np.ndarray]]:
    """(copies, counts by length) of patterns that hold exactly ``demand`` pieces."""
    lengths, demand = np.asarray(lengths, np.int64), np.asarray(demand, np.int64)
    if not len(lengths):
        return []
    patterns, x = column_generation(lengths, demand.astype(float), capacity, gap, most)
    left, out = demand.copy(), []
    for a, amount in zip(patterns, x, strict=True):
        copies = int(np.floor(amount + 1e-9))
        if a.any():
            copies = min(copies, int((left[a > 0] // a[a > 0]).min()))
        if copies > 0 and a.any():
            out.append((copies, a))
            left = left - copies * a
    while left.any():  # first-fit decreasing over the rest, a pattern at a time
        room, a = capacity, np.zeros(len(lengths), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), room // int(lengths[k]))
            a[k] += n
            room -= n * int(lengths[k])
        copies = int((left[a > 0] // a[a > 0]).min())
        out.append((copies, a))
        left = left - copies * a
    return out


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Durable pieces of all documents, with task and rank among the task's pieces of that length."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        part, encode = TaskContext.get().partitionId(), encoder(path)
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for b in batches:
            row, start, length, crc, total, at = [], [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = np.concatenate([encode(text.as_py() or ""), tail])
                n = len(ids)
                for s in range(0, n, capacity):
                    k = min(capacity, n - s)
                    row.append(i), start.append(s), length.append(k), total.append(n), at.append(seen[k])
                    crc.append(zlib.crc32(ids[s : s + k].tobytes()))
                    seen[k] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(v, pa.int64()) for v in (start, length, crc, total)], pa.array([part] * len(row), pa.int32()), pa.array(at, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "at"],
            )

    return durable(
        docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, at bigint")
    )


def pack(docs: DataFrame, path: str, capacity: int = 1024, grain: int = 4, gap: float = 0.001, most: int = 1500) -> DataFrame:
    """Place every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Patterns are made of length classes ``grain`` tokens wide; offsets are
    exact sums of the true lengths, which follow from ranks and the histogram.
    """
    cut = pieces(docs, path, capacity)
    counts = durable(cut.groupBy("length", "part").count())
    hist = sorted((r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect())
    lengths, sizes = np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64)
    ends = np.cumsum(sizes)  # pieces of all documents in order of length: where each length's end
    begin = ends - sizes
    classes, member = np.unique(-(-lengths // grain), return_inverse=True)
    demand = np.bincount(member, sizes, len(classes)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(demand)])[:-1] if len(classes) else np.zeros(0, np.int64)
    used = base.copy()
    # units of patterns, in order: piece number of copy i is first + i * each + turn
    slot_at, slot_unit, slot_seq = [], [], []
    first, each, turn, seq = [], [], [], 0
    for copies, a in cutting_stock(classes, demand, capacity // grain, gap, most):
        start = len(first)
        for k in np.flatnonzero(a):
            n = int(a[k])
            slot_at.append(int(used[k])), slot_unit.append((start, len(first))), slot_seq.append(seq)
            first += [int(used[k])] * n
            each += [n] * n
            turn += range(n)
            used[k] += copies * n
        seq += copies
    order = np.argsort(np.array(slot_at, np.int64))
    slot_at, slot_seq = np.array(slot_at, np.int64)[order], np.array(slot_seq, np.int64)[order]
    slot_unit = np.array(slot_unit, np.int64).reshape(-1, 2)[order]
    first, each, turn = (np.array(v, np.int64) for v in (first, each, turn))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    ranked = lookup_join(cut, counts, ["length", "part"])

    def place(batches):
        for b in batches:
            n = b.column("length").to_numpy()
            number = begin[np.searchsorted(lengths, n)] + b.column("base").to_numpy() + b.column("at").to_numpy()
            j = np.searchsorted(slot_at, number, "right") - 1
            lead, unit = slot_unit[j, 0], slot_unit[j, 1]
            copy, t = np.divmod(number - slot_at[j], each[unit])
            unit = unit + t
            offset, k = np.zeros(len(n), np.int64), np.flatnonzero(unit > lead)
            u = lead.copy()
            while len(k):
                v = u[k]
                offset[k] += lengths[np.searchsorted(ends, first[v] + copy[k] * each[v] + turn[v], "right")]
                u[k] += 1
                k = k[u[k] < unit[k]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(slot_seq[j] + copy), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
