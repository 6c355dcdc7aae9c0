"""Quality rules: text statistics, fixed rules, and an isolation forest over the statistics.

Statistics come from vectorised kernels over whole texts. The forest is fitted
on a bounded sample of labelled rows (``sample_rows``, lowest hashes of
doc_id): its good rows give each statistic's normal band (0.3 to 99.7 per
cent), statistics enter as log excess over the band, so ordinary variation
doesn't isolate anything; then random splits on random features to a limited
depth. A document's score is ``2 ** (-mean path length / c(psi))``, high when few splits isolate
it. The threshold is calibrated on every labelled row that passes the fixed
rules, from a histogram of scores by label: the one that catches most bad rows
while at least ``keep`` of the good ones stay.

Defined cases: null or empty text has no words, fails the fixed rules and is
not kept; doc_ids with several labels count as bad if any is; without good
labels the forest is fitted on a sample of all documents; without bad or good
labels the threshold is ``default_threshold``; repeated rows are scored each;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import durable, lowest, slices, strings
from weft.llm.kernels import SPACE, U, Words, mix, windows, _pow, R, RINV

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["length", "symbols", "dup_lines", "repeats", "capitals", "marks", "echo", "digits", "lone", "long_words"]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?;:,.'\"()[]{}-_=+/\\~^`@")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BINS = 2000


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict, np.ndarray]:
    """The counts of each text and its feature vector."""
    w = Words(data, offsets)
    off, n, texts = w.offsets, len(data), len(offsets) - 1
    solid = ~SPACE[data]
    lead = solid & ((data & 0xC0) != 0x80)  # first bytes of code points
    word_chars = _per_text(lead, off)
    symbols = _per_text(SYMBOL[data], off)
    # lines with a word, equal to an earlier one of their text
    feed = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], feed + 1]))
    starts = starts[starts < n]
    text_of = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], n), off[text_of + 1])
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    total = np.zeros(n + 1, U)
    np.multiply(data.astype(U) + U(1), _pow(R, max(n, 1))[:n], out=total[1:])
    np.cumsum(total, out=total)
    line = mix(((total[ends] - total[starts]) * _pow(RINV, max(n, 1))[starts]) ^ ((ends - starts).astype(U) << U(40))) if len(starts) else np.zeros(0, U)
    filled = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    line, text_of = line[filled], text_of[filled]
    key = mix(line + text_of.astype(U) * U(0x9E3779B97F4A7C15))
    lines = np.bincount(text_of, minlength=texts)
    dup = lines - np.bincount(text_of[np.unique(key, return_index=True)[1]], minlength=texts)
    # words inside 8-word windows that the text has twice
    k, repeats = 8, np.zeros(texts, np.int64)
    if len(w.hash) >= k:
        acc = np.zeros(len(w.hash) - k + 1, U)
        from weft.llm.kernels import SHINGLE

        for j in range(k):
            acc += w.hash[j : len(w.hash) - k + 1 + j] * U(SHINGLE[j])
        at = np.flatnonzero(w.doc[: len(w.hash) - k + 1] == w.doc[k - 1 :])
        hit = at[_repeated(mix(acc[at] + w.doc[at].astype(U) * U(0xD6E8FEB86659FD93)))]
        step = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + k, -1)
        repeats = np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=texts)
    words = np.diff(w.first)
    size = w.end - w.start
    some, chars = np.maximum(words, 1), np.maximum(word_chars, 1)
    echo = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=texts) if len(w.hash) else np.zeros(texts)
    lone = np.bincount(w.doc[(size == 1) & ~np.isin(data[np.minimum(w.start, max(n - 1, 0))], list(b"aAIyYoOeEu"))], minlength=texts) if len(size) else np.zeros(texts)
    features = np.column_stack(
        [
            word_chars / some,
            symbols / chars,
            dup / np.maximum(lines, 1),
            repeats / some,
            _per_text(UPPER[data], off) / chars,
            _per_text(MARK[data], off) / chars,
            echo / some,
            _per_text(DIGIT[data], off) / chars,
            lone / some,
            (np.bincount(w.doc[size > 25], minlength=texts) if len(size) else np.zeros(texts)) / some,
        ]
    )
    return dict(zip(COUNTS, (words, word_chars, symbols, dup, repeats), strict=True)), features


def base_failed(c: dict) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


@dataclass
class Forest:
    feature: np.ndarray  # (trees, nodes); -1: leaf
    split: np.ndarray
    length: np.ndarray  # path length at a leaf
    depth: int
    norm: float

    @staticmethod
    def mean_path(n):
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int, psi: int, seed: int) -> "Forest":
        rng = np.random.default_rng(seed)
        psi = min(psi, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(psi, 2)))))
        nodes = (1 << (depth + 1)) - 1
        feature, split, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, rows[rng.choice(len(rows), psi, replace=False)], 0)] if psi else []
            while todo:
                at, x, d = todo.pop()
                lo, hi = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(1), np.zeros(1))
                can = np.flatnonzero(hi > lo)
                if d >= depth or len(x) <= 1 or not len(can):
                    length[t, at] = d + cls.mean_path(len(x))
                    continue
                f = int(rng.choice(can))
                s = rng.uniform(lo[f], hi[f])
                feature[t, at], split[t, at] = f, s
                left = x[:, f] <= s
                todo += [(2 * at + 1, x[left], d + 1), (2 * at + 2, x[~left], d + 1)]
        return cls(feature, split, length, depth, float(max(cls.mean_path(psi), 1e-9)))

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for f, s, length in zip(self.feature, self.split, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                g = f[at]
                inner = g >= 0
                at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(g, 0)] > s[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def excess(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(0, np.maximum(x - high, low - x)) / np.maximum(high - low, 1e-3) * 4)


@dataclass
class Rules:
    forest: Forest
    threshold: float
    low: np.ndarray
    high: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.forest.score(excess(features, self.low, self.high))

    def kept(self, counts: dict, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(counts)
        score = np.ones(len(failed))
        ok = np.flatnonzero(~failed)
        score[ok] = self.score(features[ok])
        return failed, score, ~failed & (score < self.threshold)


def measure(docs: DataFrame) -> DataFrame:
    """Durable counts and features of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = strings(b.column("text"))
            for i, j in slices(offsets):
                c, x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                x = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *[pa.array(np.asarray(c[k], np.int64)) for k in COUNTS], x], ["doc_id", *COUNTS, "x"])

    return durable(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, x array<double>"))


def _columns(b) -> tuple[dict, np.ndarray]:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(FEATURES)))
    return {c: b.column(c).to_numpy() for c in COUNTS}, x


def fit(measured: DataFrame, labels: DataFrame, trees: int = 100, psi: int = 64, sample_rows: int = 20_000, keep: float = 0.995, default_threshold: float = 0.7, seed: int = 11) -> Rules:
    """Fit the forest on at most ``sample_rows`` labelled rows; calibrate on all labelled rows."""
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("good"))
    known = durable(measured.join(good, "doc_id"))
    passing = "n_words >= 20 and 100 * n_repeat_words <= 30 * n_words"
    rows = lowest(known.filter(passing), "doc_id", sample_rows, seed).select("good", "x").collect()
    if not any(r["good"] == 1 for r in rows):
        rows = lowest(measured.filter(passing), "doc_id", sample_rows, seed).select(F.lit(1).alias("good"), "x").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    good_rows = x[np.array([r["good"] == 1 for r in rows], bool)]
    low, high = np.percentile(good_rows, [0.3, 99.7], axis=0) if len(good_rows) else np.zeros((2, len(FEATURES)))
    rules = Rules(Forest.fit(excess(x, low, high), trees, psi, seed), default_threshold, low, high)

    def bins(batches):
        for b in batches:
            s = np.minimum((rules.score(_columns(b)[1]) * BINS).astype(np.int64), BINS - 1)
            c = np.bincount(s * 2 + b.column("good").to_numpy().clip(0, 1), minlength=2 * BINS)
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(c[hit])], ["bin", "n"])

    hist = np.zeros(2 * BINS, np.int64)
    for r in known.filter(passing).mapInArrow(bins, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        hist[r["bin"]] = r["n"]
    bad, fine = hist[0::2], hist[1::2]
    if not bad.any() or not fine.any():
        return rules
    cut = 1 + int(np.argmax(np.cumsum(fine) >= keep * fine.sum()))  # documents in bins below stay
    empty = np.flatnonzero(bad[cut:])  # move up while no bad row would be let in
    cut += int(empty[0]) if len(empty) else 0
    rules.threshold = cut / BINS
    return rules


def judge(measured: DataFrame, rules: Rules) -> DataFrame:
    kind = measured.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            failed, score, kept = rules.kept(*_columns(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in COUNTS], pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return measured.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, score double")


def filter_documents(docs: DataFrame, rules: Rules) -> DataFrame:
    """The documents that the rules keep, all columns as they were; no shuffle."""

    def run(batches):
        for b in batches:
            data, offsets = strings(b.column("text"))
            keep = [rules.kept(*statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1]))[2] for i, j in slices(offsets)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
