"""Vectorised text kernels over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes (the separators are ASCII,
so bytes and code points split alike). Everything here works on whole batches;
no Python loop runs per word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
R = 0x9E3779B97F4A7C15 | 1
RINV = pow(R, -1, 1 << 64)
SHINGLE = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(16)]

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(m, U)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        if m <= 1 << 23:
            _powers[base] = have
    return have


class Words:
    """Words of some texts: byte spans, the text each lies in, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.offsets = offsets = offsets - offsets[0]
        n = len(data)
        self.data = data = LOWER[data] if lower else data
        solid = ~SPACE[data]
        head = np.empty(n + 1, bool)
        if n:
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            head[0] = solid[0]
            head[1:n] = solid[1:] & ~solid[:-1]
            head[cut] = solid[cut]
            tail = np.empty(n, bool)
            tail[:-1] = solid[:-1] & ~solid[1:]
            tail[-1] = solid[-1]
            tail[cut - 1] = solid[cut - 1]
            self.start, self.end = np.flatnonzero(head[:n]), np.flatnonzero(tail) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)  # index of each text's first word
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U)
        total = np.empty(n + 1, U)
        total[0] = 0
        total[1:] = self.data
        total[1:] += U(1)
        total[1:] *= _pow(R, n)[:n]
        np.cumsum(total, out=total)
        h = (total[self.end] - total[self.start]) * _pow(RINV, n)[self.start]
        return mix(h ^ ((self.end - self.start).astype(U) << U(56)))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows and the text of each; a text of 1 to k-1 words is one window."""
    n = len(w.hash)
    whole = np.flatnonzero((w.count > 0) & (w.count < k))
    out, doc = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= k:
        acc = np.zeros(n - k + 1, U)
        for j in range(k):
            acc += w.hash[j : n - k + 1 + j] * U(SHINGLE[j])
        ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
        out, doc = mix(acc[ok]), w.doc[: n - k + 1][ok]
    if len(whole):
        s = np.zeros(len(whole), U)
        for j in range(k - 1):
            has = w.count[whole] > j
            s[has] += w.hash[w.first[whole[has]] + j] * U(SHINGLE[j])
        s = mix(s ^ (w.count[whole].astype(U) << U(48)))
        out, doc = np.concatenate([out, s]), np.concatenate([doc, whole])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def distinct(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs in that order; ``group`` must be ascending."""
    n = len(values)
    if not n:
        return values, group
    cut = np.flatnonzero(group[1:] != group[:-1]) + 1
    if n > 100 * (len(cut) + 1):
        v, g = values.copy(), group
        for a, b in zip(np.r_[0, cut], np.r_[cut, n], strict=True):
            v[a:b].sort()
    else:
        # one sort of (group, leading bits of the value, place); values that differ are never merged
        rank = np.zeros(n, U)
        rank[cut] = 1
        np.cumsum(rank, out=rank)
        groups, places = max(1, len(cut)).bit_length(), n.bit_length()
        lead = 64 - groups - places
        order = None
        if lead >= 24:
            key = (rank << U(64 - groups)) | (values >> U(64 - lead) << U(places)) | np.arange(n, dtype=U)
            key.sort()
            order = (key & U((1 << places) - 1)).astype(np.int64)
            key >>= U(places)
            v = values[order]
            if ((key[1:] == key[:-1]) & (v[1:] != v[:-1])).any():  # values that differ in their last bits only
                order = None
        if order is None:
            order = np.lexsort((values, rank))
        v, g = values[order], group[order]
    keep = np.ones(n, bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return v[keep], g[keep]


def set_digest(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each group's distinct values; ``first``: group starts, then the end."""

    def sums(x):
        c = np.zeros(len(x) + 1, U)
        np.cumsum(x, out=c[1:])
        return c[first[1:]] - c[first[:-1]]

    return mix(sums(mix(values ^ U(0xA5A5A5A5A5A5A5A5)))), mix(sums(mix(values + U(0x632BE59BD9B4E019))))
