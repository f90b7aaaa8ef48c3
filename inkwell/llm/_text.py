"""Vectorised tokens and hashes over blocks of UTF-8 text.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is what
``[^\\x20\\x09-\\x0D]+`` matches. All hashes are polynomials modulo 2**64,
read from prefix sums and then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}
#: Bytes that are read in one step, so that temporary arrays stay small whatever the length of a text.
STEP = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown on demand; for short arrays."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U(base))
        out[0] = U(1)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def power_at(base: int, index: np.ndarray) -> np.ndarray:
    """base**index, from one table if it is short, else from tables of small powers and of large steps."""
    most = int(index.max(initial=0))
    if most < 2 * STEP:
        return powers(base, most + 1)[index]
    return powers(base, 1 << 16)[index & 0xFFFF] * powers(pow(base, 1 << 16, 1 << 64), (most >> 16) + 1)[index >> 16]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * BASE**i, one longer than values."""
    out = np.zeros(len(values) + 1, U)
    for at in range(0, len(values), STEP):
        part = values[at : at + STEP].astype(U) * powers(BASE, STEP)[: min(STEP, len(values) - at)]
        if at:
            part *= U(pow(BASE, at, 1 << 64))
        np.cumsum(part, out=part)
        out[at + 1 : at + 1 + len(part)] = part + out[at]
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end)."""
    out = np.empty(len(start), U)
    for i in range(0, len(start), STEP):
        a, b = start[i : i + STEP], end[i : i + STEP]
        out[i : i + STEP] = _normal(prefix[b] - prefix[a], a, b)
    return out


def _normal(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans from sums that depend on where the spans stand."""
    return mix(sums * power_at(BASE_INV, start) + (end - start).astype(U))


def sampled_sums(values, size: int, at: np.ndarray, kind=np.int64) -> np.ndarray:
    """Prefix sums at the sorted places ``at`` of what ``values(first, last)`` returns for each step of ``size`` places."""
    out, carry, i = np.zeros(len(at), kind), kind(0), 0
    for first in range(0, max(size, 1), STEP):
        last = min(first + STEP, size)
        total = np.zeros(last - first + 1, kind)
        np.cumsum(values(first, last), out=total[1:], dtype=kind)
        total += carry
        j = len(at) if last == size else int(np.searchsorted(at, last))
        out[i:j] = total[at[i:j] - first]
        i, carry = j, total[-1]
    return out


class Words:
    """Words of a block: byte bounds, document and hash of each, in order. The bytes are read step by step."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data, self.offs, self.lower = data, offs, lower
        starts, ends = [], []
        for first in range(0, len(data), STEP):
            last = min(first + STEP, len(data))
            word = ~SPACE[data[max(first - 1, 0) : last + 1]]  # with a neighbour on either side
            lead = min(first, 1)
            begins, stops = word[lead : lead + last - first].copy(), word[lead : lead + last - first].copy()
            begins[1 - lead :] &= ~word[: len(begins) - 1 + lead]
            stops[: len(word) - lead - 1] &= ~word[lead + 1 :]
            here = word[lead:]
            edge = offs[np.searchsorted(offs, first) : np.searchsorted(offs, last)] - first
            begins[edge] = here[edge]
            edge = offs[np.searchsorted(offs, first + 1) : np.searchsorted(offs, last, "right")] - first - 1
            stops[edge] = here[edge]
            starts.append((np.flatnonzero(begins) + first).astype(np.int32 if len(data) < 2**31 else np.int64))
            ends.append((np.flatnonzero(stops) + first + 1).astype(starts[-1].dtype))
        none = np.zeros(0, np.int32)
        self.start, self.end = np.concatenate(starts or [none]), np.concatenate(ends or [none])
        self.n_docs, self.sums = len(offs) - 1, None
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), self.counts())
        if hashed:
            self.hash = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes [start, end) of spans in order, which do not overlap."""

        def values(first: int, last: int) -> np.ndarray:
            part = LOWER[self.data[first:last]] if self.lower else self.data[first:last]
            part = part.astype(U) + U(1)
            part *= powers(BASE, STEP)[: last - first]
            if first:
                part *= U(pow(BASE, first, 1 << 64))
            return part

        sums = sampled_sums(values, len(self.data), end, U)
        sums -= sampled_sums(values, len(self.data), start, U)
        for i in range(0, len(sums), STEP):
            sums[i : i + STEP] = _normal(sums[i : i + STEP], start[i : i + STEP], end[i : i + STEP])
        return sums

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word by document."""
        total = np.concatenate([[0], np.cumsum(values)])
        edge = np.searchsorted(self.start, self.offs)
        return total[edge[1:]] - total[edge[:-1]]

    def counts(self) -> np.ndarray:
        edge = np.searchsorted(self.start, self.offs)
        return np.diff(edge)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of n words within one document, by rolling hashes."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        first = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :]).astype(self.start.dtype)
        if self.sums is None:
            self.sums = prefix_sums(self.hash)
        return first, span_hash(self.sums, first, first + n)


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs elsewhere too, and whether it occurs earlier."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def covered(first: np.ndarray, width: int, size: int) -> np.ndarray:
    """Positions below size that lie in some window of that width; windows begin at different places."""
    depth = np.zeros(size + 1, np.int32)
    depth[first] = 1
    np.cumsum(depth, out=depth)
    depth[width:] -= depth[:-width].copy()
    return depth[:size] > 0
