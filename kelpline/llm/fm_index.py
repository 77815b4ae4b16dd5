"""FM-index over integer sequences: suffix sorting, wavelet-matrix ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of text in order; symbols below 2**bits, the last one unique and least.

    The first sort packs as many symbols as fit in 62 bits; later ones double the depth, over the suffixes
    that still share their whole known prefix and over no others.
    """
    n = len(text)
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        if j < n:
            key[: n - j] |= text[j:]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    del key
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while depth < n:
        size = np.diff(np.append(np.flatnonzero(head), n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            break
        own = order[slots]
        after = own + depth
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort((rank[own] << 31) | nxt)
        own, nxt = own[by], nxt[by]
        order[slots] = own
        group = rank[own]
        new = np.ones(len(own), bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        head[slots] = new
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        depth *= 2
    return order


class Bits:
    """Bit vector with rank by blocks of 64."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.zeros = self.n - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1) == 1


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, rate: int = 32):
        """text: symbols in 1..sigma-1; a least terminator 0 is put behind it."""
        text = np.append(np.asarray(text, np.int64), 0)
        self.n, self.bits = len(text), max(1, int(sigma - 1).bit_length())
        sa = suffix_array(text, self.bits)
        a = text[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            bit = (a >> level) & 1 == 1
            self.levels.append(Bits(bit))
            a = np.concatenate([a[~bit], a[bit]])
        symbols = np.arange(sigma)
        self.begin = self._descend(symbols, np.zeros(sigma, np.int64))
        sampled = sa % rate == 0
        self.marks, self.samples = Bits(sampled), sa[sampled]

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, b in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = b.rank(i)
            i = np.where((c >> level) & 1 == 1, b.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each c before row i of the last column."""
        return self._descend(c, i) - self.begin[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (one a row, all of one length), by backward search of all at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            gone = live[lo[live] >= hi[live]]
            hi[gone] = lo[gone]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled position, all rows at once."""
        out, steps, live, i = np.zeros(len(row), np.int64), 0, np.arange(len(row)), row.copy()
        while len(live):
            known = self.marks.at(i)
            out[live[known]] = self.samples[self.marks.rank(i[known])] + steps
            live, i = live[~known], i[~known]
            c, k = np.zeros(len(i), np.int64), i
            for b in self.levels:
                one, ones = b.at(k), b.rank(k)
                c = (c << 1) | one
                k = np.where(one, b.zeros + ones, k - ones)
            i = self.less[c] + k - self.begin[c]
            steps += 1
        return out % self.n
