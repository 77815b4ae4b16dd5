"""Vectorised text primitives shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text, the same as the regular expression ``[a-z0-9\\x{80}-\\x{10FFFF}]+``.  Words are
found and hashed over the UTF-8 bytes of a whole Arrow batch with numpy, so no Python object is
made per word.  Hashes are 64 bits wide, built from fixed constants, and agree between workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
GEAR = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    IS_WORD[_c] = True
#: Bytes of text handled at once: small enough for the cache, a longer text is handled alone.
BLOCK = 1 << 20
WORD_PATTERN = "[A-Za-z0-9\x80-\U0010ffff]+"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, BLOCK + 1)
        _tables["p"], _tables["q"] = _powers(_R, size), _powers(_RINV, size)
        if size > 4 * BLOCK:  # a giant text must not leave its tables behind
            p, q = _tables.pop("p"), _tables.pop("q")
            return p[:n], q[:n]
    return _tables["p"][:n], _tables["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Words:
    """Words of rows lo..hi of a batch: byte spans, row of each word, first word of each row."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    _sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            p, _ = powers(len(self.data) + 1)
            s = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(GEAR[self.data] * p[: len(self.data)], out=s[1:])
            self._sums = s
        return self._sums

    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s, (_, q) = self.sums(), powers(len(self.data) + 1)
        return mix((s[end] - s[start]) * q[start])


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(column: pa.Array, limit: int = BLOCK, lower: bool = True) -> Iterator[Words]:
    """The words of a text column, block by block, in row order."""
    data, offsets = string_buffers(pc.utf8_lower(column) if lower else column)
    for lo, hi in blocks(offsets, limit):
        off = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        part = data[offsets[lo] : offsets[hi]]
        w = np.zeros(len(part) + 2, bool)
        w[1:-1] = IS_WORD[part]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(part))]
        begins, ends = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
        begins[inner] |= w[inner + 1]
        ends[inner - 1] |= w[inner]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, off)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Words(lo, hi, part, start, end, row, first)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words that stay in one row, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for j in range(1, n):
        g *= U64(0xD6E8FEB86659FD93)
        g += h[j : j + m]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(g[at]), at


def slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over every run of w neighbours, by doubling."""
    out, span = a, 1
    while span < w:
        step = min(span, w - span)
        out = op(out[: len(out) - step], out[step:])
        span += step
    return out


def winnow(g: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Indices of the n-grams that are least in some run of w n-grams of their row (ties all count)."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    least = slide(g, w, np.minimum)
    least = np.where(row[: len(least)] == row[w - 1 :], least, U64(0))
    pad = np.zeros(w - 1, np.uint64)
    most = slide(np.concatenate([pad, least, pad]), w, np.maximum)
    return np.flatnonzero((most == g) & (most > 0))


def group_starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, with the length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
