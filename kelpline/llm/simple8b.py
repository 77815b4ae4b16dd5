"""Simple-8b coding of unsigned integers in 64-bit words, many blocks at once.

A word's top 4 bits select how many values of how many bits the other 60 hold.  Selector 15 is an escape:
the next word is one raw 64-bit value, for values of 2**60 and more.  Values are coded in blocks of BLOCK,
each beginning with a new word, so any block can be decoded alone from its offset.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 128
#: Values a word and bits a value, by selector; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
MAX_COUNT = 60


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    v = v.astype(U64)
    out = np.ones(len(v), np.int64)
    left = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= (U64(1) << U64(step))
        out[big] += step
        left[big] >>= U64(step)
    return out


def encode(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks and where each block's begin; starts: where each block of values begins, and the end."""
    values = np.asarray(values).astype(U64)
    n, blocks = len(values), len(starts) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(blocks + 1, np.int64)
    bits = bit_lengths(values)
    end = np.repeat(starts[1:], np.diff(starts))
    room = end - np.arange(n)
    # how many of the next values fit each selector: the widest of a run of c, by doubling
    width = np.full(n + MAX_COUNT, 0, np.int8)
    width[:n] = bits
    widest = {1: width}
    span = 1
    while span * 2 <= MAX_COUNT:
        w = widest[span]
        nxt = w.copy()
        nxt[: len(w) - span] = np.maximum(w[: len(w) - span], w[span:])
        span *= 2
        widest[span] = nxt
    select = np.full(n, ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        c, b = int(COUNTS[s]), int(WIDTHS[s])
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(widest[p][:n], widest[p][c - p : c - p + n])
        # a run cut by the block's end may leave slots of the word empty
        if c == 1:
            select[bits <= b] = s
        else:
            select[(most <= b) & (room >= c)] = s
    # a short tail takes the selector whose slots hold all of it
    for s in range(len(COUNTS) - 1, -1, -1):
        c, b = int(COUNTS[s]), int(WIDTHS[s])
        tail = np.flatnonzero((room < c) & (room <= MAX_COUNT))
        if len(tail):
            most = np.zeros(len(tail), np.int8)
            at, left = tail.copy(), room[tail].copy()
            for p in (32, 16, 8, 4, 2, 1):
                go = left >= p
                most[go] = np.maximum(most[go], widest[p][at[go]])
                at[go] += p
                left[go] -= p
            select[tail[(most <= b)]] = s
    jump = np.where(select == ESCAPE, 1, np.minimum(np.append(COUNTS, [1, 1])[select], room))
    # where words begin: all blocks step on together
    at, live = starts[:-1].copy(), np.flatnonzero(np.diff(starts) > 0)
    first = np.zeros(n, bool)
    at = at[live]
    stop = starts[1:][live]
    while len(at):
        first[at] = True
        at = at + jump[at]
        more = at < stop
        at, stop = at[more], stop[more]
    begin = np.flatnonzero(first)
    sel, taken = select[begin].astype(np.int64), jump[begin]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), U64)
    words[place] = sel.astype(U64) << U64(60)
    escaped = sel == ESCAPE
    words[place[escaped] + 1] = values[begin[escaped]]
    wide = np.append(WIDTHS, [0, 0])[sel].astype(U64)
    for k in range(int(taken.max())):
        own = np.flatnonzero((taken > k) & ~escaped)
        words[place[own]] |= values[begin[own] + k] << (wide[own] * U64(k))
    return words, np.append(place, len(words))[np.searchsorted(begin, starts)]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of a run of words (one block, or several full ones that were written one by one)."""
    words = np.asarray(words, U64)
    sel = (words >> U64(60)).astype(np.int64)
    # a raw value may look like anything: only words at escape places tell
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.where(raw, 1, np.append(COUNTS, [0, 0])[sel])
    total = int(counts.sum())
    which = np.repeat(np.arange(len(words)), counts)
    k = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    width = np.where(raw, 0, np.append(WIDTHS, [0, 0])[sel])[which].astype(U64)
    mask = (U64(1) << np.minimum(width, U64(63))) - U64(1)
    out = (words[which] >> (width * k.astype(U64))) & mask
    out = np.where(raw[which], words[which], out)
    return out[:n]


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """All n values of a document: blocks of BLOCK values at the given word offsets."""
    parts = [decode(words[offsets[i] : offsets[i + 1]], min(BLOCK, n - i * BLOCK)) for i in range(len(offsets) - 1)]
    return np.concatenate(parts) if parts else np.zeros(0, U64)
