import re

import numpy as np
import pyarrow as pa
import pytest

from kelpline.llm import simple8b as s8
from kelpline.llm.deep_shallow import blind_trie_order, sort_rows
from kelpline.llm.fm_index import FMIndex, suffix_array
from kelpline.llm.op8_chunk_dedup import GEAR, LEAST, MOST, WINDOW, ZEROS, cuts
from kelpline.llm.textkit import WORD_PATTERN, ngrams, winnow, words

TEXTS = ["Of the Élan, 42 x.y", "", None, "...", "a", "É" * 50, "word " * 400_000, "ÀB ab-AB\n漢字 ok"]


def test_words_follow_the_pattern_and_hash_alike():
    seen = {}
    for w in words(pa.array(TEXTS, pa.string())):
        h = w.hash()
        for r in range(w.lo, w.hi):
            want = [m[0].lower() for m in re.finditer(WORD_PATTERN, TEXTS[r] or "")]
            a, b = w.first[r - w.lo], w.first[r - w.lo + 1]
            got = [bytes(w.data[i:j]).decode() for i, j in zip(w.start[a:b], w.end[a:b])]
            assert got == want
            for x, k in zip(got, h[a:b].tolist()):
                assert seen.setdefault(x, k) == k
    assert len(set(seen.values())) == len(seen)


def test_winnow_takes_one_of_every_window():
    rng = np.random.default_rng(0)
    row = np.sort(rng.integers(0, 6, 300))
    g = rng.integers(1, 2**60, 300, dtype=np.uint64)
    pick = set(winnow(g, row, 9).tolist())
    for i in range(292):
        if row[i] == row[i + 8]:
            assert int(np.argmin(g[i : i + 9])) + i in pick
    h, at = ngrams(g, row, 3)
    assert len(h) == sum(row[i] == row[i + 2] for i in range(298))


@pytest.mark.parametrize("top", [1, 2, 100, 50_000, 2**40, 2**63])
@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 1000])
def test_simple8b_round_trip(top, n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, top, n, dtype=np.uint64)
    v[::7] = 0
    starts = np.append(np.arange(0, n, s8.BLOCK), n) if n else np.zeros(1, np.int64)
    w, o = s8.encode(v, starts)
    assert (s8.decode_blocks(w, o, n) == v).all()
    for i in range(len(starts) - 1):  # any block decodes alone
        assert (s8.decode(w[o[i] : o[i + 1]], starts[i + 1] - starts[i]) == v[starts[i] : starts[i + 1]]).all()


@pytest.mark.parametrize("sigma", [2, 3, 5, 300])
def test_fm_index_against_brute_force(sigma):
    rng = np.random.default_rng(sigma)
    t = rng.integers(1, sigma, 300)
    t = np.concatenate([t, t[50:200], t[:30]])
    x = np.append(t, 0)
    f = FMIndex(t, sigma, rate=8)
    assert suffix_array(x, f.bits).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    for n in (1, 3, 8):
        patterns = np.array([t[i : i + n] for i in rng.integers(0, len(t) - n, 25)])
        lo, hi = f.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            assert sorted(f.locate(np.arange(a, b)).tolist()) == [i for i in range(len(t) - n + 1) if (t[i : i + n] == p).all()]


def test_deep_shallow_order_and_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (300, 30)).astype(np.uint64)
    rows[50:200, :25] = rows[0, :25]
    rows[200:230] = rows[1]
    group = rng.integers(0, 3, 300)
    order, common = sort_rows(rows, group)
    assert [(group[i], tuple(rows[i])) for i in order] == sorted((group[i], tuple(rows[i])) for i in range(300))
    for k in range(1, 300):
        a, b = order[k - 1], order[k]
        want = -1 if group[a] != group[b] else next((d for d in range(30) if rows[a, d] != rows[b, d]), 30)
        assert common[k] == want
    flat = [i for same in blind_trie_order(rows, list(range(300))) for i in same]
    assert [tuple(rows[i]) for i in flat] == sorted(map(tuple, rows))


def slow_cuts(data: bytes) -> list[int]:
    out, last = [], 0
    for end in range(1, len(data) + 1):
        h = 0
        for k in range(WINDOW):
            if end - 1 - k >= 0:
                h = (h + (int(GEAR[data[end - 1 - k]]) << k)) & (2**64 - 1)
        if end - last == MOST or (end - last >= LEAST and (h << 1) % 2**64 >> (64 - ZEROS) == 0) or end == len(data):
            out.append(end)
            last = end
    return out


def test_gear_cuts_against_the_byte_loop():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 1, 15, 16, 700, 2000)] + [b"a" * 900]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    got = cuts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got.tolist() == [offsets[i] + c for i, t in enumerate(texts) for c in slow_cuts(t)]
