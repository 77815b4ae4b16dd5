"""Exact n-gram Jaccard self-join by a prefix tree over globally ordered sets.

1. Every text becomes its set of word n-grams.  The grams go, packed, to hash buckets, which count the
   documents of each gram; grams of one document can match nothing and are dropped there.
2. What is left of a set returns to its document, in one global order: rare grams first.  With s grams,
   u of them unique, a partner at threshold t shares at least ceil(t*s) grams, so one of the first
   s - ceil(t*s) + 1 grams.  Documents with fewer shared grams than ceil(t*s) leave at once.
3. Equal sets are one class of copies, and the least doc_id stands for it; a task sends the prefix of such a set once.
   Sets that share a gram of these prefixes, at lengths within a factor t, are linked if they can share enough:
   bits of their grams' hashes that only one of two sets has are grams only one of them has.  The connected
   components of the links hold every pair of the join.  Most of a long list of a gram are often near copies of each
   other; they are linked in a chain, and so are lists beyond LONGEST.
4. The sets of a component, in blocks of at most some BLOCK sets whose pairs are tasks of their own, form a
   path-compressed trie.  Walking down it, the overlaps of the path with the sets that can still be partners are
   kept once per shared prefix; a subtree is left as soon as overlap so far plus the remaining length cannot
   reach the threshold for any partner.
5. Documents get the number of sets that theirs is linked to, and the least doc_id that links and copies lead to.

Every link between different sets is found and counted; copies are counted and not expanded into pairs.

Defined results: rows without doc_id or text, or without words, pair with nothing, nor does any row of an empty
table; columns other than doc_id and text are not read.  A text of fewer than n words is one gram, all its words.
Long texts count with all their grams.  Rows that repeat a doc_id are one document with
all their grams, as large as the largest of them.  Ties play no part: ids are least ids, links are counted.
Grams are compared by hashes of 40 bits within a bucket, and sets by 64 bits and their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_pairs, batches, checkpointed, connected_components, id_hash, local_components, partitions, rows, split_by, tidy, to_buckets, unpack, with_id
from .textkit import group_starts, mix, ngrams, words

U64 = np.uint64
GRAMS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
GRAMS_SQL = "bucket int, kind int, ids binary, counts binary, low binary, high binary"
SETS = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("keys", pa.binary())])
SETS_SQL = "doc_id long, size int, print long, keys binary"
POSTED = ("ids", "sizes", "shared", "marks", "counts", "keys")
POSTED_SQL = "bucket int, ids binary, sizes binary, shared binary, marks binary, counts binary, keys binary"
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Grams held before a task sends them off.
CHUNK = 1_500_000
#: Sets of a component that meet at once.
BLOCK = 2000
#: Lists of a prefix gram up to LIST sets are compared pair by pair, up to LONGEST unless most neighbours are alike.
LIST, LONGEST = 32, 4096
#: Pairs and links that a task holds at once.
PAIRS_HELD, LINKS_HELD = 500_000, 2_000_000


def need(size: int | np.ndarray, t: float):
    """Least overlap that a set of this size must have with any partner."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def short_keys(w, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of 1 to n - 1 words: one gram, a hash of the words, and the row."""
    count = np.diff(w.first)
    at = np.flatnonzero((count > 0) & (count < n))
    if not len(at):
        return np.zeros(0, np.uint64), at
    h = w.hash()
    out = np.empty(len(at), np.uint64)
    for i, r in enumerate(at):
        part = h[w.first[r] : w.first[r + 1]]
        v = 0
        for x in part.tolist():
            v = (v * 0xD6E8FEB86659FD93 + x + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = v
    return mix(out), at


def spread(n: int, parts: int):
    """Texts to packed gram buckets (kind 0) and set sizes (kind 1, sent to the document's bucket)."""

    def emit(ids, sizes, doc, gram) -> Iterator[pa.RecordBatch]:
        out = {"bucket": [], "kind": [], "ids": [], "counts": [], "low": [], "high": []}
        order, at = split_by((gram & U64(0xFFFFFF)) % U64(parts), parts)
        rest, who = gram[order] >> U64(24), doc[order]
        for b in np.flatnonzero(np.diff(at)):
            lo, hi = at[b], at[b + 1]
            starts = group_starts(who[lo:hi])
            out["bucket"].append(int(b)), out["kind"].append(0)
            out["ids"].append(np.diff(ids[who[lo:hi][starts[:-1]]], prepend=0).tobytes())
            out["counts"].append(np.diff(starts).astype(np.uint32).tobytes())
            out["low"].append(rest[lo:hi].astype(np.uint32).tobytes())
            out["high"].append((rest[lo:hi] >> U64(32)).astype(np.uint8).tobytes())
        order, at = split_by(id_hash(ids) % U64(parts), parts)
        for b in np.flatnonzero(np.diff(at)):
            own = order[at[b] : at[b + 1]]
            out["bucket"].append(int(b)), out["kind"].append(1)
            out["ids"].append(ids[own].tobytes()), out["counts"].append(sizes[own].astype(np.uint32).tobytes())
            out["low"].append(b""), out["high"].append(b"")
        yield rows(GRAMS, **out)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, docs, grams, held, base = [], [], [], [], 0, 0
        for batch in batches(it):
            own = batch.column(0).to_numpy()
            for w in words(batch.column(1)):
                g, at = ngrams(w.hash(), w.row, n)
                short, short_row = short_keys(w, n)
                row = np.concatenate([w.row[at], short_row]).astype(np.uint64)
                key = np.concatenate([g, short])
                # one sort makes the grams of each row distinct: the row above, 48 bits of the hash below
                key = np.unique((row << U64(48)) | (key >> U64(16))) if w.hi - w.lo < 65536 else _unique_wide(row, key)
                row = (key >> U64(48)).astype(np.int64) if w.hi - w.lo < 65536 else key[1]
                gram = key & U64(0xFFFFFFFFFFFF) if w.hi - w.lo < 65536 else key[0]
                ids.append(own[w.lo : w.hi]), sizes.append(np.bincount(row, minlength=w.hi - w.lo))
                docs.append(row + base), grams.append(_widen(gram))
                base += w.hi - w.lo
                held += len(gram)
                if held >= CHUNK:
                    yield from emit(np.concatenate(ids), np.concatenate(sizes), np.concatenate(docs), np.concatenate(grams))
                    ids, sizes, docs, grams, held, base = [], [], [], [], 0, 0
        if ids:
            yield from emit(np.concatenate(ids), np.concatenate(sizes), np.concatenate(docs), np.concatenate(grams))

    return run


def _widen(gram: np.ndarray) -> np.ndarray:
    """64 bits again from the 48 that were kept, so that both halves are well mixed."""
    return mix(gram)


def _unique_wide(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for blocks of very many tiny rows."""
    key = key >> U64(16)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[keep], row[keep].astype(np.int64)


def count_documents(parts: int):
    """A gram bucket: drops grams of one document, returns the others with the order of their document count."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, low, high, bucket = [], [], [], [], None
        for batch in batches(it):
            kind = batch.column("kind").to_numpy()
            if (kind == 1).any():
                yield batch.filter(pa.array(kind == 1))
            batch = batch.filter(pa.array(kind == 0))
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                ids.append(np.cumsum(np.frombuffer(batch.column("ids")[i].as_py(), np.int64)))
                counts.append(np.frombuffer(batch.column("counts")[i].as_py(), np.uint32))
                low.append(np.frombuffer(batch.column("low")[i].as_py(), np.uint32))
                high.append(np.frombuffer(batch.column("high")[i].as_py(), np.uint8))
        if not ids:
            return
        doc, low, high = np.repeat(np.concatenate(ids), np.concatenate(counts)), np.concatenate(low), np.concatenate(high)
        gram = (high.astype(np.uint64) << U64(32)) | low
        del ids, counts, low, high
        order = np.argsort(gram)
        starts = group_starts(gram[order])
        many = np.repeat(np.diff(starts) > 1, np.diff(starts))
        order = order[many]
        gram, doc = gram[order], doc[order]
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        keep = np.ones(len(gram), bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        gram, doc = gram[keep], doc[keep]
        starts = group_starts(gram)
        df = np.diff(starts) if len(gram) else np.zeros(0, np.int64)
        rank = np.repeat(np.minimum(255, np.floor(np.log2(np.maximum(df, 1)) * 8)).astype(np.uint8), df)
        keep = np.repeat(df > 1, df)
        gram, doc, rank = gram[keep], doc[keep], rank[keep]
        order = np.argsort(doc, kind="stable")
        gram, doc, rank = gram[order], doc[order], rank[order]
        starts = group_starts(doc)
        own, n_own = doc[starts[:-1]], np.diff(starts)
        out = {"bucket": [], "kind": [], "ids": [], "counts": [], "low": [], "high": []}
        home = (id_hash(own) % U64(parts)).astype(np.int64) if len(own) else np.zeros(0, np.int64)
        by, at = split_by(home, parts)
        packed = (rank.astype(np.uint64) << U64(56)) | (U64(bucket & 0xFFFF) << U64(40)) | gram
        for b in np.flatnonzero(np.diff(at)):
            mine = by[at[b] : at[b + 1]]
            index = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in mine])
            out["bucket"].append(int(b)), out["kind"].append(2)
            out["ids"].append(np.diff(own[mine], prepend=0).tobytes()), out["counts"].append(n_own[mine].astype(np.uint32).tobytes())
            out["low"].append((packed[index] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            out["high"].append((packed[index] >> U64(32)).astype(np.uint32).tobytes())
        if out["bucket"]:
            yield rows(GRAMS, **out)

    return run


def gather(t: float):
    """A document bucket: the shared grams of each document in global order; documents that can have no partner go."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_ids, sizes, ids, counts, keys = [], [], [], [], []
        for batch in batches(it):
            for kind, i, c, lo, hi in zip(*(batch.column(x).to_pylist() for x in ("kind", "ids", "counts", "low", "high"))):
                if kind == 1:
                    size_ids.append(np.frombuffer(i, np.int64)), sizes.append(np.frombuffer(c, np.uint32))
                else:
                    ids.append(np.cumsum(np.frombuffer(i, np.int64))), counts.append(np.frombuffer(c, np.uint32))
                    keys.append((np.frombuffer(hi, np.uint32).astype(np.uint64) << U64(32)) | np.frombuffer(lo, np.uint32))
        if not ids:
            return
        doc, key = np.repeat(np.concatenate(ids), np.concatenate(counts)), np.concatenate(keys)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        starts = group_starts(doc)
        own, shared = doc[starts[:-1]], np.diff(starts)
        all_ids, all_sizes = np.concatenate(size_ids), np.concatenate(sizes).astype(np.int64)
        order = np.argsort(all_ids, kind="stable")
        all_ids, all_sizes = all_ids[order], all_sizes[order]
        at = group_starts(all_ids)
        largest, total = np.maximum.reduceat(all_sizes, at[:-1]), np.add.reduceat(all_sizes, at[:-1])
        here = np.searchsorted(all_ids[at[:-1]], own)
        # a repeated doc_id: the union is at most the sum; equal rows have the size of one of them
        single = np.diff(at)[here] == 1
        size = np.where(single, total[here], np.maximum(largest[here], shared))
        live = np.flatnonzero(shared >= need(size, t))
        # sets without unshared grams may be equal to others: they have a print of their grams, the rest of their id
        sums = np.append(U64(0), np.cumsum(mix(key)))
        prints = np.where(shared == size, mix(sums[starts[1:]] - sums[starts[:-1]] + size.astype(U64)), id_hash(own)).view(np.int64)
        for lo in range(0, len(live), 4096):
            part = live[lo : lo + 4096]
            yield rows(SETS, doc_id=own[part], size=size[part], print=prints[part], keys=[key[starts[i] : starts[i + 1]].tobytes() for i in part])

    return run


def prefix_postings(t: float, parts: int):
    """The prefix grams of the sets, packed by bucket; of equal sets of a task that of the first, the least doc_id."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches(it):
            names, first = np.unique(batch.column("print").to_numpy(), return_index=True)
            first = np.sort(first[~np.isin(names, seen, assume_unique=True)])
            if not len(first):
                continue
            seen = np.union1d(seen, names)
            batch = batch.take(pa.array(first))
            ids, size = batch.column("doc_id").to_numpy(), batch.column("size").to_numpy().astype(np.int64)
            keys = [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            lens = np.array([len(k) for k in keys])
            take = size - need(size, t) + 1 - (size - lens)
            part = [k[: max(0, c)] for k, c in zip(keys, take.tolist())]
            mark = marks_of(np.concatenate(keys), np.repeat(np.arange(len(keys)), lens), len(keys))
            key, who = np.concatenate(part), np.repeat(np.arange(len(part)), [len(p) for p in part])
            order, at = split_by(id_hash(key.view(np.int64)) % U64(parts), parts)
            out = {"bucket": [], **{k: [] for k in POSTED}}
            for b in np.flatnonzero(np.diff(at)):
                own = order[at[b] : at[b + 1]]
                first = group_starts(who[own])
                one = who[own[first[:-1]]]
                out["bucket"].append(int(b)), out["ids"].append(ids[one].tobytes()), out["sizes"].append(size[one].astype(np.int32).tobytes())
                out["shared"].append(lens[one].astype(np.int32).tobytes()), out["marks"].append(mark[one].tobytes())
                out["counts"].append(np.diff(first).astype(np.int32).tobytes()), out["keys"].append(key[own].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in POSTED)], names=["bucket", *POSTED])

    return run


def marks_of(key: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """128 bits for each of n sets, each gram of a set at the bit of its hash."""
    out = np.zeros((n, 2), U64)
    bit = id_hash(key.view(np.int64)) >> U64(57)
    np.bitwise_or.at(out, (who, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return out


def link(t: float):
    """A bucket of prefix grams: a spanning forest of the documents that share one and may reach t."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[] for _ in POSTED]
        for batch in batches(it):
            for g, name, kind in zip(got, POSTED, (np.int64, np.int32, np.int32, np.uint64, np.int32, np.uint64)):
                g.append(unpack(batch.column(name), kind))
        if not got[0]:
            return
        ids, sizes, shared, marks, counts, keys = map(np.concatenate, got)
        sizes, shared, marks = sizes.astype(np.int64), shared.astype(np.int64), marks.reshape(-1, 2)
        nodes, node = np.unique(ids, return_inverse=True)
        who = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((ids[who], sizes[who], keys))
        who, keys = who[order], keys[order]

        def able(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether sets a may reach t with the sets b, which are as large at least."""
            out = sizes[a] >= need(sizes[b], t)
            differ = np.bitwise_count(marks[a] ^ marks[b]).sum(1, dtype=np.int64)
            return out & ((shared[a] + shared[b] - differ) // 2 >= np.ceil(t / (1 + t) * (sizes[a] + sizes[b]) - 1e-9))

        starts = group_starts(keys)
        size = np.diff(starts)
        same = keys[1:] == keys[:-1]
        alike = np.add.reduceat(np.append(same & able(who[:-1], who[1:]), False).astype(np.int64), starts[:-1])
        chained = (size > LIST) & (2 * alike >= size) | (size > LONGEST)
        chain = same & np.repeat(chained, size)[1:] & (sizes[who[:-1]] >= need(sizes[who[1:]], t))
        held, n = [(node[who[:-1][chain]], node[who[1:][chain]])], int(chain.sum())

        def stars() -> tuple[np.ndarray, np.ndarray]:
            label = local_components(len(nodes), *map(np.concatenate, zip(*held)))
            linked = np.flatnonzero(label != np.arange(len(nodes)))
            return linked, label[linked]

        for a, b in all_pairs(starts[:-1][~chained], size[~chained], PAIRS_HELD):
            a, b = who[a], who[b]
            live = able(a, b)
            held.append((node[a[live]], node[b[live]]))
            n += int(live.sum())
            if n > LINKS_HELD + len(held[0][0]):
                held = [stars()]
                n = len(held[0][0])
        a, b = stars()
        if len(a):
            yield rows(LINKS, a=nodes[a], b=nodes[b])

    return run


class Trie:
    """Path-compressed trie over sorted key arrays: edges hold runs of keys, leaves hold sets."""

    __slots__ = ("keys", "children", "ends", "span")

    def __init__(self, keys: np.ndarray, span: tuple[int, int]):
        self.keys, self.children, self.ends, self.span = keys, [], [], span

    @classmethod
    def build(cls, sets: list[np.ndarray]) -> "Trie":
        """sets must be in lexicographic order, each sorted ascending and distinct."""
        root = cls(np.zeros(0, np.uint64), (0, len(sets)))
        stack: list[tuple[int, int, int, Trie]] = [(0, len(sets), 0, root)]
        while stack:
            lo, hi, depth, node = stack.pop()
            while lo < hi and len(sets[lo]) == depth:
                node.ends.append(lo)
                lo += 1
            while lo < hi:
                head = sets[lo][depth]
                a, b = lo + 1, hi
                while a < b:  # the sets with this next key stand together
                    mid = (a + b) // 2
                    a, b = (mid + 1, b) if sets[mid][depth] == head else (a, mid)
                first, last = sets[lo], sets[a - 1]
                most = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:most] != last[depth:most])
                end = depth + int(differ[0]) if len(differ) else most
                child = cls(first[depth:end], (lo, a))
                node.children.append(child)
                stack.append((lo, a, end, child))
                lo = a
        return root


def join_component(sizes: np.ndarray, sets: list[np.ndarray], t: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of distinct sets at Jaccard t or more, and their overlaps; with sides, of two sides alone.

    sets must be in lexicographic order, each ascending and distinct; sizes: with the grams that nobody shares.
    """
    m = len(sets)
    flat, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    begin = group_starts(flat)
    names = flat[begin[:-1]]
    full = np.asarray(sizes, np.int64)
    trie = Trie.build(sets)
    below: dict[int, tuple[int, int, int]] = {}  # of a subtree: most keys left, least size and greatest size of its sets
    todo = [(trie, False)]
    while todo:
        x, ready = todo.pop()
        if not ready:
            todo.append((x, True))
            todo += [(c, False) for c in x.children]
        else:
            under, ends = [below[id(c)] for c in x.children], full[x.ends].tolist()
            below[id(x)] = (max([0] + [len(c.keys) + u[0] for c, u in zip(x.children, under)]), min(ends + [u[1] for u in under]), max(ends + [u[2] for u in under]))
    left, right, over = [], [], []
    c = t / (1 + t)
    # partners that are still possible, and their overlaps with the path
    stack = [(trie, np.arange(m), np.zeros(m, np.int64))]
    while stack:
        node, alive, overlap = stack.pop()
        for e in node.ends:
            hit = (alive > e) & (overlap >= np.ceil(c * (full[alive] + full[e]) - 1e-9))
            if side is not None:
                hit &= side[alive] != side[e]
            left.append(np.full(int(hit.sum()), e)), right.append(alive[hit]), over.append(overlap[hit])
        for child in node.children:
            at = np.searchsorted(names, child.keys)
            total = overlap + np.bincount(np.concatenate([who[begin[x] : begin[x + 1]] for x in at]), minlength=m)[alive]
            longest, least, most = below[id(child)]
            able = (total + longest >= np.ceil(c * (full[alive] + least) - 1e-9)) & (full[alive] >= t * least - 1e-9) & (full[alive] * t <= most + 1e-9)
            # a pair is found at its first set in order, so partners come after some set of the subtree
            able &= alive > child.span[0]
            if able.any():
                stack.append((child, alive[able], total[able]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), np.concatenate(over or none)


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_links", pa.int64())])
FOUND_SQL = "a long, b long, n_links long"


def walk(t: float, found):
    """Units - components, or pairs of their blocks -, each one after the other, to what found makes of their pairs."""

    def one(across: bool, ids: list[int], sides: list[int], sizes: list[int], keys: list[bytes]) -> pa.RecordBatch | None:
        sets = [np.frombuffer(k, np.uint64) for k in keys]
        # equal shared grams with unshared ones left over are not equal sets
        order = sorted(range(len(ids)), key=lambda x: (sets[x].byteswap().tobytes(), ids[x]))
        heads, full = np.array([ids[x] for x in order], np.int64), np.array([sizes[x] for x in order], np.int64)
        i, j, over = join_component(full, [sets[x] for x in order], t, np.array([sides[x] for x in order]) if across else None)
        return found(heads, full, i, j, over) if len(i) else None

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for batch in batches(it):
            for c, lo, hi, *rest in zip(*(batch.column(x).to_pylist() for x in ("component", "lo", "hi", "doc_id", "block", "size", "keys"))):
                if (c, lo, hi) != now:
                    if len(got) > 1 and (out := one(now[1] != now[2], *zip(*got))):
                        yield out
                    now, got = (c, lo, hi), []
                got.append(rest)
        if len(got) > 1 and (out := one(now[1] != now[2], *zip(*got))):
            yield out

    return run


def links_of(heads: np.ndarray, full: np.ndarray, i: np.ndarray, j: np.ndarray, over: np.ndarray) -> pa.RecordBatch:
    """(a, least set that the unit's links lead to, number of links)."""
    order = np.argsort(heads)
    rank = np.empty(len(heads), np.int64)
    rank[order] = np.arange(len(heads))
    label = local_components(len(heads), rank[i], rank[j])
    n = np.bincount(np.concatenate([rank[i], rank[j]]), minlength=len(heads))
    some = np.flatnonzero(n)
    return rows(FOUND, a=heads[order][some], b=heads[order][label[some]], n_links=n[some])


PAIRS = pa.schema([("doc_id_a", pa.int64()), ("doc_id_b", pa.int64()), ("overlap", pa.int64()), ("jaccard", pa.float64())])


def pairs_of(heads: np.ndarray, full: np.ndarray, i: np.ndarray, j: np.ndarray, over: np.ndarray) -> pa.RecordBatch:
    a, b = heads[i], heads[j]
    return rows(PAIRS, doc_id_a=np.minimum(a, b), doc_id_b=np.maximum(a, b), overlap=over, jaccard=over / (full[i] + full[j] - over))


def _units(docs: DataFrame, n: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sets; the classes of equal sets (print, set_id, n_docs); the units of the join."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("0 < threshold <= 1 and n >= 1")
    parts = min(65536, partitions(docs.sparkSession))
    grams = to_buckets(with_id(docs, F.col("text").cast("string").alias("text")).mapInArrow(spread(n, parts), GRAMS_SQL), parts)
    back = to_buckets(grams.mapInArrow(count_documents(parts), GRAMS_SQL), parts)
    sets = checkpointed(back.mapInArrow(gather(threshold), SETS_SQL))
    copies = sets.groupBy("print", "size").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("n_docs"))
    posted = to_buckets(sets.mapInArrow(prefix_postings(threshold, parts), POSTED_SQL), parts)
    labels = connected_components(posted.mapInArrow(link(threshold), "a long, b long"))
    # the least doc_id of a class is the least of its task as well, so it has a label if the class has one
    heads = checkpointed(copies.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id").select("set_id", "component"))
    blocks = heads.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / block).cast("int").alias("n_blocks"))
    placed = heads.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n_blocks").cast("long")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    units = placed.select("set_id", "component", "block", meets).select("set_id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    units = units.join(sets.select("doc_id", "size", "keys"), F.col("set_id") == F.col("doc_id")).repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "doc_id")
    return sets, copies, units.select("component", "lo", "hi", "doc_id", "block", "size", "keys")


def jaccard_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, block: int = BLOCK) -> DataFrame:
    """doc_id_a < doc_id_b, overlap and jaccard of all pairs of different sets, each by its least doc_id."""
    return _units(docs, n, threshold, block)[2].mapInArrow(walk(threshold, pairs_of), "doc_id_a long, doc_id_b long, overlap long, jaccard double")


def jaccard_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, set_id, n_links and n_copies of every document that has a link or a copy.

    class_id is the least doc_id that links and copies lead to, set_id the least with an equal set; n_links counts
    the different sets at the threshold or above, n_copies the other documents with an equal set.
    """
    sets, copies, units = _units(docs, n, threshold, block)
    found = checkpointed(units.mapInArrow(walk(threshold, links_of), FOUND_SQL))
    links = found.groupBy("a").agg(F.sum("n_links").alias("n_links"))
    labels = connected_components(found.select("a", "b"))
    classes = links.join(labels.select(F.col("node").alias("a"), "component"), "a").withColumnRenamed("a", "set_id")
    known = copies.join(classes, "set_id", "left").where("n_docs > 1 OR n_links IS NOT NULL")
    known = known.select(F.col("print").alias("p"), F.col("size").alias("s"), "set_id", F.coalesce("component", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.col("n_docs") - 1).alias("n_copies"))
    return sets.select("doc_id", "print", "size").join(known, (F.col("print") == F.col("p")) & (F.col("size") == F.col("s"))).select("doc_id", "class_id", "set_id", "n_links", "n_copies")


def drop_near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """docs without the documents of each class but its least doc_id; rows without a doc_id stay."""
    gone = jaccard_classes(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
