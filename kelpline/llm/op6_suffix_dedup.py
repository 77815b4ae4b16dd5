"""Suffix-array deduplication: runs of LENGTH words or more that several documents share.

1. Anchors: word 10-grams winnowed so that every run of LENGTH words holds one.  Those of one document leave.
2. Round each anchor left, a slice holds all runs of LENGTH words that contain it.  Slices meet by anchor.
3. The suffixes at the anchors are sorted deep-shallow (multikey quicksort, then blind tries), and so are the
   reversed texts before them.  In every interval of suffixes that share r words, neighbours in the order of
   the reversed texts share the most words to the left; r and these reach LENGTH for all repeats, and only
   for these, so the union of the spans found covers exactly the repeated runs.
4. Spans return to their documents and are merged.

Defined results: rows without doc_id or text have no words; texts of fewer than LENGTH words have no span.
Repeats within a document alone, and rows that repeat a doc_id, do not count.  Words are compared by 32-bit
hashes in slices, so a false repeat needs LENGTH such collisions in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_hash, partitions, rows, split_by, to_buckets, with_id
from .deep_shallow import prefix, sort_rows
from .textkit import group_starts, ngrams, winnow, words

U64 = np.uint64
ANCHOR = 10
PACK = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("keys", pa.binary())])
PACK_SQL = "bucket int, ids binary, places binary, keys binary"
SLICES = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("symbols", pa.binary())])
SLICES_SQL = PACK_SQL + ", symbols binary"
SPANS = pa.schema([("doc_id", pa.int64()), ("word_start", pa.int64()), ("word_end", pa.int64())])
SPANS_SQL = "doc_id long, word_start long, word_end long"
HELD = 1_000_000


def send(parts: int, home: np.ndarray, schema: pa.Schema, **columns: np.ndarray) -> pa.RecordBatch:
    order, at = split_by(home, parts)
    out: dict[str, list] = {f.name: [] for f in schema}
    for b in np.flatnonzero(np.diff(at)):
        own = order[at[b] : at[b + 1]]
        out["bucket"].append(int(b))
        for k, v in columns.items():
            out[k].append(v[own].tobytes())
    return rows(schema, **out)


def read(it: Iterator[pa.RecordBatch], **kinds) -> tuple[np.ndarray, ...] | None:
    got: dict[str, list] = {k: [] for k in kinds}
    for batch in batches(it):
        for k, kind in kinds.items():
            got[k] += [np.frombuffer(x, kind) for x in batch.column(k).to_pylist()]
    return tuple(map(np.concatenate, got.values())) if next(iter(got.values())) else None


def anchors_of(w, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word within the row and key of the anchors of a block."""
    g, at = ngrams(w.hash(), w.row, ANCHOR)
    pick = winnow(g, w.row[at], length - ANCHOR + 1)
    row = w.row[at[pick]]
    return row, at[pick] - w.first[row], g[pick]


def anchors(parts: int, length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            ids, places, keys = map(np.concatenate, zip(*held))
            return send(parts, (keys & U64(0xFFFFFF)) % U64(parts), PACK, ids=ids, places=places.astype(np.uint32), keys=keys)

        for batch in batches(it):
            own = batch.column(0).to_numpy()
            for w in words(batch.column(1)):
                row, place, key = anchors_of(w, length)
                held.append((own[row + w.lo], place, key))
                n += len(row)
                if n >= HELD:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def shared(parts: int):
    """An anchor bucket: anchors that several documents hold, sent to the documents' buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := read(it, ids=np.int64, places=np.uint32, keys=np.uint64)) is None:
            return
        ids, places, keys = got
        order = np.lexsort((ids, keys))
        ids, places, keys = ids[order], places[order], keys[order]
        runs = group_starts(keys)
        if len(keys):
            keep = np.repeat(ids[runs[:-1]] != ids[runs[1:] - 1], np.diff(runs))
            ids, places, keys = ids[keep], places[keep], keys[keep]
        if len(ids):
            yield send(parts, id_hash(ids) % U64(parts), PACK, ids=ids, places=places, keys=keys)

    return run


def by_document(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document bucket: one row a document, with its shared anchors."""
    if (got := read(it, ids=np.int64, places=np.uint32, keys=np.uint64)) is None:
        return
    ids, places, keys = got
    order = np.lexsort((places, ids))
    ids, places, keys = ids[order], places[order], keys[order]
    runs = group_starts(ids)
    for lo in range(0, len(runs) - 1, 4096):
        some = range(lo, min(lo + 4096, len(runs) - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[runs[[*some]]], pa.int64()), *(pa.array([v[runs[i] : runs[i + 1]].tobytes() for i in some], pa.binary()) for v in (places, keys))],
            names=["anchor_doc", "places", "keys"],
        )


def slices(parts: int, length: int):
    """Texts with their shared anchors to slices of 2 * length - ANCHOR words, 0 beyond the text's ends."""
    left, width = length - ANCHOR, 2 * length - ANCHOR

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            doc = batch.column("doc_id").to_numpy()
            place = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column("places").to_pylist()]
            key = [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            for w in words(batch.column("text")):
                n = np.array([len(p) for p in place[w.lo : w.hi]])
                row = np.repeat(np.arange(w.hi - w.lo), n)
                if not len(row):
                    continue
                p, k = np.concatenate(place[w.lo : w.hi]), np.concatenate(key[w.lo : w.hi])
                size = np.diff(w.first)[row]
                ok = p + ANCHOR <= size  # rows that repeat a doc_id with another text
                row, p, k = row[ok], p[ok], k[ok]
                symbols = (w.hash() >> U64(32)).astype(np.uint32)
                symbols = np.maximum(symbols, 1)
                at = w.first[row] + p
                for lo in range(0, len(row), 1 << 14):
                    r, a = row[lo : lo + (1 << 14)], at[lo : lo + (1 << 14)]
                    index = a[:, None] + np.arange(-left, width - left)
                    inside = (index >= w.first[r][:, None]) & (index < w.first[r + 1][:, None])
                    cut = np.where(inside, symbols[np.clip(index, 0, len(symbols) - 1)], np.uint32(0))
                    kk = k[lo : lo + (1 << 14)]
                    yield send(parts, (kk & U64(0xFFFFFF)) % U64(parts), SLICES, ids=doc[w.lo + r], places=p[lo : lo + (1 << 14)].astype(np.uint32), keys=kk, symbols=cut)

    return run


def repeats(doc: np.ndarray, key: np.ndarray, symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left and, anchor included, to the right of each anchor that are in a shared run; 0, 0 if none."""
    left = length - ANCHOR
    n = len(doc)
    # beyond a text's end nothing is equal, not even to another end: each row has its own symbol there
    own = (np.arange(n, dtype=np.uint64)[:, None] + np.uint64(1 << 32)) * np.ones((1, symbols.shape[1]), np.uint64)
    text = np.where(symbols == 0, own, symbols.astype(np.uint64))
    right, back = np.ascontiguousarray(text[:, left:]), np.ascontiguousarray(text[:, :left][:, ::-1])
    _, group = np.unique(key, return_inverse=True)
    order, common = sort_rows(right, group)
    by_left, _ = sort_rows(back, group)
    left_rank = np.empty(n, np.int64)
    left_rank[by_left] = np.arange(n)
    most_left, most_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in np.unique(common[common >= ANCHOR])[::-1].tolist():
        # intervals of suffixes that share r words
        interval = np.cumsum(common < r)
        size = np.bincount(interval)
        live = size[interval] > 1
        who, interval = order[live], interval[live]
        by = np.lexsort((doc[who], left_rank[who], interval))
        who, interval = who[by], interval[by]
        m = len(who)
        fresh = np.ones(m, bool)
        fresh[1:] = (interval[1:] != interval[:-1]) | (doc[who][1:] != doc[who][:-1])
        starts = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        before, after = starts[of] - 1, np.append(starts[1:], m)[of]
        for other in (before, after):
            ok = np.flatnonzero((other >= 0) & (other < m))
            ok = ok[interval[other[ok]] == interval[ok]]
            if not len(ok):
                continue
            shared_left = prefix(back, who[ok], who[other[ok]])
            hit = shared_left + r >= length
            rows_ = who[ok[hit]]
            most_left[rows_] = np.maximum(most_left[rows_], shared_left[hit])
            most_right[rows_] = np.maximum(most_right[rows_], r)
    return most_left, most_right


def find(parts: int, length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := read(it, ids=np.int64, places=np.uint32, keys=np.uint64, symbols=np.uint32)) is None:
            return
        doc, place, key, symbols = got
        symbols = symbols.reshape(len(doc), -1)
        order = np.argsort(key, kind="stable")
        runs = group_starts(key[order])
        at = 0
        while at < len(runs) - 1:  # whole groups, some 50,000 slices at a time
            end = max(at + 1, int(np.searchsorted(runs, runs[at] + 50_000, "right")) - 1)
            some = order[runs[at] : runs[end]]
            lo, hi = repeats(doc[some], key[some], symbols[some], length)
            hit = hi > 0
            if hit.any():
                ids, p = doc[some][hit], place[some][hit].astype(np.int64)
                yield send(parts, id_hash(ids) % U64(parts), PACK, ids=ids, places=(p - lo[hit]).astype(np.uint32), keys=(p + hi[hit]).astype(np.uint64))
            at = end

    return run


def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document bucket: overlapping or touching spans as one."""
    if (got := read(it, ids=np.int64, places=np.uint32, keys=np.uint64)) is None:
        return
    ids, lo, hi = got[0], got[1].astype(np.int64), got[2].astype(np.int64)
    order = np.lexsort((hi, lo, ids))
    ids, lo, hi = ids[order], lo[order], hi[order]
    # one running maximum serves all documents: each one's words are moved beyond the last one's
    shift = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(ids), bool)
    new[1:] = (lo + shift)[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    yield rows(SPANS, doc_id=ids[starts], word_start=lo[starts], word_end=np.maximum.reduceat(hi, starts))


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, word_start and word_end (exclusive) of the runs of words that documents share, merged per document."""
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} or more")
    parts = min(65536, partitions(docs.sparkSession))
    texts = with_id(docs, F.col("text").cast("string").alias("text"))
    found = to_buckets(texts.mapInArrow(anchors(parts, length), PACK_SQL), parts)
    back = to_buckets(found.mapInArrow(shared(parts), PACK_SQL), parts)
    wanted = back.mapInArrow(by_document, "anchor_doc long, places binary, keys binary")
    joined = texts.join(wanted, F.col("doc_id") == F.col("anchor_doc")).select("doc_id", "text", "places", "keys")
    cut = to_buckets(joined.mapInArrow(slices(parts, length), SLICES_SQL), parts)
    return to_buckets(cut.mapInArrow(find(parts, length), PACK_SQL), parts).mapInArrow(merged, SPANS_SQL)
