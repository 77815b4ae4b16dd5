"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text (a window of 16 bytes, computed for all bytes at once by
doubling).  A chunk ends where the hash has five leading zero bits, at 16 bytes or more, and at 256 bytes at
the latest, so the chunks are 48 bytes long on average and an insertion moves the cuts next to it alone.
Chunks are known by a 96-bit digest; those that several documents hold are duplicates, all but the first
(least doc_id, then offset).  Neighbouring duplicates join into spans; all are reported, or those of
min_span bytes or more if the caller sets that.

Defined results: rows without doc_id or text have no chunks; an empty text has none; a text shorter than the
least chunk is one chunk.  Rows that repeat a doc_id are one document, so a repeated row alone is no duplicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_hash, partitions, rows, split_by, to_buckets, with_id
from .textkit import GEAR, blocks, group_starts, mix, powers, string_buffers

U64 = np.uint64
WINDOW, LEAST, MOST, ZEROS = 16, 16, 256, 5
GEAR2 = mix(GEAR)
CHUNKS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("digests", pa.binary()), ("checks", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary())])
CHUNKS_SQL = "bucket int, ids binary, counts binary, digests binary, checks binary, starts binary, sizes binary"
REPEATS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("heads", pa.binary()), ("holders", pa.binary())])
REPEATS_SQL = "bucket int, ids binary, starts binary, sizes binary, heads binary, holders binary"
SPANS = pa.schema([("doc_id", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("n_chunks", pa.int64()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("is_first", pa.bool_())])
SPANS_SQL = "doc_id long, byte_start long, byte_end long, n_chunks long, first_doc_id long, n_docs long, is_first boolean"
HELD = 1_500_000


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash over the last WINDOW bytes at each byte."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        nxt = h.copy()
        nxt[span:] += h[:-span] << U64(span) if span < len(h) else U64(0)
        h, span = nxt, span * 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts laid end to end; offsets: where each text begins, and the end."""
    marks = (np.flatnonzero(gear_hash(data) << U64(1) >> U64(64 - ZEROS) == 0) + 1).tolist()
    out, k, n = [], 0, len(marks)
    bounds = offsets.tolist()
    for begin, end in zip(bounds, bounds[1:]):
        last = begin
        while k < n and marks[k] <= begin:
            k += 1
        while k < n and marks[k] < end:
            m = marks[k]
            while m - last > MOST:
                last += MOST
                out.append(last)
            if m - last >= LEAST:
                out.append(m)
                last = m
            k += 1
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
    return np.array(out, np.int64)


def chunk_batch(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the text, size, digest, check) of the chunks of a text column, block by block."""
    data, offsets = string_buffers(column)
    for lo, hi in blocks(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(part):
            continue
        end = cuts(part, off)
        row = np.searchsorted(off, end, "left") - 1
        start = np.append(0, end[:-1])
        p, q = powers(len(part) + 1)
        found = []
        for table in (GEAR, GEAR2):
            s = np.zeros(len(part) + 1, U64)
            np.cumsum(table[part] * p[: len(part)], out=s[1:])
            found.append(mix((s[end] - s[start]) * q[start] + (end - start).astype(U64)))
        yield row + lo, start - off[row], end - start, found[0], (found[1] >> U64(32)).astype(np.uint32)


def chunk(parts: int):
    def emit(ids, starts, sizes, digests, checks) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in CHUNKS}
        order, at = split_by((digests & U64(0xFFFFFF)) % U64(parts), parts)
        for b in np.flatnonzero(np.diff(at)):
            own = order[at[b] : at[b + 1]]
            run = group_starts(ids[own])
            out["bucket"].append(int(b))
            out["ids"].append(np.diff(ids[own][run[:-1]], prepend=0).tobytes()), out["counts"].append(np.diff(run).astype(np.uint32).tobytes())
            out["digests"].append(digests[own].tobytes()), out["checks"].append(checks[own].tobytes())
            out["starts"].append(starts[own].astype(np.uint32).tobytes()), out["sizes"].append(sizes[own].astype(np.uint16).tobytes())
        yield rows(CHUNKS, **out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches(it):
            own = batch.column(0).to_numpy()
            for row, *rest in chunk_batch(batch.column(1)):
                held.append((own[row], *rest))
                n += len(row)
                if n >= HELD:
                    yield from emit(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield from emit(*map(np.concatenate, zip(*held)))

    return run


def repeated(parts: int):
    """A digest bucket: chunks that several documents hold, sent to the documents' buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {k: [] for k in ("doc", "digests", "checks", "starts", "sizes")}
        for batch in batches(it):
            for i, c, d, k, s, z in zip(*(batch.column(x).to_pylist() for x in CHUNKS.names[1:])):
                got["doc"].append(np.repeat(np.cumsum(np.frombuffer(i, np.int64)), np.frombuffer(c, np.uint32)))
                got["digests"].append(np.frombuffer(d, np.uint64)), got["checks"].append(np.frombuffer(k, np.uint32))
                got["starts"].append(np.frombuffer(s, np.uint32)), got["sizes"].append(np.frombuffer(z, np.uint16))
        if not got["doc"]:
            return
        doc, digest, check, start, size = (np.concatenate(v) for v in got.values())
        order = np.argsort(digest)
        runs = group_starts(digest[order])
        order = order[np.repeat(np.diff(runs) > 1, np.diff(runs))]
        order = order[np.lexsort((start[order], doc[order], check[order], size[order], digest[order]))]
        doc, digest, check, start, size = doc[order], digest[order], check[order], start[order], size[order]
        if not len(doc):
            return
        new = np.ones(len(doc), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (check[1:] != check[:-1]) | (size[1:] != size[:-1])
        runs = np.append(np.flatnonzero(new), len(doc))
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        holders = np.repeat(np.add.reduceat(fresh.astype(np.int64), runs[:-1]), np.diff(runs))
        head = np.repeat(doc[runs[:-1]], np.diff(runs))
        keep = holders > 1
        doc, start, size, head, holders = doc[keep], start[keep], size[keep], head[keep], holders[keep]
        order, at = split_by(id_hash(doc) % U64(parts), parts)
        out: dict[str, list] = {f.name: [] for f in REPEATS}
        for b in np.flatnonzero(np.diff(at)):
            own = order[at[b] : at[b + 1]]
            out["bucket"].append(int(b)), out["ids"].append(doc[own].tobytes()), out["starts"].append(start[own].tobytes())
            out["sizes"].append(size[own].tobytes()), out["heads"].append(head[own].tobytes()), out["holders"].append(holders[own].astype(np.int64).tobytes())
        if out["bucket"]:
            yield rows(REPEATS, **out)

    return run


def spans(min_span: int):
    """A document bucket: runs of neighbouring repeated chunks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[] for _ in range(5)]
        for batch in batches(it):
            for k, (name, kind) in enumerate((("ids", np.int64), ("starts", np.uint32), ("sizes", np.uint16), ("heads", np.int64), ("holders", np.int64))):
                got[k] += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
        if not got[0]:
            return
        doc, start, size, head, holders = (np.concatenate(v) for v in got)
        start, end = start.astype(np.int64), start.astype(np.int64) + size
        order = np.lexsort((end, start, doc))
        doc, start, end, head, holders = doc[order], start[order], end[order], head[order], holders[order]
        new = np.ones(len(doc), bool)
        # the first holder's copy stays: it is a span of its own kind
        kept = head == doc
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]) | (kept[1:] != kept[:-1])
        run_ = np.append(np.flatnonzero(new), len(doc))
        lo, hi = start[run_[:-1]], np.maximum.reduceat(end, run_[:-1])
        far = hi - lo >= min_span
        at = run_[:-1][far]
        if far.any():
            yield rows(
                SPANS, doc_id=doc[at], byte_start=lo[far], byte_end=hi[far], n_chunks=np.diff(run_)[far],
                first_doc_id=np.minimum.reduceat(head, run_[:-1])[far], n_docs=np.maximum.reduceat(holders, run_[:-1])[far], is_first=kept[at],
            )

    return run


def duplicate_spans(docs: DataFrame, min_span: int = 0) -> DataFrame:
    """doc_id, byte_start, byte_end, n_chunks, first_doc_id, n_docs and is_first of every repeated span.

    is_first marks the copy that deduplication keeps.
    """
    parts = min(65536, partitions(docs.sparkSession))
    chunks = to_buckets(with_id(docs, F.col("text").cast("string").alias("text")).mapInArrow(chunk(parts), CHUNKS_SQL), parts)
    return to_buckets(chunks.mapInArrow(repeated(parts), REPEATS_SQL), parts).mapInArrow(spans(min_span), SPANS_SQL)
