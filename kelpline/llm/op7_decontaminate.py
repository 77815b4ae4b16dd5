"""Benchmark decontamination with an FM-index per training shard.

The words of a shard (whole documents, about SHARD words) become symbols of the benchmark's own alphabet; a
run of words that no benchmark item has is one separator, as nothing can match across it.  The shard is
suffix-sorted and indexed; every phrase of the benchmark (each run of n words of an item, or the whole of a
shorter item) is searched backwards through the wavelet ranks, its occurrences located by sampled suffix
positions, and overlapping or touching occurrences merged into removal spans.

Phrases go to the executors in slices of at most max_phrases, whatever the benchmark's size; several slices
are searched one after the other in the same texts, each row carries what they found, and the occurrences of
all slices are merged together, so the result is that of one slice.

Defined results: items and documents without text, or without words, match nothing; spans of rows that
repeat are reported for each row; rows without a doc_id give no spans, and are cleaned all the same by
remove_leaks.  Spans count words of the lower-cased text from 0, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, rows, tidy, with_id
from .fm_index import FMIndex
from .textkit import WORD_PATTERN, group_starts, words

SHARD = 750_000
MAX_PHRASES = 2_000_000
_WORD = re.compile(WORD_PATTERN)


@dataclass
class Phrases:
    """Benchmark phrases as symbols: 2, 3, ... for words, 1 for a separator; by length."""

    names: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray]]  # patterns, and pairs (pattern, item)

    @classmethod
    def build(cls, items: list[np.ndarray], n: int) -> "Phrases":
        names = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, h in enumerate(items):
            s = np.searchsorted(names, h) + 2
            size = min(n, len(s))
            if size:
                found.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(s, size), k))
        out = []
        for size, parts in sorted(found.items()):
            patterns, index = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            owner = np.repeat([k for _, k in parts], [len(p) for p, _ in parts])
            out.append((patterns, np.unique(np.stack([index.ravel(), owner], 1), axis=0)))
        return cls(names, out)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """2, 3, ... of known words and 1 of others."""
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << 22, bool)
            self._table[self.names >> np.uint64(42)] = True
        out = np.ones(len(h), np.int64)
        maybe = np.flatnonzero(self._table[h >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.names, h[maybe]), len(self.names) - 1)
        ok = self.names[at] == h[maybe]
        out[maybe[ok]] = at[ok] + 2
        return out


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for w in words(pa.array(texts, pa.large_string())):
        h = w.hash()
        out += [h[w.first[i] : w.first[i + 1]] for i in range(w.hi - w.lo)]
    return out


def phrase_slices(benchmark: DataFrame, n: int, max_phrases: int) -> Iterator[Phrases]:
    """The benchmark's phrases, at most max_phrases (or one item) at a time; the driver holds one slice."""
    held, size = [], 0
    for r in benchmark.select(F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator(prefetchPartitions=True):
        h = item_words([r[0]])[0]
        if held and size + len(h) > max_phrases:
            yield Phrases.build(held, n)
            held, size = [], 0
        held.append(h)
        size += len(h)
    if held:
        yield Phrases.build(held, n)


def search_shard(sym: np.ndarray, row: np.ndarray, word: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """Occurrences in a shard: row, first word, length, item."""
    # separators: between documents, and in place of each run of unknown words
    cut = np.flatnonzero(row[1:] != row[:-1]) + 1
    sym, place = np.insert(sym, cut, 1), np.insert(np.arange(len(sym)), cut, -1)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1)
    sym, place = sym[keep], place[keep]
    index = FMIndex(sym, len(phrases.names) + 2)
    out = [np.zeros((0, 4), np.int64)]
    for patterns, owners in phrases.by_length:
        lo, hi = index.search(patterns)
        count = hi - lo
        which = np.repeat(np.arange(len(patterns)), count)
        if not len(which):
            continue
        rows_ = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        at = place[index.locate(rows_)]
        # every item of a phrase
        first = np.searchsorted(owners[:, 0], np.arange(len(patterns) + 1))
        times = np.diff(first)[which]
        each = np.repeat(np.arange(len(which)), times)
        item = owners[np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + first[which[each]], 1]
        out.append(np.stack([row[at[each]], word[at[each]], np.full(len(each), patterns.shape[1]), item], 1))
    return tuple(np.concatenate(out).T)


def merge(row: np.ndarray, first: np.ndarray, length: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Overlapping or touching occurrences of a row as (row, first, end, number of items)."""
    order = np.lexsort((first, row))
    out: list[tuple[int, int, int, int]] = []
    now, lo, hi, items = -1, 0, 0, set()
    for r, f, n, k in zip(row[order].tolist(), first[order].tolist(), length[order].tolist(), item[order].tolist()):
        if r == now and f <= hi:
            hi = max(hi, f + n)
            items.add(k)
        else:
            if items:
                out.append((now, lo, hi, len(items)))
            now, lo, hi, items = r, f, f + n, {k}
    if items:
        out.append((now, lo, hi, len(items)))
    return out


def occurrences(column: pa.Array, phrases: Phrases) -> Iterator[tuple[np.ndarray, ...]]:
    """Occurrences in a batch of texts, shard by shard."""
    sym, row, word, held = [], [], [], 0
    if not len(phrases.names):
        return
    for w in words(column):
        sym.append(phrases.symbols(w.hash()))
        row.append(w.row + w.lo)
        word.append(np.arange(len(w.row)) - w.first[w.row])
        held += len(w.row)
        if held >= SHARD:
            yield search_shard(np.concatenate(sym), np.concatenate(row), np.concatenate(word), phrases)
            sym, row, word, held = [], [], [], 0
    if held:
        yield search_shard(np.concatenate(sym), np.concatenate(row), np.concatenate(word), phrases)


def leaks(column: pa.Array, phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """Spans of a batch of texts."""
    return [span for found in occurrences(column, phrases) for span in merge(*found)]


def with_occurrences(df: DataFrame, slices: list[Phrases], where: int) -> DataFrame:
    """df and, as its last column, the packed occurrences (first word, length, item) of all slices in column where."""
    name = "_leaks"
    while name in df.columns:
        name += "_"
    out = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    df = df.withColumn(name, F.lit(b""))
    for number, phrases in enumerate(slices):

        def run(it: Iterator[pa.RecordBatch], phrases=phrases, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches(it):
                held = batch.column(batch.num_columns - 1).to_pylist()
                for row, first, length, item in occurrences(batch.column(where), phrases):
                    order = np.argsort(row, kind="stable")
                    packed = np.stack([first, length, item + (number << 32)], 1).astype(np.int64)[order]
                    starts = group_starts(row[order])
                    for r, lo, hi in zip(row[order][starts[:-1]].tolist() if len(row) else [], starts, starts[1:]):
                        held[r] += packed[lo:hi].tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, batch.schema.types[-1])], schema=batch.schema)

        df = df.mapInArrow(run, out)
    return df


def carried(batch: pa.RecordBatch) -> list[tuple[int, int, int, int]]:
    """Spans of a batch of with_occurrences."""
    held = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column(batch.num_columns - 1).to_pylist()]
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    return merge(row, *np.concatenate(held).T)


SPANS = pa.schema([("doc_id", pa.int64()), ("word_start", pa.int64()), ("word_end", pa.int64()), ("n_items", pa.int64())])
SPANS_SQL = "doc_id long, word_start long, word_end long, n_items long"


def leak_spans(docs: DataFrame, benchmark: DataFrame, n: int = 8, max_phrases: int = MAX_PHRASES) -> DataFrame:
    """doc_id, word_start, word_end and n_items (benchmark items it has phrases of) of every removal span."""
    texts = with_id(docs, F.col("text").cast("string").alias("text"))
    slices = list(phrase_slices(benchmark, n, max_phrases))
    if not slices:
        return docs.sparkSession.createDataFrame([], SPANS_SQL)
    if len(slices) > 1:
        texts, spans = with_occurrences(texts, slices, 1), carried
    else:
        spans = lambda batch: leaks(batch.column(1), slices[0])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            if found := spans(batch):
                r, a, b, k = zip(*found)
                yield rows(SPANS, doc_id=batch.column(0).take(pa.array(r)), word_start=a, word_end=b, n_items=k)

    return texts.mapInArrow(run, SPANS_SQL)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans of words; what stood around a span stays."""
    place = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : place[lo][0]])
        at = place[hi - 1][1]
    return "".join(out) + text[at:]


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 8, max_phrases: int = MAX_PHRASES) -> DataFrame:
    """docs with the spans cut out of text, and n_chars, if there is one, counted again in rows that changed."""
    where = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    slices = list(phrase_slices(benchmark, n, max_phrases))
    if not slices:
        return docs
    schema, width, several = docs.schema, len(docs.columns), len(slices) > 1
    if several:
        docs, found = with_occurrences(docs, slices, where), carried
    else:
        found = lambda batch: leaks(batch.column(where), slices[0])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            spans: dict[int, list[tuple[int, int]]] = {}
            for r, a, b, _ in found(batch):
                spans.setdefault(r, []).append((a, b))
            if spans or several:
                columns, fields = list(batch.columns[:width]), list(batch.schema)[:width]
                if spans:
                    own = np.array(sorted(spans))
                    text = [cut(columns[where][r].as_py(), spans[r]) for r in own.tolist()]
                    mask = np.zeros(batch.num_rows, bool)
                    mask[own] = True
                    columns[where] = pc.replace_with_mask(columns[where], pa.array(mask), pa.array(text, columns[where].type))
                    if count >= 0:
                        columns[count] = pc.replace_with_mask(columns[count], pa.array(mask), pa.array([len(t) for t in text], columns[count].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
            yield batch

    return docs.mapInArrow(run, schema)
