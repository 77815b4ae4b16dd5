"""Token ids of whole texts in Simple-8b blocks.

Texts are cut into the pieces of the byte-level vocabulary's pattern with table lookups over code points, each
distinct piece is encoded once by the public tokenizer, and the ids of a document are coded in blocks of 128
values with the word offset of each block, so that any block can be decoded alone and in vector form.

Defined results: a null or empty text has no tokens, an empty payload and no blocks; rows without a doc_id are
coded too; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, rows
from .simple8b import BLOCK, encode
from .textkit import blocks, mix, string_buffers

U64 = np.uint64
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("block_offsets", pa.list_(pa.int32())), ("payload", pa.binary())])
CODED_SQL = "doc_id long, n_tokens long, block_offsets array<int>, payload binary"


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point under the pattern: white space, letter, number or other."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "?" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pieces(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; code: code points, offsets: where the texts begin, and the end.

    Texts with an apostrophe before one of the contractions' letters are not for this function.
    """
    n = len(code)
    kind = classes()[code]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begin |= fresh[:n]
    # the last white space of a run before other text: a blank joins that text, anything else stands alone
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE)
    last &= ~fresh[1:]
    begin[last] = True
    joins = np.flatnonzero(last & (code == 32))
    begin[joins + 1] = False
    return np.flatnonzero(begin)


class Encoder:
    """Ids of batches of texts, with each distinct piece encoded once."""

    def __init__(self, path: str, keep: int = 1_000_000):
        self.bpe, self.keep = tokenizer(path), keep
        self.names, self.at, self.size, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, names: np.ndarray, texts: list[str]) -> None:
        got = [self.bpe.encode_ordinary(t) for t in texts]
        size = np.array([len(g) for g in got], np.int64)
        if len(self.names) + len(names) > self.keep:  # the memory is bounded; what was left out is encoded again
            self.names, self.at, self.size, self.ids = self.names[:0], self.at[:0], self.size[:0], self.ids[:0]
        at = len(self.ids) + np.cumsum(size) - size
        every = np.concatenate([self.names, names])
        order = np.argsort(every)
        self.names = every[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, np.fromiter((x for g in got for x in g), np.int64, int(size.sum()))])

    def encode(self, texts: list[str], code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        start = pieces(code, offsets)
        key = piece_hash(code, start)
        names, first, index = np.unique(key, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        new = np.flatnonzero(self.names[place] != names) if len(self.names) else np.arange(len(names))
        if len(new):
            stop = np.append(start[1:], len(code))
            keep = len(self.names)
            raw = code.astype("<u4").tobytes()
            cut = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())]
            if keep + len(new) > self.keep:
                cut = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start[first].tolist(), stop[first].tolist())]
                self.learn(names, cut)
            else:
                self.learn(names[new], cut)
            place = np.searchsorted(self.names, names)
        size, at = self.size[place][index], self.at[place][index]
        total = np.cumsum(size)
        take = np.arange(int(total[-1])) - np.repeat(total - size, size) + np.repeat(at, size)
        begin = np.append(0, total)[np.searchsorted(start, offsets)]
        return self.ids[take], begin


def piece_hash(code: np.ndarray, start: np.ndarray) -> np.ndarray:
    from .textkit import powers

    p, q = powers(len(code) + 1)
    s = np.zeros(len(code) + 1, U64)
    np.cumsum(mix(code.astype(U64) + U64(1)) * p[: len(code)], out=s[1:])
    stop = np.append(start[1:], len(code))
    return mix((s[stop] - s[start]) * q[start] + (stop - start).astype(U64))


def encode_column(column: pa.Array, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, where each row's ids begin) of a text column, block by block."""
    data, offsets = string_buffers(column)
    apostrophe = 39
    for lo, hi in blocks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        code = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)  # the first byte of each character
        chars = np.searchsorted(lead, offsets[lo : hi + 1] - offsets[lo])
        odd = np.unique(np.searchsorted(chars, np.flatnonzero(code == apostrophe), "right") - 1)
        ids, begin = encoder.encode([], code, chars)
        if len(odd):  # contractions: these texts go through the tokenizer whole
            cut = [ids[begin[i] : begin[i + 1]] for i in range(hi - lo)]
            for i in odd.tolist():
                cut[i] = np.array(encoder.bpe.encode_ordinary(bytes(part[offsets[lo + i] - offsets[lo] : offsets[lo + i + 1] - offsets[lo]]).decode("utf-8")), np.int64)
            ids, begin = np.concatenate(cut), np.append(0, np.cumsum([len(c) for c in cut]))
        yield lo, hi, ids, begin


def code_documents(ids: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Payload and block offsets of each document."""
    size = np.diff(begin)
    n_blocks = -(-size // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    doc = np.repeat(np.arange(len(size)), n_blocks)
    starts = np.append(begin[doc] + (np.arange(len(doc)) - first[doc]) * BLOCK, begin[-1])
    words, at = encode(ids, starts)
    payload, offsets = [], []
    for f, n in zip(first.tolist(), n_blocks.tolist()):
        o = at[f : f + n + 1]
        payload.append(words[o[0] : o[-1]].tobytes() if n else b"")
        offsets.append((o - o[0]).astype(np.int32) if n else np.zeros(1, np.int32))
    return payload, offsets


def token_binary(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, block_offsets (in 64-bit words, the end included) and payload of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches(it):
            for lo, hi, ids, begin in encode_column(batch.column(1), encoder):
                payload, offsets = code_documents(ids, begin)
                yield rows(CODED, doc_id=batch.column(0)[lo:hi], n_tokens=np.diff(begin), block_offsets=offsets, payload=payload)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED_SQL)
