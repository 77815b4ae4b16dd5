"""Brown class-based bigram model: exchange clustering, class transitions, word emissions, smoothed perplexity.

1. Texts become blocks of word numbers with the block's vocabulary, written once.
2. The first classes: the core_words most frequent words are clustered by exchange one after the other on the
   driver, until none moves, from their bigrams in the whole corpus; every other word goes to the class that its
   neighbours in the core make best, or, without one, to the most frequent class.
3. Then all words of the corpus, the core's included, are exchanged in rounds: blocks count the neighbours of each word
   by side and class, over all bigrams; word buckets add these up, take the word out of its class and put
   it where the likelihood of the class bigrams gains most.  The words of a round move at once.
   A round that lowers the likelihood is taken back, and from then on halves of the words take turns.  The rounds end when none
   moves or when one (of halves: two in a row) raises the likelihood by less than `settle` a word.
4. Transitions P(class | class before) are counted over all words and smoothed with the class unigrams;
   emissions P(word | class) are the word's share of its class, with one more word kept for unseen ones.
5. Each document gets the perplexity of its words under P(class | class before) * P(word | class).

Words move between blocks and word buckets by 64-bit hashes; everything counted follows the corpus, and only
the class tables, of fixed size, go to all tasks.

Defined results: a null or empty text, or one without words, has n_words 0 and a null perplexity; rows without a
doc_id count in the model and get no score; repeated rows count, and are scored, each for itself; a text of any length
is scored whole; an empty table has no result.  Ties: a word stays, or goes to the least of the best classes; words as
frequent as others come by their hashes.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpointed, let_go, partitions, rows, split_by, to_buckets
from .textkit import group_starts, words

U64 = np.uint64
BLOCK_WORDS = 1_500_000
BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("vocabulary", pa.binary()), ("counts", pa.binary()), ("buckets", pa.binary())])
BLOCKS_SQL = "block long, ids binary, known binary, sizes binary, tokens binary, vocabulary binary, counts binary, buckets binary"
COUNTS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTS_SQL = "bucket int, keys binary, counts binary"
CONTEXTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("times", pa.binary())])
CONTEXTS_SQL = "bucket int, block long, keys binary, counts binary, sizes binary, codes binary, times binary"
MOVES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("numbers", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("times", pa.binary()), ("sums", pa.binary())])
MOVES_SQL = "bucket int, block long, numbers binary, classes binary, sizes binary, codes binary, times binary, sums binary"
#: Words with so many neighbours by side and class, and those that follow themselves, are moved one by one.
MANY = 48
FEW = 3
CLASSES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("classes", pa.binary()), ("numbers", pa.binary()), ("totals", pa.binary()), ("members", pa.binary()), ("moved", pa.int64())])
CLASSES_SQL = "block long, bucket int, classes binary, numbers binary, totals binary, members binary, moved long"
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])


def home(names: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each word."""
    return (names & U64(0xFFFFFF)) % U64(parts)


def to_blocks(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches to blocks; word numbers follow the block's sorted hashes."""
    pack = zstandard.ZstdCompressor(level=1)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    serial, held, n = 0, [], 0

    def flush() -> pa.RecordBatch:
        ids, known, sizes, h = map(np.concatenate, zip(*held))
        names, tokens, counts = np.unique(h, return_inverse=True, return_counts=True)
        return rows(
            BLOCKS, block=[(part << 24) + serial], ids=[ids.tobytes()], known=[known.tobytes()], sizes=[sizes.astype(np.int32).tobytes()],
            tokens=[pack.compress(tokens.astype(np.uint32).tobytes())], vocabulary=[names.tobytes()], counts=[counts.astype(np.uint32).tobytes()],
            buckets=[pack.compress(home(names, parts).astype(np.uint16).tobytes())],
        )

    for batch in batches(it):
        column = batch.column(0)
        ids, known = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        for w in words(batch.column(1)):
            held.append((ids[w.lo : w.hi], known[w.lo : w.hi], np.diff(w.first), w.hash()))
            n += len(w.start) + w.hi - w.lo
            if n >= BLOCK_WORDS:
                yield flush()
                serial, held, n = serial + 1, [], 0
    if held:
        yield flush()


def block_rows(it: Iterator[pa.RecordBatch]):
    """(block, ids, known, sizes, tokens, vocabulary, counts) of each block."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches(it):
        for i in range(batch.num_rows):
            x = {name: batch.column(name)[i].as_py() for name in BLOCKS.names if name != "buckets"}
            yield (
                x["block"], np.frombuffer(x["ids"], np.int64), np.frombuffer(x["known"], bool), np.frombuffer(x["sizes"], np.int32).astype(np.int64),
                np.frombuffer(unpack.decompress(x["tokens"]), np.uint32), np.frombuffer(x["vocabulary"], U64), np.frombuffer(x["counts"], np.uint32).astype(np.int64),
            )


def scatter(parts: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order, at = split_by(home(keys, parts), parts)
    live = np.flatnonzero(np.diff(at))
    return rows(COUNTS, bucket=live, keys=[keys[order[at[b] : at[b + 1]]].tobytes() for b in live], counts=[counts[order[at[b] : at[b + 1]]].astype(np.int64).tobytes() for b in live])


def word_counts(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, _, names, counts in block_rows(it):
            if len(names):
                yield scatter(parts, names, counts)

    return run


def summed(most: int | None):
    """Totals of the keys of a bucket, as rows; the most frequent alone if most is given."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches(it):
            keys += [np.frombuffer(x, U64) for x in batch.column("keys").to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist()]
        if not keys:
            return
        names, index = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
        if most is not None and len(names) > most:
            best = np.lexsort((names, -total))[:most]
            names, total = names[best], total[best]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(total)], names=["key", "n"])

    return run


def lookup(names: np.ndarray, sorted_names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values of names in a sorted table, -1 for others."""
    if not len(sorted_names):
        return np.full(len(names), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return np.where(sorted_names[at] == names, values[at], -1)


def neighbours(sizes: np.ndarray, n: int) -> np.ndarray:
    """True at every word that follows another word of its document."""
    inner = np.ones(n, bool)
    starts = np.cumsum(sizes) - sizes
    inner[starts[(sizes > 0)]] = False
    return inner


def core_bigrams(parts: int, core: np.ndarray):
    """core: hashes of the core words, most frequent first."""
    order = np.argsort(core)
    names = core[order]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, sizes, tokens, vocabulary, _ in block_rows(it):
            number = lookup(vocabulary, names, order)[tokens]
            follows = neighbours(sizes, len(tokens))
            at = np.flatnonzero(follows & (number >= 0))
            at = at[number[at - 1] >= 0]
            keys, counts = np.unique(number[at - 1] * len(core) + number[at], return_counts=True)
            if len(keys):
                yield scatter(parts, keys.astype(U64), counts)

    return run


def h(x: np.ndarray) -> np.ndarray:
    """x ln x, 0 at 0."""
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood, up to a constant, of class bigram counts."""
    return float(h(pairs).sum() - h(pairs.sum(0)).sum() - h(pairs.sum(1)).sum())


def gains(pairs: np.ndarray, out: np.ndarray, into: np.ndarray, own: float) -> np.ndarray:
    """Likelihood gained by adding a word to each class: out and into by class, own: its bigrams with itself."""
    k = np.arange(len(pairs))
    row = h(pairs + out[None, :]) - h(pairs)
    col = h(pairs + into[:, None]) - h(pairs)
    diagonal = pairs[k, k]
    both = h(diagonal + out + into + own) - h(diagonal)
    total = row.sum(1) - row[k, k] + col.sum(0) - col[k, k] + both
    # wherever the word goes, its neighbours' classes gain it as a neighbour
    left, right = pairs.sum(1) + into, pairs.sum(0) + out
    return total - (h(left + out.sum() + own) - h(left)) - (h(right + into.sum() + own) - h(right))


def exchange(bigrams: np.ndarray, counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of n words by exchange, and the class bigram counts; bigrams: rows (before, after), counts theirs.

    Words come in the order of their numbers and start in class number % classes; ties go to the least class,
    and a word stays where it is unless another class is better by more than rounding.  Every move raises the
    likelihood, so the rounds come to an end.
    """
    n = int(bigrams.max()) + 1 if len(bigrams) else 0
    label = np.arange(n) % classes
    pairs = np.zeros((classes, classes))
    if not n:
        return label, pairs
    np.add.at(pairs, (label[bigrams[:, 0]], label[bigrams[:, 1]]), counts)
    by_first, by_second = np.argsort(bigrams[:, 0], kind="stable"), np.argsort(bigrams[:, 1], kind="stable")
    first = np.searchsorted(bigrams[by_first, 0], np.arange(n + 1))
    second = np.searchsorted(bigrams[by_second, 1], np.arange(n + 1))
    moved = 1
    while moved:
        moved = 0
        for w in range(n):
            o, i = by_first[first[w] : first[w + 1]], by_second[second[w] : second[w + 1]]
            after, before = bigrams[o, 1], bigrams[i, 0]
            own = float(counts[o][after == w].sum())
            out = np.bincount(label[after[after != w]], weights=counts[o][after != w], minlength=classes)
            into = np.bincount(label[before[before != w]], weights=counts[i][before != w], minlength=classes)
            a = label[w]
            pairs[a, :] -= out
            pairs[:, a] -= into
            pairs[a, a] -= own
            gain = gains(pairs, out, into, own)
            best = int(np.argmax(gain > gain.max() - 1e-7))
            if gain[best] <= gain[a] + 1e-7:
                best = a
            moved += best != a
            label[w] = best
            pairs[best, :] += out
            pairs[:, best] += into
            pairs[best, best] += own
    return label, pairs


def contexts(parts: int, names: np.ndarray, label: np.ndarray, classes: int):
    """For every word of a block: its count, and its neighbours in the core by side and class."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, sizes, tokens, vocabulary, counts in block_rows(it):
            if not len(vocabulary):
                continue
            known = lookup(vocabulary, names, label)
            cls = known[tokens]
            follows = neighbours(sizes, len(tokens))
            rare = cls < 0
            at = np.flatnonzero(follows)
            left = at[rare[at] & ~rare[at - 1]]
            right = at[~rare[at] & rare[at - 1]] - 1
            key = np.concatenate([tokens[left].astype(np.int64) * (2 * classes) + cls[left - 1], tokens[right].astype(np.int64) * (2 * classes) + classes + cls[right + 1]])
            key, times = np.unique(key, return_counts=True)
            word, code = key // (2 * classes), key % (2 * classes)
            size = np.bincount(word, minlength=len(vocabulary))
            begin = np.cumsum(size) - size
            order, cut = split_by(home(vocabulary, parts), parts)
            out: dict[str, list] = {f.name: [] for f in CONTEXTS}
            for b in np.flatnonzero(np.diff(cut)):
                own = order[cut[b] : cut[b + 1]]
                n = size[own]
                take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
                out["bucket"].append(int(b)), out["block"].append(block), out["keys"].append(vocabulary[own].tobytes())
                out["counts"].append(counts[own].astype(np.uint32).tobytes()), out["sizes"].append(n.astype(np.uint16).tobytes())
                out["codes"].append(code[take].astype(np.uint16).tobytes()), out["times"].append(times[take].astype(np.uint32).tobytes())
            yield rows(CONTEXTS, **out)

    return run


def best_classes(word: np.ndarray, code: np.ndarray, times: np.ndarray, n: int, pairs: np.ndarray) -> np.ndarray:
    """Class of each of n words by its neighbours: word (sorted), code (class before, or classes + class after), times."""
    classes = len(pairs)
    left, right = pairs.sum(1), pairs.sum(0)
    out = np.full(n, int(np.argmax(left + right)), np.int64)
    if not len(word):
        return out
    # rows of gains by (side, class, times), computed once each
    combos, index = np.unique(np.stack([code, times], 1), axis=0, return_inverse=True)
    index = index.ravel()
    c, x = combos[:, 0], combos[:, 1].astype(float)[:, None]
    table = np.where((c < classes)[:, None], h(pairs[np.minimum(c, classes - 1)] + x) - h(pairs[np.minimum(c, classes - 1)]), 0.0)
    after = np.maximum(c - classes, 0)
    table = np.where((c >= classes)[:, None], h(pairs[:, after].T + x) - h(pairs[:, after].T), table)
    starts = group_starts(word)
    into = np.add.reduceat(np.where(code < classes, times, 0), starts[:-1])
    outof = np.add.reduceat(np.where(code >= classes, times, 0), starts[:-1])
    for lo in range(0, len(starts) - 1, 20_000):
        hi = min(lo + 20_000, len(starts) - 1)
        a, b = starts[lo], starts[hi]
        gain = np.add.reduceat(table[index[a:b]], starts[lo:hi] - a, axis=0)
        ui, ii = np.unique(into[lo:hi], return_inverse=True)
        uo, oi = np.unique(outof[lo:hi], return_inverse=True)
        gain -= (h(right + ui[:, None]) - h(right))[ii.ravel()] + (h(left + uo[:, None]) - h(left))[oi.ravel()]
        # classes among the neighbours: their sums have grown by the word, and on the diagonal both sides meet
        row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
        k, x = code[a:b], times[a:b].astype(float)
        before = k < classes
        for side, sums, other in ((before, left, outof), (~before, right, into)):
            r, cls, n_ = row[side], k[side] % classes, other[lo:hi][row[side]]
            base, grown = sums[cls], sums[cls] + x[side]
            np.add.at(gain, (r, cls), h(base + n_) - h(base) - h(grown + n_) + h(grown))
        key = row * classes + k % classes
        _, i, o = np.intersect1d(key[before], key[~before], assume_unique=True, return_indices=True)
        d, xi, xo = pairs[k[before][i], k[before][i]], x[before][i], x[~before][o]
        np.add.at(gain, (row[before][i], k[before][i]), h(d + xi + xo) - h(d + xi) - h(d + xo) + h(d))
        out[word[starts[lo:hi]]] = np.argmax(gain > gain.max(1, keepdims=True) - 1e-7, axis=1)
    return out


def exchanged(word: np.ndarray, code: np.ndarray, times: np.ndarray, label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best class of each word that is in pairs with its class label, by all its neighbours.

    word (sorted), code (class before, classes + class after, or 2 * classes for the word itself) and times, as in
    best_classes; the word's own bigrams are taken out first.
    """
    classes, n = len(pairs), len(label)
    out = label.astype(np.int64).copy()
    starts = np.searchsorted(word, np.arange(n + 1))
    itself = np.zeros(n, bool)
    itself[word[code == 2 * classes]] = True
    apart = itself | (np.diff(starts) >= MANY)
    for w in np.flatnonzero(apart).tolist():
        c, x, a = code[starts[w] : starts[w + 1]], times[starts[w] : starts[w + 1]].astype(float), int(label[w])
        into, outof, own = np.zeros(classes), np.zeros(classes), float(x[c == 2 * classes].sum())
        into[c[c < classes]] = x[c < classes]
        after = (c >= classes) & (c < 2 * classes)
        outof[c[after] - classes] = x[after]
        rest = pairs.copy()
        rest[a, :] -= outof
        rest[:, a] -= into
        rest[a, a] -= own
        gain = gains(rest, outof, into, own)
        if gain.max() > gain[a] + 1e-7:
            out[w] = int(np.argmax(gain > gain.max() - 1e-7))
    keep = ~apart[word]
    word, code, times = word[keep], code[keep], times[keep]
    if not len(word):
        return out
    left, right = pairs.sum(1), pairs.sum(0)
    combos, index = np.unique(np.stack([code, times], 1), axis=0, return_inverse=True)
    index = index.ravel()
    c, x = combos[:, 0], combos[:, 1].astype(float)[:, None]
    table = np.where((c < classes)[:, None], h(pairs[np.minimum(c, classes - 1)] + x) - h(pairs[np.minimum(c, classes - 1)]), 0.0)
    after = np.maximum(c - classes, 0)
    table = np.where((c >= classes)[:, None], h(pairs[:, after].T + x) - h(pairs[:, after].T), table)
    starts = group_starts(word)
    who = word[starts[:-1]]
    into = np.add.reduceat(np.where(code < classes, times, 0), starts[:-1]).astype(float)
    outof = np.add.reduceat(np.where(code >= classes, times, 0), starts[:-1]).astype(float)
    # entries of few occurrences, most of all, are summed by a matrix product
    few = [(x, np.flatnonzero(combos[:, 1] == x)) for x in range(1, FEW + 1)]
    small = []
    for _, at in few:
        part = np.zeros((2 * classes, classes))
        part[combos[at, 0]] = table[at]
        small.append(part)
    rare = times <= FEW
    for lo in range(0, len(who), 2048):
        hi = min(lo + 2048, len(who))
        p, q = starts[lo], starts[hi]
        m, a, i, o = np.arange(hi - lo), label[who[lo:hi]], into[lo:hi], outof[lo:hi]
        row = np.repeat(m, np.diff(starts[lo : hi + 1]))
        gain = np.zeros((hi - lo, classes))
        for x, part in enumerate(small, 1):
            at = np.flatnonzero(times[p:q] == x)
            if len(at):
                holds = np.zeros((hi - lo, 2 * classes))
                holds[row[at], code[p:q][at]] = 1.0
                gain += holds @ part
        at = np.flatnonzero(~rare[p:q])
        if len(at):
            first = np.flatnonzero(np.append(True, row[at][1:] != row[at][:-1]))
            gain[row[at][first]] += np.add.reduceat(table[index[p:q][at]], first, axis=0)
        ui, ii = np.unique(i, return_inverse=True)
        uo, io = np.unique(o, return_inverse=True)
        gain -= (h(right + ui[:, None]) - h(right))[ii.ravel()] + (h(left + uo[:, None]) - h(left))[io.ravel()]
        k, x = code[p:q] % classes, times[p:q].astype(float)
        before = code[p:q] < classes
        # where both sides meet on the diagonal
        key = row * classes + k
        _, u, v = np.intersect1d(key[before], key[~before], assume_unique=True, return_indices=True)
        kb, xb, ka, xa, rb, ra = k[before], x[before], k[~before], x[~before], row[before], row[~before]
        d = pairs[kb[u], kb[u]]
        np.add.at(gain, (rb[u], kb[u]), h(d + xb[u] + xa[v]) - h(d + xb[u]) - h(d + xa[v]) + h(d))
        # the own class has the word's bigrams already: in its row and column on one side, against the neighbours' classes on the other
        at_a, to_a = np.zeros(hi - lo), np.zeros(hi - lo)
        at_a[rb[kb == a[rb]]], to_a[ra[ka == a[ra]]] = xb[kb == a[rb]], xa[ka == a[ra]]
        for r, kk, xx, cell, own in ((rb, kb, xb, pairs[kb, a[rb]], to_a), (ra, ka, xa, pairs[a[ra], ka], at_a)):
            sel = (kk != a[r]) & (own[r] > 0)
            r, kk, xx, cell, y = r[sel], kk[sel], xx[sel], cell[sel], own[r[sel]]
            np.add.at(gain, (r, kk), h(cell - xx + y) - h(cell - xx) - h(cell + y) + h(cell))
        # staying: what the word adds to its class
        stay = np.zeros(hi - lo)
        for r, kk, xx, cell in ((rb, kb, xb, pairs[kb, a[rb]]), (ra, ka, xa, pairs[a[ra], ka])):
            sel = kk != a[r]
            np.add.at(stay, r[sel], (h(cell) - h(cell - xx))[sel])
        stay += h(pairs[a, a]) - h(pairs[a, a] - at_a - to_a) - h(left[a]) + h(left[a] - o) - h(right[a]) + h(right[a] - i)
        gain[m, a] = stay
        best = np.argmax(gain > gain.max(1, keepdims=True) - 1e-7, axis=1)
        out[who[lo:hi]] = np.where(gain.max(1) > stay + 1e-7, best, a)
    return out


def replies(where: list[tuple[int, int]], lens: list[int], index: np.ndarray, cls: np.ndarray, classes: int, moved: int, names: np.ndarray | None = None, total: np.ndarray | None = None) -> pa.RecordBatch:
    """A word bucket's answer: the class of every word, to each block in its order, and the members of each class beside them.

    With names and total each block also gets the numbers of its words in the bucket, a bit of their hash below, and their totals.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    out: dict[str, list] = {f.name: [] for f in CLASSES}
    begin = np.cumsum(lens) - lens
    for j, (b, block) in enumerate(where):
        own = index[begin[j] : begin[j] + lens[j]]
        out["block"].append(block), out["bucket"].append(b), out["classes"].append(pack(cls[own].astype(np.uint16).tobytes()))
        out["members"].append(np.bincount(cls, minlength=classes).tobytes() if not j else None), out["moved"].append(moved if not j else None)
        first = names is not None
        out["numbers"].append(pack(np.diff(own * 2 + half_of(names[own]), prepend=0).astype(np.uint32).tobytes()) if first else None)
        out["totals"].append(pack(total[own].astype(np.int64).tobytes()) if first else None)
    return rows(CLASSES, **out)


def half_of(names: np.ndarray) -> np.ndarray:
    """The half of the words that each belongs to."""
    return ((names >> U64(40)) % U64(2)).astype(np.int64)


def assign(names: np.ndarray, label: np.ndarray, pairs: np.ndarray):
    """A word bucket: the first class of every word."""
    classes = len(pairs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[] for _ in range(5)]
        where = []
        for batch in batches(it):
            for b, k, *rest in zip(*(batch.column(x).to_pylist() for x in ("bucket", "block", "keys", "counts", "sizes", "codes", "times"))):
                where.append((b, k))
                for g, (x, kind) in zip(got, zip(rest, (U64, np.uint32, np.uint16, np.uint16, np.uint32))):
                    g.append(np.frombuffer(x, kind))
        if not where:
            return
        keys, counts, sizes, codes, times = map(np.concatenate, got)
        words_, index = np.unique(keys, return_inverse=True)
        total = np.bincount(index, weights=counts, minlength=len(words_)).astype(np.int64)
        owner = np.repeat(index, sizes)
        k, at = np.unique(owner * (2 * classes) + codes, return_inverse=True)
        sums = np.bincount(at.ravel(), weights=times, minlength=len(k)).astype(np.int64)
        cls = best_classes(k // (2 * classes), k % (2 * classes), sums, len(words_), pairs)
        known = lookup(words_, names, label)
        yield replies(where, [len(k) for k in got[0]], index, np.where(known >= 0, known, cls), classes, 0, words_, total)

    return run


def neighbourhoods(parts: int, classes: int):
    """Blocks with the classes of their words: for each word its class and neighbours by side and class; the block's class bigrams."""
    wide = 2 * classes + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for x, tokens, cls, order, cut, numbers in joined(it, parts):
            if not len(cls):
                continue
            sizes = np.frombuffer(x["sizes"], np.int32).astype(np.int64)
            at = np.flatnonzero(neighbours(sizes, len(tokens)))
            one, two = tokens[at - 1].astype(np.int64), tokens[at].astype(np.int64)
            sums = np.bincount(cls[one] * classes + cls[two], minlength=classes * classes)
            same = one == two
            key = np.concatenate([two[~same] * wide + cls[one[~same]], one[~same] * wide + classes + cls[two[~same]], one[same] * wide + 2 * classes])
            key = np.sort(key.astype(np.uint32) if len(cls) * wide < 1 << 32 else key)
            at = group_starts(key)
            key, times = key[at[:-1]].astype(np.int64), np.diff(at)
            word, code = key // wide, key % wide
            size = np.bincount(word, minlength=len(cls))
            begin = np.cumsum(size) - size
            out: dict[str, list] = {f.name: [] for f in MOVES}
            for b in np.flatnonzero(np.diff(cut)):
                own = order[cut[b] : cut[b + 1]]
                n = size[own]
                take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
                out["bucket"].append(int(b)), out["block"].append(x["block"]), out["numbers"].append(numbers[int(b)])
                out["classes"].append(pack(cls[own].astype(np.uint16).tobytes()))
                out["sizes"].append(pack(n.astype(np.uint16).tobytes())), out["codes"].append(pack(code[take].astype(np.uint16).tobytes()))
                out["times"].append(pack(times[take].astype(np.uint32).tobytes())), out["sums"].append(sums.tobytes() if len(out["block"]) == 1 else None)
            yield rows(MOVES, **out)

    return run


def bigram_sums(classes: int):
    """Class bigrams of the blocks of a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * classes, np.int64)
        for batch in batches(it):
            for x in batch.column(0).to_pylist():
                sums += np.frombuffer(x, np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["key", "n"])

    return run


def move(pairs: np.ndarray, half: int | None):
    """A word bucket: the class of every word after a round; half: 0 or 1 if only half of the words may move."""
    classes = len(pairs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        got: list[list] = [[] for _ in range(5)]
        where = []
        for batch in batches(it):
            for b, k, numbers, *rest in zip(*(batch.column(x).to_pylist() for x in MOVES.names[:-1])):
                where.append((b, k)), got[0].append(np.cumsum(np.frombuffer(unpack(numbers), np.uint32), dtype=np.int64))
                for g, (x, kind) in zip(got[1:], zip(rest, (np.uint16, np.uint16, np.uint16, np.uint32))):
                    g.append(np.frombuffer(unpack(x), kind))
        if not where:
            return
        numbers, own, sizes, codes, times = map(np.concatenate, got)
        index = numbers >> 1
        label, halves = np.zeros(int(index.max()) + 1, np.int64), np.zeros(int(index.max()) + 1, np.int64)
        label[index], halves[index] = own, numbers & 1
        wide = 2 * classes + 1
        k = np.repeat(index, sizes) * wide + codes
        order = np.argsort(k)
        starts = group_starts(k[order])
        k, sums = k[order][starts[:-1]], np.add.reduceat(times[order].astype(np.int64), starts[:-1]) if len(k) else np.zeros(0, np.int64)
        cls = exchanged(k // wide, k % wide, sums, label, pairs)
        if half is not None:
            cls = np.where(halves == half, cls, label)
        yield replies(where, [len(k) for k in got[0]], index, cls, classes, int((cls != label).sum()))

    return run


def joined(it: Iterator[pa.RecordBatch], parts: int):
    """(block's row, tokens, class of each of its words, its words by bucket, where each bucket begins, what else each bucket sent)."""
    unpack = zstandard.ZstdDecompressor()
    base: dict[int, dict] = {}
    got: dict[int, tuple[dict, dict]] = {}
    for batch in batches(it):
        for x in batch.to_pylist():
            if x["kind"] == 0:
                base[x["block"]] = x
            else:
                got.setdefault(x["block"], ({}, {}))[x["kind"] - 1][x["bucket"]] = x["sent"]
    for block in sorted(base):
        x = base.pop(block)
        order, cut = split_by(np.frombuffer(unpack.decompress(x["buckets"]), np.uint16), parts)
        cls = np.zeros(len(order), np.int64)
        sent, rest = got.pop(block, ({}, {}))
        for b, c in sent.items():
            cls[order[cut[b] : cut[b + 1]]] = np.frombuffer(unpack.decompress(c), np.uint16)
        yield x, np.frombuffer(unpack.decompress(x["tokens"]), np.uint32), cls, order, cut, rest


def annotated(it: Iterator[pa.RecordBatch], parts: int):
    """(ids, known, sizes, class of each word, total of each word) of the blocks that met their word classes."""
    unpack = zstandard.ZstdDecompressor()
    for x, tokens, cls, order, cut, totals in joined(it, parts):
        total = np.zeros(len(cls), np.int64)
        for b, t in totals.items():
            total[order[cut[b] : cut[b + 1]]] = np.frombuffer(unpack.decompress(t), np.int64)
        yield np.frombuffer(x["ids"], np.int64), np.frombuffer(x["known"], bool), np.frombuffer(x["sizes"], np.int32).astype(np.int64), cls[tokens], total[tokens]


def transitions(parts: int, classes: int):
    """Class bigram counts of a task's blocks; row `classes` stands before the first word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes + 1) * classes, np.int64)
        for _, _, sizes, cls, _ in annotated(it, parts):
            before = np.append(classes, cls[:-1]) if len(cls) else cls
            before[~neighbours(sizes, len(cls))] = classes
            sums += np.bincount(before * classes + cls, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["key", "n"])

    return run


def log_transitions(counts: np.ndarray, alpha: float) -> np.ndarray:
    """ln P(class | class before), smoothed with alpha times the class unigrams, themselves add-one."""
    unigram = (counts.sum(0) + 1) / (counts.sum() + counts.shape[1])
    return np.log((counts + alpha * unigram) / (counts.sum(1, keepdims=True) + alpha))


def score(parts: int, trans: np.ndarray, mass: np.ndarray, members: np.ndarray):
    classes = trans.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, known, sizes, cls, total in annotated(it, parts):
            before = np.append(classes, cls[:-1]) if len(cls) else cls
            before[~neighbours(sizes, len(cls))] = classes
            p = trans[before, cls] + np.log((total + 1) / (mass + members + 1)[cls])
            row = np.repeat(np.arange(len(sizes)), sizes)
            s = np.bincount(row, weights=p, minlength=len(sizes))
            some = sizes > 0
            ppl = [float(v) if ok else None for v, ok in zip(np.round(np.exp(-s / np.maximum(sizes, 1)), 6).tolist(), some.tolist())]
            keep = pa.array(known)
            yield rows(SCORES, doc_id=ids, n_words=sizes, log_prob=np.round(s, 6), perplexity=ppl).filter(keep)

    return run


def first_classes(blocks: DataFrame, classes: int, core_words: int, parts: int) -> DataFrame:
    """Classes by the core's exchange and by the core's neighbours."""
    counted = to_buckets(blocks.mapInArrow(word_counts(parts), COUNTS_SQL), parts)
    top = counted.mapInArrow(summed(core_words), "key long, n long").orderBy(F.desc("n"), "key").limit(core_words).collect()
    core = np.array([r["key"] for r in top], np.int64).view(U64)
    pairs_ = to_buckets(blocks.mapInArrow(core_bigrams(parts, core), COUNTS_SQL), parts).mapInArrow(summed(None), "key long, n long").toArrow()
    key = pairs_["key"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], pairs_["n"].to_numpy()[order].astype(float)
    label, pairs = exchange(np.stack([key // max(1, len(core)), key % max(1, len(core))], 1), n, classes)
    label = np.append(label, np.arange(len(label), len(core)) % classes)
    by_hash = np.argsort(core)
    names, label = core[by_hash], label[by_hash]
    return checkpointed(to_buckets(blocks.mapInArrow(contexts(parts, names, label, classes), CONTEXTS_SQL), parts).mapInArrow(assign(names, label, pairs), CLASSES_SQL))


def meet(blocks: DataFrame, found: DataFrame, first: DataFrame, rest: str, parts: int, own: tuple[str, ...]) -> DataFrame:
    """Blocks, the classes of their words, and numbers or totals from the first answers, in one place."""
    empty = F.lit(None).cast("binary")
    base = blocks.select("block", *own, F.lit(0).alias("kind"), F.lit(0).alias("bucket"), empty.alias("sent"))
    back = [x.select("block", *(empty.alias(c) for c in own), F.lit(kind).alias("kind"), "bucket", F.col(c).alias("sent")) for kind, x, c in ((1, found, "classes"), (2, first, rest))]
    merged = base.unionByName(back[0]).unionByName(back[1]).withColumn("home", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    return to_buckets(merged, parts, "home").drop("home")


def table(sums: DataFrame, size: int) -> np.ndarray:
    """Rows (key, n) added up; the keys are below size."""
    got = sums.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def exchange_all(blocks: DataFrame, first: DataFrame, classes: int, settle: float, parts: int, trace: list | None = None) -> DataFrame:
    """The classes after rounds in which all words of the corpus may move; trace: gets the likelihood of each round."""
    spark = blocks.sparkSession
    found = kept = first
    best, half, small = None, None, 0
    while True:
        around = checkpointed(meet(blocks, found, first, "numbers", parts, ("sizes", "tokens", "buckets")).mapInArrow(neighbourhoods(parts, classes), MOVES_SQL))
        pairs = table(around.where("sums IS NOT NULL").select("sums").mapInArrow(bigram_sums(classes), "key long, n long"), classes * classes).reshape(classes, classes)
        value, n = likelihood(pairs), max(1.0, pairs.sum())
        if trace is not None:
            trace.append(value)
        if best is not None and value < best:  # the moves of the round got in each other's way
            if half is not None:
                return kept
            half = 0
        else:
            small = small + 1 if best is not None and value - best < settle * n else 0
            best, kept, state = value, found, (around, pairs)
            if small >= (1 if half is None else 2):
                return kept
        found = checkpointed(to_buckets(state[0], parts).mapInArrow(move(state[1], half), CLASSES_SQL))
        del around
        let_go(spark)
        if not found.agg(F.sum("moved")).first()[0] and half is None:
            return kept
        half = None if half is None else 1 - half


def brown_perplexity(docs: DataFrame, classes: int = 64, core_words: int = 1024, alpha: float = 10.0, settle: float = 5e-3) -> DataFrame:
    """doc_id, n_words, log_prob and perplexity of every document that has a doc_id."""
    parts = min(65536, partitions(docs.sparkSession))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = checkpointed(texts.mapInArrow(lambda it: to_blocks(it, parts), BLOCKS_SQL))
    first = first_classes(blocks, classes, core_words, parts)
    found = exchange_all(blocks, first, classes, settle, parts)
    members = np.zeros(classes)
    for r in found.where("members IS NOT NULL").select("members").toLocalIterator():
        members += np.frombuffer(r[0], np.int64)
    merged = meet(blocks, found, first, "totals", parts, ("ids", "known", "sizes", "tokens", "buckets"))
    counts = table(merged.mapInArrow(transitions(parts, classes), "key long, n long"), (classes + 1) * classes).reshape(classes + 1, classes)
    # every word stands behind another or at the beginning, so the columns add up to the classes' words
    return merged.mapInArrow(score(parts, log_transitions(counts, alpha), counts.sum(0), members), "doc_id long, n_words long, log_prob double, perplexity double")
