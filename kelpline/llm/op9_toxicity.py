"""Counterfactual-regularised toxicity classifier.

A logistic regression over the distinct words of a text and their beginnings (3 to 8 bytes), fitted on a
bounded sample of labelled documents.  Labelled texts that name an identity group are copied with the term
swapped for the others of its kind, and the squared change of the score is added to the loss, so that a
neutral mention of a group does not move the score; toxic words keep their weight.

The sample's bound (max_train) limits the fit alone: every document, in full, is scored.  The model has all features
that tell the classes apart in the sample: three documents or more hold them, and their log likelihood ratio is above 3
(a chance of about 1 in 70 for one that is the same in both), and all that a swap changes.

Defined results: rows without doc_id, and labels without doc_id or label, are not used in the fit; a null or
empty text scores the bias alone, which is clean; several labels of one doc_id count as toxic if one does; a
sample without both classes, as of an empty table, gives a model that flags nothing; repeated rows are judged each for
itself, and the first counts in the fit; texts of any length are scored whole.  Ties: equal texts have equal scores, and a
score at the threshold is toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, rows, tidy, with_id
from .textkit import group_starts, words

U64 = np.uint64
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Kinds of identity terms; a term is swapped for the others of its kind.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
FEATURES = pa.schema([("doc_id", pa.int64()), ("pair", pa.int64()), ("features", pa.binary())])


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[self.keys >> 12] = True
        return out


def features(w) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, 32-bit feature) of all words, then of their beginnings of each length."""
    yield np.arange(len(w.start)), (w.hash() >> U64(32)).astype(np.uint32)
    length = w.end - w.start
    for k in PREFIXES:
        at = np.flatnonzero(length > k)
        yield at, (w.span_hash(w.start[at], w.start[at] + k) >> U64(32)).astype(np.uint32) ^ np.uint32(0x9E3779B1 * k & 0xFFFFFFFF)


def _text_features(texts: list[str]) -> list[np.ndarray]:
    out = []
    for w in words(pa.array(texts, pa.large_string())):
        parts = [(w.row[at], f) for at, f in features(w)]
        row, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        key = np.unique((row.astype(np.uint64) << U64(32)) | f)
        cuts = np.searchsorted(key >> U64(32), np.arange(w.hi - w.lo + 1).astype(np.uint64))
        low = (key & U64(0xFFFFFFFF)).astype(np.uint32)
        out += [low[cuts[i] : cuts[i + 1]] for i in range(w.hi - w.lo)]
    return out


def swaps(text: str, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> list[str]:
    """The text with every term of a kind replaced by each other term of that kind; none if it has no term."""
    out = []
    for kind in identities:
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, kind)) + r")\b", re.IGNORECASE)
        if pattern.search(text):
            out += [new for term in kind if (new := pattern.sub(term, text)).lower() != text.lower()]
    return out


def extract(identities: tuple[tuple[str, ...], ...]):
    """Feature sets of the sample's texts (pair 0) and of their swapped copies (pair 1, 2, ...)."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            ids, texts, ks = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, x in enumerate([t or "", *(swaps(t, identities) if t else [])]):
                    ids.append(i), texts.append(x), ks.append(k)
            yield rows(FEATURES, doc_id=ids, pair=ks, features=[f.tobytes() for f in _text_features(texts)])

    return run


def fit(sets: list[np.ndarray], y: np.ndarray, swapped: list[tuple[int, np.ndarray]], l2: float = 1e-3, counterfactual: float = 1.0, rounds: int = 300) -> Model:
    """Weights by accelerated gradient descent; swapped: (index of the original, features of a swapped copy)."""
    never = Model(np.zeros(0, np.uint32), np.zeros(0), -20.0, 0.5)
    if not len(y) or y.min() == y.max():
        return never
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    moving = [np.setxor1d(f, sets[i]) for i, f in swapped]
    moving = np.unique(np.concatenate(moving)) if moving else np.zeros(0, np.uint32)
    ordered = np.sort(flat)
    at = group_starts(ordered)
    ordered, held = ordered[at[:-1]], np.diff(at)
    keys = ordered[(held >= 3) | np.isin(ordered, moving, assume_unique=True)]
    del ordered, held, at
    if not len(keys):
        return never
    index = np.empty(len(flat), np.int32)
    for lo in range(0, len(flat), 1 << 20):
        index[lo : lo + (1 << 20)] = np.minimum(np.searchsorted(keys, flat[lo : lo + (1 << 20)]), len(keys) - 1)
    known = keys[index] == flat
    index, who = index[known], who[known]
    del flat, known
    n1, n0 = y.sum(), (1 - y).sum()
    toxic = np.bincount(index[y[who] > 0], minlength=len(keys))
    clean = np.bincount(index, minlength=len(keys)) - toxic
    a, b = (toxic + 0.1) / (n1 + 0.2), (clean + 0.1) / (n0 + 0.2)
    both = (toxic + clean + 0.2) / (n1 + n0 + 0.4)
    # likelihood ratio of the presence of each feature given the class
    gain = toxic * np.log(a / both) + clean * np.log(b / both) + (n1 - toxic) * np.log((1 - a) / (1 - both)) + (n0 - clean) * np.log((1 - b) / (1 - both))
    gain[toxic + clean < 3] = -1
    chosen = np.flatnonzero((gain > 3) | np.isin(keys, moving, assume_unique=True))
    if not len(chosen):
        return never
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    n, m = len(sets), len(chosen)
    own = place[index] >= 0
    row, col = who[own], place[index[own]]
    del index, who, own
    mean = len(row) / n
    # changes of the swapped copies against their originals, as a sparse matrix of +1 and -1
    names = keys[chosen]
    dr, dc, dv = [], [], []
    for r, (i, f) in enumerate(swapped):
        for sign, part in ((1.0, np.setdiff1d(f, sets[i])), (-1.0, np.setdiff1d(sets[i], f))):
            c = np.searchsorted(names, part)
            c = c[(c < m) & (names[np.minimum(c, m - 1)] == part)]
            dr.append(np.full(len(c), r)), dc.append(c), dv.append(np.full(len(c), sign))
    dr, dc, dv = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((dr, np.int64), (dc, np.int64), (dv, float)))
    scale = max(1.0, float(np.bincount(dc, minlength=m).max())) if len(dc) else 1.0
    w, bias = np.zeros(m), float(np.log(n1 / n0))
    vw, vb, lr = np.zeros(m), 0.0, 4.0 / (1 + mean / 4)
    if len(dc):  # the penalty's curvature is at most its longest row times its (scaled) fullest column
        lr = min(lr, 2.0 / max(1e-9, counterfactual * np.bincount(dr).max() / len(PREFIXES)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=n) + bias, -30, 30)))
        e = (p - y) / n
        g = np.bincount(col, weights=e[row], minlength=m) + l2 * w / 10
        if len(dc):
            # the penalty's gradient, kept stable by its own scale
            moved = np.bincount(dr, weights=dv * w[dc], minlength=len(swapped))
            g += counterfactual * np.bincount(dc, weights=dv * moved[dr], minlength=m) / scale / len(PREFIXES)
        vw, vb = 0.9 * vw - lr * g, 0.9 * vb - lr * float(e.sum())
        w, bias = w + vw, bias + vb
    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=n) + bias, -30, 30)))
    return Model(names, w, bias, best_threshold(p, y))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the highest F1."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    sorted_p = np.append(p[order], 0.0)
    cuts = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = cuts[np.argmax(sorted_p[cuts] - sorted_p[cuts + 1])]
    return float(np.clip((sorted_p[k] + sorted_p[k + 1]) / 2, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000, counterfactual: float = 1.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """A model from at most max_train labelled documents, drawn by the hash of doc_id."""
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
        .collect()
    )
    wanted = {r["doc_id"]: int(r["toxic"] > 0) for r in y}
    if not wanted:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -20.0, 0.5)
    spark = docs.sparkSession
    # at most max_train ids: a table of bounded size
    chosen = F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(list(wanted), pa.int64())})))
    sample = with_id(docs, F.col("text").cast("string").alias("text")).join(chosen, "doc_id", "left_semi")
    got = sample.mapInArrow(extract(identities), "doc_id long, pair long, features binary").toArrow()
    ids, pair = got["doc_id"].to_numpy(), got["pair"].to_numpy()
    sets = [np.frombuffer(x, np.uint32) for x in got["features"].to_pylist()]
    order = np.lexsort((pair, ids))
    originals, where, swapped = [], {}, []
    for i in order[pair[order] == 0]:
        where.setdefault(int(ids[i]), len(originals))
        originals.append(i)
    swapped = [(where[int(ids[i])], sets[i]) for i in order[pair[order] > 0]]
    return fit([sets[i] for i in originals], np.array([wanted[int(ids[i])] for i in originals], float), swapped, counterfactual=counterfactual)


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    """Probability that each text is toxic."""
    out = np.empty(len(column))
    table = model.table()
    for w in words(column):
        z = np.full(w.hi - w.lo, model.bias)
        if len(model.keys):
            found = []
            for at, f in features(w):
                hit = np.flatnonzero(table[f >> np.uint32(12)])
                at, f = at[hit], f[hit]
                k = np.minimum(np.searchsorted(model.keys, f), len(model.keys) - 1)
                ok = model.keys[k] == f
                found.append((w.row[at[ok]] << 32) | k[ok])
            key = np.unique(np.concatenate(found))
            z += np.bincount(key >> 32, weights=model.weights[key & 0xFFFFFFFF], minlength=w.hi - w.lo)
        out[w.lo : w.hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


SCORES = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("toxic", pa.bool_())])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxicity and toxic of every document that has a doc_id."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            p = score_column(model, batch.column(1))
            yield rows(SCORES, doc_id=batch.column(0), toxicity=np.round(p, 6), toxic=p >= model.threshold)

    return with_id(docs, F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and toxicity of the documents that the classifier rejects."""
    return toxicity(docs, train(docs, labels, **options)).where("toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows; rows without a doc_id are judged as well."""
    model = train(docs, labels, **options)
    at = docs.columns.index("text")

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            yield batch.filter(pa.array(score_column(model, batch.column(at)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
