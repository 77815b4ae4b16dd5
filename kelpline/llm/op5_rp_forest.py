"""Approximate nearest neighbours by a forest of random-projection trees.

A tree sends each vector left or right by a random direction of its level and the median of its node, until
leaf_size vectors are left.  The top of the trees is fitted on a bounded sample; leaves that turn out larger are
split again, each by a bounded sample of its own and inside a task, until none is above twice leaf_size, so
leaves stay small at any number of vectors.  Every vector is in one leaf of every tree.

One priority queue serves all trees of a query: it holds branches by the squared distances by which the query
misses them, summed on their way from the root, and pops the nearest one, in whichever tree.  The first `probes`
leaves give the candidates, reranked by exact cosine.  probes is set by measurement: for some queries the exact
neighbours are found by a full scan, and probes is the least number of leaves at which the queue finds the
target share of them.

Vectors meet queries leaf by leaf, in packed blocks: a vector travels once for each tree, a query once for each
bucket of leaves that it probes.  Of vectors that are equal the k + 1 least ids are indexed; no others can be
among k neighbours with ties to the least id.  A cut takes 4 bytes in every task, 4 * trees bytes for leaf_size vectors.

Defined results: rows without an id or a vector, with a vector of another length than most (ties: the
shorter), or with a null or non-finite element, take no part; a zero vector has cosine 0 to all; of rows that
repeat an id the least vector counts.  Cosines are rounded to 5 places, ties go to the least neighbour_id.  An
empty table, or one without a usable vector, has no result; columns other than the two named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, checkpointed, id_hash, partitions, rows, split_by, to_buckets
from .textkit import group_starts

PACK = pa.schema([("bucket", pa.int32()), ("query", pa.bool_()), ("ids", pa.binary()), ("vectors", pa.binary()), ("leaves", pa.binary()), ("counts", pa.binary())])
PACK_SQL = "bucket int, query boolean, ids binary, vectors binary, leaves binary, counts binary"
FOUND = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("near", pa.binary()), ("scores", pa.binary())])
FOUND_SQL = "bucket int, ids binary, near binary, scores binary"
RESULT = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("rank", pa.int32()), ("cosine", pa.float64())])
RESULT_SQL = "vec_id long, neighbour_id long, rank int, cosine double"
LEVELS, STEPS = 48, 100_000
#: Vectors of a leaf that is split again, and the least of them that a cut is taken from.
RESAMPLE, LEAST = 1024, 32


class Tree:
    """Nodes as arrays: the cut of each, and its two children; a leaf has its number, from 0, and no children."""

    def __init__(self, dirs: np.ndarray):
        self.dirs = dirs  # levels, dimensions
        self.cut, self.left, self.level = [0.0], [-1], [0]
        self._done()

    def _done(self) -> None:
        self.cuts, self.lefts, self.levels = np.array(self.cut, np.float32), np.array(self.left, np.int64), np.array(self.level, np.int64)
        self.number = np.cumsum(self.lefts < 0) - 1
        self.leaf_nodes = np.flatnonzero(self.lefts < 0)

    @property
    def leaves(self) -> int:
        return len(self.leaf_nodes)

    def graft(self, node: int, cuts: list) -> None:
        """Puts a subtree (cut, left subtree, right subtree), or None for a leaf, in place of a leaf."""
        todo = [(node, cuts)]
        while todo:
            at, part = todo.pop()
            if part is None:
                continue
            self.cut[at], self.left[at] = part[0], len(self.cut)
            for child in part[1:]:
                todo.append((len(self.cut), child))
                self.cut.append(0.0), self.left.append(-1), self.level.append(self.level[at] + 1)

    def node(self, x: np.ndarray) -> np.ndarray:
        """The node of the leaf of each vector."""
        at, live = np.zeros(len(x), np.int64), np.arange(len(x))
        level = 0
        while len(live := live[self.lefts[at[live]] >= 0]):
            p = x[live] @ self.dirs[level]
            at[live] = self.lefts[at[live]] + (p > self.cuts[at[live]])
            level += 1
        return at


def subtree(x: np.ndarray, dirs: np.ndarray, level: int, rows_each: float, leaf_size: int) -> list | None:
    """Median cuts of a sample, each vector of which stands for rows_each, down to leaf_size."""
    root: list = [None]
    todo = [(root, 0, np.arange(len(x)), level)]
    while todo:
        place, slot, own, depth = todo.pop()
        if len(own) * rows_each <= leaf_size or len(own) < LEAST or depth >= LEVELS:
            continue
        p = x[own] @ dirs[depth]
        cut = np.float32(np.median(p))
        side = p > cut
        if not side.any():  # many equal ones: below the greatest, or not at all
            cut = np.float32(p[p < p.max()].max()) if (p < p.max()).any() else cut
            side = p > cut
        if side.any() and not side.all():
            place[slot] = [float(cut), None, None]
            todo += [(place[slot], 1, own[~side], depth + 1), (place[slot], 2, own[side], depth + 1)]
    return root[0]


class Forest:
    def __init__(self, dims: int, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            dirs = [np.linalg.qr(rng.standard_normal((dims, dims)))[0].T for _ in range(-(-LEVELS // dims))]
            self.trees.append(Tree(np.concatenate(dirs)[:LEVELS].astype(np.float32)))

    @classmethod
    def build(cls, sample: np.ndarray, trees: int, leaf_size: int, n: int | None = None) -> "Forest":
        out = cls(sample.shape[1], trees)
        for tree in out.trees:
            tree.graft(0, subtree(sample, tree.dirs, 0, (n or len(sample)) / max(1, len(sample)), leaf_size))
            tree._done()
        return out

    @property
    def base(self) -> np.ndarray:
        """The number of the first leaf of each tree among all leaves, and of all."""
        return np.append(0, np.cumsum([t.leaves for t in self.trees]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in every tree, numbered through the forest."""
        base = self.base
        return np.stack([t.number[t.node(x)] + b for t, b in zip(self.trees, base)], 1)

    def search(self, x: np.ndarray) -> Iterator[int]:
        """The leaves in the order in which the queue of a query pops them: branches of all trees in one heap."""
        p = [(t.dirs @ x).tolist() for t in self.trees]
        cut, left, level, number = ([getattr(t, k).tolist() if not hasattr(t, f"_{k}") else getattr(t, f"_{k}") for t in self.trees] for k in ("cuts", "lefts", "levels", "number"))
        for t, *lists in zip(self.trees, cut, left, level, number):
            t._cuts, t._lefts, t._levels, t._number = lists
        base = self.base.tolist()
        heap = [(0.0, t, 0) for t in range(len(self.trees))]
        while heap:
            miss, t, node = heapq.heappop(heap)
            own_cut, own_left, own_level, own_p = cut[t], left[t], level[t], p[t]
            while own_left[node] >= 0:
                side = own_p[own_level[node]] - own_cut[node]
                child = own_left[node]
                far = side <= 0
                heapq.heappush(heap, (miss + side * side, t, child + far))
                node = child + (not far)
            yield base[t] + number[t][node]


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
    return batch.column("id").to_numpy(), unit(flat)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and rounded score of the k best of each row, ties to the least id; scores of -inf don't count."""
    s = np.rint(np.maximum(scores, -2) * STEPS).astype(np.int32)
    k = min(k, s.shape[1])
    low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero((s >= low[:, None]) & (s >= -STEPS - 1))
    got, near = s[row, col], ids[col]
    order = np.lexsort((near, -got, row))
    row, near, got = row[order], near[order], got[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row] < k
    return row[keep], near[keep], got[keep]


def scan(sample_ids: np.ndarray, sample: np.ndarray, dims: int, k: int, forest: Forest):
    """Exact neighbours of the sample within a task, at most k each, with their leaves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches(it):
            ids, x = vectors(batch, dims)
            for lo in range(0, len(ids), 8192):
                part, leaf = ids[lo : lo + 8192], forest.leaf(x[lo : lo + 8192])
                s = sample @ x[lo : lo + 8192].T
                s[sample_ids[:, None] == part[None, :]] = -np.inf
                q, near, score = top(s, part, k)
                order = np.argsort(part)
                new = (q, near, score, leaf[order[np.searchsorted(part, near, sorter=order)]])
                q, near, score, leaf = map(np.concatenate, zip(held, new)) if held else new
                order = np.lexsort((near, -score, q))
                q, near, score, leaf = q[order], near[order], score[order], leaf[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                held = (q[keep], near[keep], score[keep], leaf[keep])
        if held:
            q, near, score, leaf = held
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near), pa.array(score), pa.array([x.tobytes() for x in leaf.astype(np.int64)], pa.binary())], names=["q", "id", "score", "leaf"])

    return run


def count_leaves(forest: Forest, dims: int):
    """Vectors of a task in each leaf."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.base[-1], np.int64)
        for batch in batches(it):
            _, x = vectors(batch, dims)
            for lo in range(0, len(x), 16384):
                total += np.bincount(forest.leaf(x[lo : lo + 16384]).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["leaf", "n"])

    return run


def resample(forest: Forest, dims: int, share: dict[int, float]):
    """Some RESAMPLE vectors of each leaf in share, by the hash of the id."""
    large = np.array(sorted(share), np.int64)
    least = np.array([share[x] for x in large.tolist()])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            ids, x = vectors(batch, dims)
            leaf = forest.leaf(x)
            at = np.minimum(np.searchsorted(large, leaf), len(large) - 1)
            draw = (id_hash(ids) >> np.uint64(11)).astype(float) / 2.0**53
            row, col = np.nonzero((large[at] == leaf) & (draw[:, None] < least[at]))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[row, col]), pa.array([v.tobytes() for v in x[row]], pa.binary())], names=["leaf", "vector"])

    return run


def split_leaves(forest: Forest, counts: dict[int, int], dims: int, leaf_size: int):
    """Subtrees of large leaves, from their samples; rows come leaf by leaf."""
    base = forest.base

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches(it):
            for leaf, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(leaf, []).append(v)
        out = []
        for leaf, own in sorted(held.items()):
            t = int(np.searchsorted(base, leaf, "right")) - 1
            tree = forest.trees[t]
            x = np.frombuffer(b"".join(own), np.float32).reshape(-1, dims)
            out.append((leaf, repr(subtree(x, tree.dirs, tree.level[tree.leaf_nodes[leaf - base[t]]], counts[leaf] / len(x), leaf_size))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out])], names=["leaf", "cuts"])

    return run


def fit(base: DataFrame, n: int, dims: int, trees: int, leaf_size: int, sample_size: int) -> Forest:
    """The forest of all vectors; base: id and vector."""
    import ast

    share = min(1.0, sample_size / max(1, n))
    drawn = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("id").toArrow()
    sample = vectors(drawn.combine_chunks().to_batches()[0], dims)[1] if drawn.num_rows else np.zeros((0, dims), np.float32)
    forest = Forest.build(sample, trees, leaf_size, n)
    solid: set[tuple[int, int]] = set()
    while True:
        at = forest.base
        counts = base.mapInArrow(count_leaves(forest, dims), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * leaf_size).collect()
        place = {r["leaf"]: int(np.searchsorted(at, r["leaf"], "right")) - 1 for r in counts}
        large = {r["leaf"]: r["n"] for r in counts if (t := place[r["leaf"]], int(forest.trees[t].leaf_nodes[r["leaf"] - at[t]])) not in solid}
        if not large:
            return forest
        got = base.mapInArrow(resample(forest, dims, {x: RESAMPLE / c for x, c in large.items()}), "leaf long, vector binary").repartition("leaf").mapInArrow(split_leaves(forest, large, dims, leaf_size), "leaf long, cuts string")
        cuts = {r["leaf"]: ast.literal_eval(r["cuts"]) for r in got.collect()}
        for leaf in large:
            t = place[leaf]
            node = int(forest.trees[t].leaf_nodes[leaf - at[t]])
            if cuts.get(leaf) is None:  # its vectors do not part
                solid.add((t, node))
            else:
                forest.trees[t].graft(node, cuts[leaf])
        for tree in forest.trees:
            tree._done()


def place(forest: Forest, dims: int, parts: int):
    """Vectors to the buckets of their leaves, in packed rows."""
    total = int(forest.base[-1])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            ids, x = vectors(batch, dims)
            for lo in range(0, len(ids), 8192):
                i, v = ids[lo : lo + 8192], x[lo : lo + 8192]
                leaves = forest.leaf(v)
                row, leaf = np.repeat(np.arange(len(i)), leaves.shape[1]), leaves.ravel()
                order, at = split_by(leaf * parts // total, parts)
                out: dict[str, list] = {f.name: [] for f in PACK}
                for b in np.flatnonzero(np.diff(at)):
                    own = order[at[b] : at[b + 1]]
                    out["bucket"].append(int(b)), out["query"].append(False), out["ids"].append(i[row[own]].tobytes())
                    out["vectors"].append(v[row[own]].tobytes()), out["leaves"].append(leaf[own].tobytes()), out["counts"].append(b"")
                yield rows(PACK, **out)

    return run


def ask(forest: Forest, dims: int, probes: int, parts: int):
    """Queries to the buckets of the leaves that their queues pop first."""
    total = int(forest.base[-1])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            ids, x = vectors(batch, dims)
            for lo in range(0, len(ids), 1024):
                i, v = ids[lo : lo + 1024], x[lo : lo + 1024]
                popped = [np.fromiter((leaf for _, leaf in zip(range(probes), forest.search(q))), np.int64) for q in v]
                row, leaf = np.repeat(np.arange(len(i)), [len(p) for p in popped]), np.concatenate(popped)
                order, at = split_by(leaf * parts // total, parts)
                out: dict[str, list] = {f.name: [] for f in PACK}
                for b in np.flatnonzero(np.diff(at)):
                    own = order[at[b] : at[b + 1]]
                    starts = group_starts(row[own])
                    who = row[own][starts[:-1]]
                    out["bucket"].append(int(b)), out["query"].append(True), out["ids"].append(i[who].tobytes()), out["vectors"].append(v[who].tobytes())
                    out["leaves"].append(leaf[own].tobytes()), out["counts"].append(np.diff(starts).astype(np.int64).tobytes())
                yield rows(PACK, **out)

    return run


def match(dims: int, k: int, parts: int):
    """A bucket of leaves: exact cosines of the queries with the vectors of each leaf, the k best of each query."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, asked = [], []
        for batch in batches(it):
            for query, ids, v, leaves, counts in zip(*(batch.column(c).to_pylist() for c in PACK.names[1:])):
                ids, v, leaves = np.frombuffer(ids, np.int64), np.frombuffer(v, np.float32).reshape(-1, dims), np.frombuffer(leaves, np.int64)
                (asked if query else data).append((ids, v, leaves, np.frombuffer(counts, np.int64)))
        if not data or not asked:
            return
        ids, x, leaf, _ = map(np.concatenate, zip(*data))
        del data
        order = np.lexsort((ids, leaf))
        ids, x, leaf = ids[order], x[order], leaf[order]
        q_ids, q, q_leaf, counts = map(np.concatenate, zip(*asked))
        q_row = np.repeat(np.arange(len(q_ids)), counts)
        order = np.argsort(q_leaf, kind="stable")
        q_leaf, q_row = q_leaf[order], q_row[order]
        starts = group_starts(leaf)
        names = leaf[starts[:-1]]
        lo, hi = np.searchsorted(q_leaf, names), np.searchsorted(q_leaf, names, "right")
        found, held = [], 0
        for j in np.flatnonzero(hi > lo).tolist():
            a, b = starts[j], starts[j + 1]
            for c in range(lo[j], hi[j], 4096):
                who = q_row[c : min(c + 4096, hi[j])]
                s = q[who] @ x[a:b].T
                at = a + np.searchsorted(ids[a:b], q_ids[who])
                own = np.flatnonzero((at < b) & (ids[np.minimum(at, b - 1)] == q_ids[who]))
                s[own, at[own] - a] = -np.inf
                row, near, score = top(s, ids[a:b], k)
                found.append((q_ids[who[row]], near, score))
                held += len(row)
            if held > 4_000_000:
                found, held = [best(*map(np.concatenate, zip(*found)), k)], 0
        if not found:
            return
        who, near, score = best(*map(np.concatenate, zip(*found)), k)
        order, cut = split_by(id_hash(who) % np.uint64(parts), parts)
        take = [order[cut[b] : cut[b + 1]] for b in np.flatnonzero(np.diff(cut))]
        yield rows(FOUND, bucket=np.flatnonzero(np.diff(cut)), ids=[who[t].tobytes() for t in take], near=[near[t].tobytes() for t in take], scores=[score[t].tobytes() for t in take])

    return run


def best(who: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best distinct neighbours of each query, best first, ties to the least id."""
    order = np.lexsort((-score, near, who))
    who, near, score = who[order], near[order], score[order]
    fresh = np.ones(len(who), bool)  # the same pair may differ by rounding between leaves: its greatest score counts
    fresh[1:] = (who[1:] != who[:-1]) | (near[1:] != near[:-1])
    who, near, score = who[fresh], near[fresh], score[fresh]
    order = np.lexsort((near, -score, who))
    who, near, score = who[order], near[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], near[keep], score[keep]


def rerank(k: int):
    """A query bucket: the k best of all leaves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], []]
        for batch in batches(it):
            for g, (name, kind) in zip(got, (("ids", np.int64), ("near", np.int64), ("scores", np.int32))):
                g += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
        if not got[0]:
            return
        who, near, score = best(*map(np.concatenate, got), k)
        rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
        yield rows(RESULT, vec_id=who, neighbour_id=near, rank=rank, cosine=score / STEPS)

    return run


def calibrate(forest: Forest, queries: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """The least number of leaves at which the share of neighbours found reaches recall; near: the leaves of each neighbour."""
    needed = []
    for x, leaves in zip(queries, near):
        open_ = {int(leaf): set() for leaf in leaves.ravel()}
        for j, own in enumerate(leaves.tolist()):
            for leaf in own:
                open_[leaf].add(j)
        missing = set(range(len(leaves)))
        for pops, leaf in enumerate(forest.search(x)):
            if not missing:
                break
            got = open_.get(leaf, set()) & missing
            needed += [pops + 1] * len(got)
            missing -= got
    if not needed:
        return int(forest.base[-1])
    every = np.sort(needed)
    return int(every[min(len(every) - 1, int(np.ceil(recall * len(every))) - 1)])


def nearest_neighbours(
    table: DataFrame, k: int = 10, recall: float = 0.94, trees: int = 4, leaf_size: int = 512, sample_size: int = 50_000, sample_queries: int = 200,
    id_column: str = "vec_id", vector_column: str = "embedding", queries: Column | None = None,
) -> DataFrame:
    """vec_id, neighbour_id, rank and cosine of the k nearest of the rows where queries holds (a condition on id).

    Without queries every row is one.  recall is the target that the search is tuned to.
    """
    spark = table.sparkSession
    parts = partitions(spark)
    vector = F.col(f"`{vector_column}`").cast("array<float>")
    base = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("vector"))
    base = base.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf'))")
    head = base.select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if head is None:
        return spark.createDataFrame([], RESULT_SQL)
    dims = head["n"]
    base = checkpointed(base.where(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector")))
    equal = W.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    indexed = checkpointed(base.withColumn("_copy", F.row_number().over(equal)).where(F.col("_copy") <= k + 1).drop("_copy"))
    n = indexed.count()
    forest = fit(indexed, n, dims, trees, leaf_size, sample_size)
    wanted = base if queries is None else base.where(queries)
    # bounded by sample_queries rows: their neighbours measure the search
    some = wanted.orderBy(F.xxhash64("id"), "id").limit(sample_queries).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], RESULT_SQL)
    ids, sample = vectors(some.combine_chunks().to_batches()[0], dims)
    exact = indexed.mapInArrow(scan(ids, sample, dims, k, forest), "q long, id long, score int, leaf binary")
    exact = exact.withColumn("_rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_rank") <= k)
    near: list[list] = [[] for _ in ids]
    for r in exact.select("q", "leaf").collect():
        near[r["q"]].append(np.frombuffer(r["leaf"], np.int64))
    probes = calibrate(forest, sample, [np.array(x).reshape(-1, trees) for x in near], recall)
    sent = indexed.mapInArrow(place(forest, dims, parts), PACK_SQL).unionAll(wanted.mapInArrow(ask(forest, dims, probes, parts), PACK_SQL))
    return to_buckets(to_buckets(sent, parts).mapInArrow(match(dims, k, parts), FOUND_SQL), parts).mapInArrow(rerank(k), RESULT_SQL)
