"""Query trees as DataFrame plans.

The occurrences of all leaves are read in one scan, meet their documents in one exchange, and the whole tree,
conditions, positions and scores alike, is then one projection over each document's small array of
occurrences.  Global counts come as a one-row side, so nothing is collected on the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Weights, bm25, damping, final_score, occurrence_weight
from ..functions.text import mask_match
from ..operators.index import Corpus
from .tree import OPTIONAL, Leaf, Node, number, optional

CASE_BITS = 0x00FFFE00
TYPE_BITS = 0xFF000000


def leaf_table(spark, tree: Node | Leaf) -> DataFrame:
    """The query's leaves; its size is the query's, so it may be broadcast."""
    found = [(x.id, x.term, x.index, x.basic, x.dependency, x.feature) for x in number(tree)]
    return spark.createDataFrame(found, "leaf int, term string, index_type int, basic boolean, dependency boolean, mask long")


def statistics(occurrences: DataFrame, tree: Node | Leaf, compute_df: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """One row: number of documents, average length, and the document frequency of each leaf."""
    if lengths is None:
        lengths = occurrences.where("index_type = 0").groupBy("doc").agg(F.max("len").alias("len"))
    whole = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("average"))
    found = number(tree)
    if not compute_df:
        return whole.select("*", *(F.lit(float(x.gdf)).alias(f"df{x.id}") for x in found))
    terms = sorted({x.term for x in found})
    df = occurrences.where(F.col("term").isin(terms)).select("term", "index_type", "doc").distinct()
    row = df.agg(*(F.count_if((F.col("term") == x.term) & (F.col("index_type") == x.index)).cast("double").alias(f"df{x.id}") for x in found))
    return whole.crossJoin(F.broadcast(row))


class Evaluator:
    """Column expressions over `occ`, a document's array of (leaf, pos, weight, case)."""

    def __init__(self, w: Weights):
        self.w = w

    @staticmethod
    def of_leaf(occ: Column, x: Leaf) -> Column:
        return F.filter(occ, lambda o: o["leaf"] == x.id)

    def own(self, x: Leaf) -> Column:
        return self.of_leaf(F.col("occ"), x)

    def positions(self, n: Node | Leaf) -> Column:
        if isinstance(n, Leaf):
            return F.transform(self.own(n), lambda o: o["pos"])
        if n.op in ("OR", "OR_MAX"):
            return F.array_sort(F.array_distinct(F.flatten(F.array(*(self.positions(c) for c in n.children)))))
        return self.positions(n.children[0])

    def holds(self, n: Node | Leaf) -> Column:
        """The document satisfies the node; optional parts always do."""
        if isinstance(n, Leaf):
            return F.lit(True) if n.kind == OPTIONAL else F.exists("occ", lambda o: o["leaf"] == n.id)
        if optional(n):
            return F.lit(True)
        needed = [c for c in n.children if not optional(c)]
        each = [self.holds(c) for c in needed]
        if n.op in ("OR", "OR_MAX"):
            return reduce(lambda a, b: a | b, each)
        every = reduce(lambda a, b: a & b, each)
        if n.op in ("PHRASE", "PROX", "ORDERED_PROX") and len(needed) > 1:
            return every & self.near(n.op, needed, n.distance)
        return every

    def near(self, op: str, children: list[Node | Leaf], distance: int | None) -> Column:
        places = [self.positions(c) for c in children]
        if op == "PHRASE":
            starts = lambda q, i: F.transform(q, lambda p: p - i)
            return F.size(reduce(F.array_intersect, [starts(q, i) for i, q in enumerate(places)])) > 0
        # one sweep over the places of all children in order
        marked = lambda q, i: F.transform(q, lambda p: F.struct(p.alias("pos"), F.lit(i).alias("child")))
        every = F.array_sort(F.flatten(F.array(*(marked(q, i) for i, q in enumerate(places)))))
        k, none = len(places), F.lit(None).cast("int")

        def sweep(s: Column, x: Column) -> Column:
            pos = x["pos"]
            if op == "ORDERED_PROX":
                # per child, the latest start from which the children up to it have followed each other
                at = [F.when(x["child"] == i, pos if i == 0 else s[f"c{i - 1}"]).otherwise(s[f"c{i}"]) for i in range(k)]
                met = (x["child"] == k - 1) & (pos - (s[f"c{k - 2}"] if k > 1 else pos) <= distance)
            else:
                # per child, its latest place
                at = [F.when(x["child"] == i, pos).otherwise(s[f"c{i}"]) for i in range(k)]
                met = reduce(lambda a, b: a & b, [a.isNotNull() & (pos - a <= distance) for a in at])
            return F.struct(*(a.alias(f"c{i}") for i, a in enumerate(at)), (s["met"] | F.coalesce(met, F.lit(False))).alias("met"))

        return F.aggregate(every, F.struct(*(none.alias(f"c{i}") for i in range(k)), F.lit(False).alias("met")), sweep, lambda s: s["met"])

    def bm25(self, freq: Column, x: Leaf) -> Column:
        return bm25(freq, F.col("len"), F.col("n_docs"), F.col("average"), F.col(f"df{x.id}"), self.w)

    def score(self, n: Node | Leaf) -> Column:
        zero = F.lit(0.0)
        if isinstance(n, Leaf):
            mine = self.own(n)
            freq = F.aggregate(mine, zero, lambda a, o: a + o["weight"])
            s = F.when(F.size(mine) > 0, self.bm25(freq, n)).otherwise(zero)
            if n.n_phrases > 1:
                s = s * n.n_phrases**0.5
            return s * damping(F.lit(n.dependency), F.exists(mine, lambda o: o["case"]), self.w)
        if n.op == "OR_MAX":
            return self.best_of(n)
        return reduce(lambda a, b: a + b, [self.score(c) for c in n.children])

    def best_of(self, n: Node) -> Column:
        """Per position the child of the highest weight (ties: the first) counts; each child scores what it kept."""
        kids = [c for c in n.children if isinstance(c, Leaf)]
        rest = [c for c in n.children if not isinstance(c, Leaf)]
        ids = [x.id for x in kids]

        def value(o: Column) -> Column:
            v = o["weight"]
            for x in kids:
                if x.n_phrases > 1:
                    v = F.when(o["leaf"] == x.id, o["weight"] * x.n_phrases**0.5).otherwise(v)
            return v

        group = F.filter("occ", lambda o: o["leaf"].isin(ids))
        kept = F.filter(
            group,
            lambda o: ~F.exists(group, lambda p: (p["pos"] == o["pos"]) & ((value(p) > value(o)) | ((value(p) == value(o)) & (p["leaf"] < o["leaf"])))),
        )
        total = F.lit(0.0)
        for x in kids:
            mine = self.of_leaf(kept, x)
            freq = F.aggregate(mine, F.lit(0.0), lambda a, o: a + o["weight"])
            total = total + F.when(F.size(mine) > 0, self.bm25(freq, x) * x.n_phrases * damping(F.lit(x.dependency), F.exists(mine, lambda o: o["case"]), self.w)).otherwise(0.0)
        return reduce(lambda a, c: a + self.score(c), rest, total)


def hits(index: DataFrame | Corpus, tree: Node | Leaf, weights: Weights = Weights(), compute_df: bool = True) -> DataFrame:
    """doc, score, len, strict and proximate of every document that satisfies the tree.

    index: occurrences (doc, pos, term, index_type, score, feature, len), or the documents themselves.
    """
    spark = index.sparkSession
    table = leaf_table(spark, tree)
    terms = sorted({x.term for x in number(tree)})
    lengths = None
    occurrences = index
    if isinstance(index, Corpus):
        occurrences, lengths = index.occurrences(terms), index.lengths()
    o = occurrences.where(F.col("term").isin(terms)).join(F.broadcast(table), ["term", "index_type"])
    o = o.where(mask_match(F.col("feature"), F.col("mask")))
    conditioned = F.col("mask") > 0
    case = F.col("dependency") & (F.col("feature").bitwiseAND(F.col("mask")).bitwiseAND(F.lit(CASE_BITS)) != 0)
    same_type = F.col("feature").bitwiseAND(F.lit(TYPE_BITS)) == F.col("mask").bitwiseAND(F.lit(TYPE_BITS))
    weight = F.col("score") * occurrence_weight(F.col("basic"), F.col("dependency"), case, same_type, conditioned, weights)
    docs = o.groupBy("doc").agg(F.max("len").alias("len"), F.array_sort(F.collect_list(F.struct("leaf", "pos", weight.alias("weight"), case.alias("case")))).alias("occ"))
    docs = docs.crossJoin(F.broadcast(statistics(occurrences, tree, compute_df, lengths)))
    e = Evaluator(weights)
    children = [c for c in (tree.children if isinstance(tree, Node) else [tree]) if not optional(c)]
    near = e.near("PROX", children, 100) if len(children) > 1 else F.lit(True)
    found = docs.where(e.holds(tree))
    return found.select("doc", e.score(tree).alias("score"), "len", F.lit(True).alias("strict"), F.coalesce(near, F.lit(False)).alias("proximate"))


def ranked(found: DataFrame, k: int, start: int = 0, pagerank: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """The k best from start on, by final score and then the higher doc: a distributed top-k, no full sort."""
    if pagerank is not None:
        found = found.join(pagerank.select("doc", "rank"), "doc", "left")
        rank = F.coalesce("rank", F.lit(0.0))
    else:
        rank = F.lit(0.0)
    scored = found.withColumn("final", F.round(final_score(F.col("score"), F.col("strict"), F.col("proximate"), rank, weights), 6))
    return scored.orderBy(F.desc("final"), F.desc("doc")).offset(start).limit(k)
