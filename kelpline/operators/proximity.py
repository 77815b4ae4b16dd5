"""Position operators over occurrences (doc, pos, term): one sort by document and position each, no position products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_pos():
    return W.partitionBy("doc").orderBy("pos", "term")


def minimum_forward_distance(o: DataFrame, first: str, second: str) -> DataFrame:
    """doc and the least p2 - p1 with p2 >= p1, null where no pair runs forward; documents hold both terms."""
    own = o.where(F.col("term").isin(first, second))
    # at one position the first term comes first, so equal positions count as distance 0
    w = W.partitionBy("doc").orderBy("pos", (F.col("term") != first).cast("int")).rowsBetween(W.unboundedPreceding, 0)
    before = F.last(F.when(F.col("term") == first, F.col("pos")), ignorenulls=True).over(w)
    own = own.withColumn("d", F.when(F.col("term") == second, F.col("pos") - before))
    both = own.groupBy("doc").agg(F.min("d").alias("distance"), F.countDistinct("term").alias("n"))
    return both.where(F.col("n") == (2 if first != second else 1)).select("doc", "distance")


def adjacent_distance(o: DataFrame, a: str, b: str) -> DataFrame:
    """doc and the least gap between neighbouring occurrences of the two terms, in either direction."""
    own = o.where(F.col("term").isin(a, b)).withColumn("lag_pos", F.lag("pos").over(_by_pos())).withColumn("lag_term", F.lag("term").over(_by_pos()))
    return own.where(F.col("lag_term") != F.col("term")).groupBy("doc").agg(F.min(F.col("pos") - F.col("lag_pos")).alias("distance"))


def tightest_region(o: DataFrame, terms: list[str], near: int) -> DataFrame:
    """doc, begin and end_pos of the shortest region with all terms, its width under `near` (ties: the last one)."""
    own = o.where(F.col("term").isin(terms))
    # each position with the next position of every term from there on
    w = _by_pos().rowsBetween(0, W.unboundedFollowing)
    ends = [F.first(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(w) for t in terms]
    own = own.select("doc", F.col("pos").alias("begin"), (F.greatest(*ends) if len(ends) > 1 else ends[0]).alias("end_pos"), reduce(lambda a, b: a & b, [e.isNotNull() for e in ends]).alias("whole"))
    own = own.where(F.col("whole") & (F.col("end_pos") - F.col("begin") < near))
    best = own.groupBy("doc").agg(F.min_by(F.struct("begin", "end_pos"), F.struct((F.col("end_pos") - F.col("begin")).alias("w"), (-F.col("begin")).alias("b"))).alias("r"))
    return best.select("doc", "r.begin", "r.end_pos")


def chained_near(o: DataFrame, terms: list[str], budget: int) -> DataFrame:
    """Documents where the terms follow each other in order and their gaps together stay within one budget."""
    places = o.where(F.col("term").isin(terms)).groupBy("doc").agg(*(F.array_sort(F.collect_set(F.when(F.col("term") == t, F.col("pos")))).alias(f"p{i}") for i, t in enumerate(terms)))

    def last(p):
        return reduce(lambda at, i: F.array_min(F.filter(f"p{i}", lambda y: y > at)), range(1, len(terms)), p)

    return places.where(F.exists("p0", lambda p: F.coalesce(last(p) - p <= budget, F.lit(False)))).select("doc")


def phrase_by_key(o: DataFrame, terms: list[str]) -> DataFrame:
    """doc and begin of every phrase: occurrences meet on their position less their place in the phrase, in one exchange."""
    spark = o.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int"))
    keyed = o.join(table, "term").select("doc", (F.col("pos") - F.col("place")).alias("begin"), "place")
    return keyed.groupBy("doc", "begin").agg(F.countDistinct("place").alias("n")).where(F.col("n") == len(terms)).select("doc", "begin")


def band_pairs(o: DataFrame, partners: DataFrame, reach: int = 100) -> DataFrame:
    """Occurrence pairs of coordinate terms at most `reach` positions apart; partners: term, partner.

    A band join by position buckets: each occurrence meets its own bucket and the two next to it.
    """
    left = o.join(partners, "term").select("doc", F.col("pos").alias("pos_a"), F.col("term").alias("term_a"), F.col("partner").alias("term_b"), F.explode(F.array(*(F.floor(F.col("pos") / reach) + k for k in (-1, 0, 1)))).alias("slot"))
    right = o.select("doc", F.col("pos").alias("pos_b"), F.col("term").alias("term_b"), F.floor(F.col("pos") / reach).alias("slot"))
    return left.join(right, ["doc", "term_b", "slot"]).where(F.abs(F.col("pos_a") - F.col("pos_b")) <= reach).select("doc", "term_a", "pos_a", "term_b", "pos_b")
