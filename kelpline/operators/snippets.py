"""Sentences, their scores, snippets and keywords in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import sentence_score
from ..functions.text import tokens


def sentences(docs: DataFrame) -> DataFrame:
    """doc, sid, para, sentence: lines are paragraphs, sentences end at '. '; sid runs over the document."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("para", "line"))
    parts = lines.select("doc", "para", F.posexplode(F.split("line", r"\. ")).alias("k", "sentence")).where(F.col("sentence") != "")
    return parts.withColumn("sid", F.row_number().over(W.partitionBy("doc").orderBy("para", "k")) - 1).drop("k")


def matched(sents: DataFrame, terms: list[str]) -> DataFrame:
    """Adds matches, kinds (distinct terms), covered (all terms) and score to sentences."""
    ws = tokens(F.col("sentence"))
    found = F.filter("ws", lambda w: w.isin(terms))
    out = sents.withColumn("ws", ws).withColumn("hit", found)
    kinds, n = F.size(F.array_distinct("hit")), F.size("hit")
    out = out.withColumn("matches", n).withColumn("kinds", kinds).withColumn("covered", kinds == len(set(terms)))
    score = F.when(n > 0, sentence_score(F.col("kinds"), F.col("matches"), F.greatest(F.size("ws"), F.lit(1)))).otherwise(0.0)
    return out.withColumn("score", score).drop("ws", "hit")


def smoothed(scored: DataFrame, window: int = 5) -> DataFrame:
    """Adds smooth: each sentence gives score / 2^j to the sentences j away in its run of one paragraph."""
    by = W.partitionBy("doc").orderBy("sid")
    run = F.sum(F.when(F.lag("para").over(by) == F.col("para"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    out = scored.withColumn("run", run)
    own = W.partitionBy("doc", "run").orderBy("sid")
    total = F.col("score")
    for j in range(1, window + 1):
        total = total + (F.coalesce(F.lag("score", j).over(own), F.lit(0.0)) + F.coalesce(F.lead("score", j).over(own), F.lit(0.0))) / 2.0**j
    return out.withColumn("smooth", total).drop("run")


def paragraph_starts(sents: DataFrame) -> DataFrame:
    by = W.partitionBy("doc").orderBy("sid")
    return sents.withColumn("first", F.coalesce(F.lag("para").over(by) != F.col("para"), F.lit(True)))


def until_first_hit(scored: DataFrame, window: int) -> DataFrame:
    """Sentences up to `window` after the document's first one with a score: no more need be read."""
    stop = F.min(F.when(F.col("score") > 0, F.col("sid"))).over(W.partitionBy("doc"))
    return scored.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("sid") <= F.col("_stop") + window)).drop("_stop")


def without_blank(sents: DataFrame, most: float = 0.2) -> DataFrame:
    """Sentences that are mostly white space go unless they match; equal ones of a document count once."""
    blank = F.length(F.regexp_replace("sentence", r"[^\s]", "")) / F.greatest(F.length("sentence"), F.lit(1))
    kept = sents.where((F.col("kinds") > 0) | (blank <= most))
    w = W.partitionBy("doc", "sentence").orderBy("sid")
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def snippets(scored: DataFrame, best: int = 3, words: int = 80) -> DataFrame:
    """doc and snippet: the best sentences by smooth, in text order, ' ... ' at gaps, within a budget of words."""
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("smooth"), "sid"))
    top = scored.where("smooth > 0").withColumn("_r", rank).where(F.col("_r") <= best)
    used = F.sum(F.size(tokens(F.col("sentence")))).over(W.partitionBy("doc").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    top = top.withColumn("_u", F.coalesce(used, F.lit(0))).where(F.col("_u") < words)
    lag = F.lag("sid").over(W.partitionBy("doc").orderBy("sid"))
    piece = F.concat(F.when(F.col("sid") - F.col("_lag") > 1, " ... ").when(F.col("_lag").isNull(), "").otherwise(" "), F.col("sentence"))
    top = top.withColumn("_lag", lag).select("doc", "sid", piece.alias("piece"))
    return top.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sid", "piece"))), lambda x: x["piece"]), "").alias("snippet"))


def kwic(docs: DataFrame, pattern: list[str], width: int = 5) -> DataFrame:
    """doc, pos, left, keyword, right of every run of words that matches the pattern; '*' matches any word."""
    n = len(pattern)
    base = docs.select(F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("ws")).where(F.size("ws") >= n)
    fixed = [(i, p) for i, p in enumerate(pattern) if p != "*"]
    if fixed:
        base = base.where(F.array_contains("ws", fixed[0][1]))

    def here(s: Column) -> Column:
        test = F.lit(True)
        for i, p in fixed:
            test = test & (F.element_at("ws", (s + i + 1).cast("int")) == p)
        return test

    spots = F.filter(F.sequence(F.lit(0), F.size("ws") - n), here)
    hit = base.withColumn("pos", F.explode(spots))
    join = lambda c: F.array_join(c, " ")
    return hit.select(
        "doc",
        "pos",
        join(F.slice("ws", F.greatest(F.col("pos") - width, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(width)))).alias("left"),
        join(F.slice("ws", F.col("pos") + 1, F.lit(n))).alias("keyword"),
        join(F.slice("ws", F.col("pos") + n + 1, F.lit(width))).alias("right"),
    )


def sort_kwic(rows: DataFrame, by_left: bool = False) -> DataFrame:
    """By right context, or by the left one read backwards."""
    return rows.orderBy(F.reverse("left") if by_left else F.col("right"), "doc", "pos")


def hit_region(begin: Column, end: Column, width: int = 80) -> tuple[Column, Column]:
    """A region of `width` words round a hit, not before the text's start."""
    pad = F.floor((width - (end - begin)) / 2)
    return F.greatest(F.lit(0), begin - pad), end + pad
