"""What happens to ranked rows: folding, numbering, paging; and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise_url


def fold_by_url(rows: DataFrame, url: str = "url", score: str = "score", doc: str = "doc") -> DataFrame:
    """The best row of each normalised URL, the others' ids in similar, in order."""
    out = rows.withColumn("key", normalise_url(F.col(url)))
    out = out.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.desc(score), F.desc(doc))))
    others = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("n", F.col(doc).alias("doc")))))
    best = out.groupBy("key").agg(F.min_by(F.struct(*rows.columns), "n").alias("best"), others.alias("o"))
    return best.select("key", "best.*", F.transform("o", lambda x: x["doc"]).alias("similar"))


def fold_titles(rows: list[dict], gap: float = 0.05, most: int = 1000) -> list[dict]:
    """A page of ranked rows: one with the last kept row's title and a score less than `gap` below joins it.

    The rule depends on what was kept before, so it runs over the one page that is shown (at most `most` rows).
    """
    if len(rows) > most:
        raise ValueError(f"a page holds at most {most} rows")
    kept: list[dict] = []
    for r in rows:
        if kept and r["title"] == kept[-1]["title"] and kept[-1]["score"] - r["score"] < gap:
            kept[-1]["similar"].append(r["doc"])
        else:
            kept.append({**r, "similar": []})
    return kept


def numbered(rows: DataFrame, k: int, score: str = "score", doc: str = "doc", start: int = 0) -> DataFrame:
    """A page of the best rows with its ranks; only the page reaches the one task that numbers it."""
    page = rows.orderBy(F.desc(score), F.desc(doc)).offset(start).limit(k)
    return page.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), F.desc(doc))) + start)


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def by_cluster(rows: DataFrame, clusters: DataFrame, wanted: list[str]) -> DataFrame:
    return rows.join(clusters.where(F.col("cluster").isin(wanted)).select("doc"), "doc", "left_semi")


def parameters(log: DataFrame, column: str = "line") -> DataFrame:
    """Log lines 'date host owner k=v,k=v...' as columns and a map."""
    part = lambda i: F.split_part(column, F.lit(" "), F.lit(i))
    return log.select(part(1).alias("date"), part(2).alias("host"), part(3).alias("owner"), F.str_to_map(part(4), F.lit(","), F.lit("=")).alias("options"))


def congestion(events: DataFrame, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Requests in the minute up to each request, and the band they fall in; hours bound the sort of one task.

    Each event also goes to the next hour as context, so a minute across the hour counts whole.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    hour = F.floor(at / 3_600_000_000)
    both = events.withColumn("_at", at).withColumn("_part", F.explode(F.array(hour, hour + 1))).withColumn("_own", F.floor(F.col("_at") / 3_600_000_000) == F.col("_part"))
    both = both.where(F.col("_own") | (F.col("_at") >= F.col("_part") * 3_600_000_000 - seconds * 1_000_000))
    w = W.partitionBy("_part").orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = both.withColumn("recent", F.count("*").over(w)).where("_own").drop("_at", "_part", "_own")
    n = F.col("recent")
    return out.withColumn("band", F.when(n <= 2, 0).when(n <= 5, 1).when(n <= 9, 2).when(n <= 19, 3).otherwise(4))


def timings(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))
