"""Ids, versions, placement and other upkeep of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip_version


def latest_versions(docs: DataFrame, sid: str = "sid", kind: str | None = None) -> DataFrame:
    """The highest version of each id ('-n' behind it, none is 0), for each kind by itself."""
    base = docs.withColumn("_uid", strip_version(F.col(sid))).withColumn("_v", F.coalesce(F.expr(f"try_cast(regexp_extract({sid}, '-([0-9]+)$', 1) AS INT)"), F.lit(0)))
    w = W.partitionBy("_uid", *([kind] if kind else [])).orderBy(F.desc("_v"))
    return base.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_uid", "_v", "_n")


def live_ids(ids: DataFrame, *removed: DataFrame, sid: str = "sid") -> DataFrame:
    for r in removed:
        ids = ids.join(r.select(sid), sid, "left_anti")
    return ids


def select_ids(docs: DataFrame, targets: DataFrame, any_version: bool = False, drop: bool = False) -> DataFrame:
    """docs (sid) named in targets (sid), or those not named; optionally whatever the version."""
    key = strip_version(F.col("sid")) if any_version else F.col("sid")
    wanted = targets.select(key.alias("_key")).distinct()
    return docs.join(wanted, key == F.col("_key"), "left_anti" if drop else "left_semi")


def unfinished(files: DataFrame, manifest: DataFrame, states: tuple[str, ...] = ("success", "error", "timeout", "large_file")) -> DataFrame:
    """Files (file) that the manifest (file, state) does not list as done."""
    return files.join(manifest.where(F.col("state").isin(*states)).select("file"), "file", "left_anti")


def remap(postings: DataFrame, ids: DataFrame, any_version: bool = False) -> DataFrame:
    """Postings (sid) with the dense id of ids (sid, tid); ids that are unknown leave."""
    if not any_version:
        return postings.join(ids, "sid")
    by_uid = ids.select(strip_version(F.col("sid")).alias("_uid"), "tid").groupBy("_uid").agg(F.min("tid").alias("tid"))
    return postings.join(by_uid, strip_version(F.col("sid")) == F.col("_uid")).drop("_uid")


def update_tombstones(urls: DataFrame, url_ids: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids (sid) of removed urls, with those removed before."""
    return urls.join(url_ids, "url").select("sid").union(existing.select("sid")).distinct()


def host_of(docs: DataFrame, boundaries: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """docs (sid) with the host: an exact entry, else the first boundary (upper, host) not below it, else 'none'.

    The boundaries describe hosts, so there are as many rows as machines; they travel as one sorted array.
    """
    ranges = boundaries.agg(F.array_sort(F.collect_list(F.struct("upper", "host"))).alias("ranges"))
    out = docs.crossJoin(F.broadcast(ranges))
    first = F.get(F.filter("ranges", lambda r: r["upper"] >= F.col("sid")), F.lit(0))
    host = first["host"]
    if exact is not None:
        out = out.join(exact.select("sid", F.col("host").alias("_exact")), "sid", "left")
        host = F.coalesce("_exact", host)
    return out.select("sid", F.coalesce(host, F.lit("none")).alias("host"))


def rebalance(old: DataFrame, new: DataFrame) -> DataFrame:
    """sid, action, source, target: copy what is new, delete what is gone, move what has changed host."""
    both = old.select("sid", F.col("host").alias("source")).join(new.select("sid", F.col("host").alias("target")), "sid", "full")
    action = F.when(F.col("source").isNull(), "copy").when(F.col("target").isNull(), "delete").when(F.col("source") != F.col("target"), "move")
    return both.withColumn("action", action).where("action IS NOT NULL").select("sid", "action", "source", "target")


def running_offsets(counts: DataFrame, key: str = "path", n: str = "n", per_file: int = 10_000) -> DataFrame:
    """key, first id (files before it) and target file of each archive; one row an archive."""
    w = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum(n).over(w), F.lit(0))
    return counts.select(key, first.alias("first_id"), F.floor(first / per_file).cast("long").alias("target"))


def islands(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Numbers the runs of equal neighbouring values, as a stream grouped by change of id is read."""
    w = W.orderBy(order)
    return rows.withColumn("run", F.sum(F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def guarded(sentences: DataFrame, longest: int = 5000, most_terms: int = 1000) -> DataFrame:
    """Sentences (doc, sid, sentence) of bearable length whose words are not too many."""
    from ..functions.text import tokens

    return sentences.where((F.octet_length("sentence") <= longest) & (F.size(tokens(F.col("sentence"))) <= most_terms))


def synthetic_ids(meta: DataFrame, by: str, order: str) -> DataFrame:
    """Sentence ids of metadata: -100000, -99998, ... within each document."""
    return meta.withColumn("sid", -100000 + 2 * (F.row_number().over(W.partitionBy(by).orderBy(order)) - 1))
