"""Web pages: crawl files, titles, text, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import resolve_url, unescape_basic


def read_crawl(spark, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Crawl files: an 'HTML <url>' line, header lines, a blank line, the page; control characters go."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.decode("content", encoding)
    head = F.split_part(text, F.lit("\n\n"), F.lit(1))
    crawled = text.rlike(r"^HTML \S+")
    body = F.when(crawled, F.substring(text, F.length(head) + 3, F.length(text))).otherwise(text)
    return raw.select(
        "path",
        F.nullif(F.regexp_extract(text, r"^HTML (\S+)", 1), F.lit("")).alias("url"),
        F.nullif(F.regexp_extract(head, r"(?m)^Date: *(.*?)\r?$", 1), F.lit("")).alias("date"),
        F.regexp_replace(body, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("html"),
    )


def assign_ids(files: DataFrame, per_folder: int = 10_000) -> DataFrame:
    """path and sid: ten digits, the folder's number and the file's, by the order of paths."""
    from ..operators.index import dense_ids

    n = dense_ids(files, "path")
    return n.select("path", F.concat(F.lpad(F.floor(F.col("tid") / per_folder).cast("string"), 6, "0"), F.lpad((F.col("tid") % per_folder).cast("string"), 4, "0")).alias("sid"))


def unzip(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Members of zip archives (columns path, content): path, member, html; only .html files, all of them or the first `limit` each."""
    import io
    import zipfile

    import pandas as pd

    def run(it):
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith((".html", ".htm")))
                    rows += [(path, n, z.read(n).decode("utf-8", "replace")) for n in names[:limit]]
            yield pd.DataFrame(rows, columns=["path", "member", "html"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, html string")


def title(html: Column) -> Column:
    """The page's title, blanks as underscores; 'none' where there is none."""
    t = F.trim(unescape_basic(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(F.regexp_replace(t, r"\s+", "_"), F.lit("")), F.lit("none"))


def plain_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape_basic(F.regexp_replace(x, r"(?s)<[^>]+>", " ")), r"\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """src_sid, src_url, n, href, anchor of every <a href> of the pages (page_id, url, html)."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(1))
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(2))
    both = pages.select(F.col("page_id").alias("src_sid"), F.col("url").alias("src_url"), F.posexplode(F.arrays_zip(hrefs.alias("href"), anchors.alias("anchor"))).alias("n", "x"))
    return both.select("src_sid", "src_url", "n", F.col("x.href").alias("href"), F.regexp_replace("x.anchor", "<[^>]+>", "").alias("anchor"))


def link_table(pages: DataFrame) -> DataFrame:
    """src_sid, src_url, dst_sid, dst_url, anchor: links resolved against their page, with the target's id if known."""
    out = links(pages).withColumn("dst_url", resolve_url("src_url", "href"))
    known = pages.groupBy(F.col("url").alias("dst_url")).agg(F.min("page_id").alias("dst_sid"))
    return out.join(known, "dst_url", "left").select("src_sid", "src_url", "dst_sid", "dst_url", "anchor")


def in_links(table: DataFrame) -> DataFrame:
    """For each target and anchor the pages that link, as a document carries them."""
    return table.where("dst_sid IS NOT NULL").groupBy("dst_sid", "anchor").agg(F.array_sort(F.collect_set("src_sid")).alias("dids"))


def newest(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy(F.desc("page_id")))).where("_n = 1").drop("_n")
