"""Queries of this subpackage, each over its whole table, and SQL twins for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import shared_folder
from .op1_packing import pack
from .op10_token_binary import token_binary
from .op2_brown_lm import brown_perplexity
from .op3_secret_scan import Ledger, report
from .op4_jaccard_join import jaccard_classes
from .op5_rp_forest import nearest_neighbours
from .op6_suffix_dedup import repeated_spans
from .op7_decontaminate import leak_spans
from .op8_chunk_dedup import duplicate_spans
from .op9_toxicity import toxic_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), window=4096)


def op2_brown_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_perplexity(table(spark, sf_dir, "documents"), classes=64, core_words=1024)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier crawl, of half of the sources, fills a ledger; the scan of all documents then leaves its pairs out."""
    docs = table(spark, sf_dir, "documents")
    book = Ledger(spark, f"{shared_folder(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}")
    book.add(docs.where(F.pmod(F.xxhash64("source"), F.lit(2)) == 0))
    return report(book.update(docs))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, threshold=0.5)


def op5_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every row whose id is divisible by 20 asks; all rows are searched
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, queries=F.col("id") % 20 == 0)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), length=50)


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8)


def op8_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents"))


def op10_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"))


def op9_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_train=8000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_related_packing": op1_related_packing,
    "op2_brown_perplexity": op2_brown_perplexity,
    "op3_secret_scan": op3_secret_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_rp_forest_neighbours": op5_rp_forest_neighbours,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_fm_index_decontamination": op7_fm_index_decontamination,
    "op8_gear_chunk_dedup": op8_gear_chunk_dedup,
    "op10_simple8b_tokens": op10_simple8b_tokens,
    "op9_toxic_documents": op9_toxic_documents,
}
SQL: dict[str, str] = {
    "op3_secret_scan": sql.SECRETS_SQL,
    "op4_ngram_jaccard_join": sql.JACCARD_SQL,
    "op6_suffix_array_dedup": sql.SUFFIX_SQL,
    "op7_fm_index_decontamination": sql.DECONTAMINATE_SQL,
}
