"""Incremental secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  A ledger holds the pairs of blob and
rule version that were scanned, with their findings.  A scan takes one copy of each blob, leaves out the
pairs that the ledger has, runs the other rules, and joins old and new findings back to all paths that hold
the blob.  Rules are regular expressions of the RE2 and Java common subset, run inside the JVM; those with literals
that must occur run only where one does.  Updates of a ledger at the same time may scan a pair twice; it counts once.

Defined results: a row without text has no blob and no findings; an empty text is a blob without findings; texts are
scanned whole, whatever their length; rows without a path are scanned, as their text may be another's, but not
reported.  Repeated rows are one path and are reported once; a secret that occurs several times in a text is one
finding with that count, under each rule that it matches.  An empty table has no findings.  Columns other than those named
are not read, and redact returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cleaning, shared_folder


@dataclass(frozen=True)
class Rule:
    """A secret's pattern, what stands before it, and literals one of which is in every match."""

    name: str
    version: int
    before: str
    secret: str
    needles: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    @property
    def pattern(self) -> str:
        """Group 1 is the secret."""
        return f"{self.before}({self.secret})"


#: A value of 6 characters or more with a digit among them: by the characters before the first digit.
_DIGITS = "|".join([*(rf"[^\s\x22',;0-9]{{{k}}}[0-9][^\s\x22',;]{{{5 - k},}}" for k in range(5)), r"[^\s\x22',;0-9]{5,}[0-9][^\s\x22',;]*"])
_PASSWORD = r"(?i)(?:password|passwd|pwd)[\w-]{0,32}[\x22']?"

RULES: tuple[Rule, ...] = (
    Rule("aws_access_key", 1, r"\b", r"(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"\b", r"gh[pousr]_[A-Za-z0-9]{36,}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"\b", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google_api_key", 1, r"\b", r"AIza[0-9A-Za-z_\-]{35}\b", ("AIza",)),
    Rule("stripe_key", 1, r"\b", r"[rs]k_live_[0-9a-zA-Z]{24,}\b", ("k_live_",)),
    Rule("json_web_token", 1, r"\b", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    # from BEGIN to END, or, where the end is missing, the lines that can be of the key
    Rule("private_key", 2, "", r"(?s:-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:.*?-----END [A-Z ]{0,32}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*))", ("PRIVATE KEY-----",)),
    Rule("password_assignment", 2, _PASSWORD + r"(?:\s*(?:=>|:=|=)\s*[\x22']?|\s*:\s*[\x22'])", r"[^\s\x22',;]{6,}"),
    # behind a colon, a word of prose is no password
    Rule("password_line", 1, _PASSWORD + r"\s*:\s*", _DIGITS),
    Rule("token_assignment", 2, r"(?i)(?:api[_-]?key|secret|token)[\w-]{0,32}[\x22']?\s*(?:=>|:=|[=:])\s*[\x22']?", r"[A-Za-z0-9_\-]{16,}"),
)
LEDGER = "blob string, rule string, secrets array<string>"


def _found(text: Column, rule: Rule) -> Column:
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1))
    if not rule.needles:
        return hits
    has = reduce(or_, (F.contains(text, F.lit(x)) for x in rule.needles))
    return F.when(has, hits).otherwise(F.array().cast("array<string>"))


def versions(docs: DataFrame, path: str = "doc_id", repository: str | None = "source") -> DataFrame:
    """path, repository, blob and text of every row with a text."""
    repo = F.col(repository).cast("string") if repository and repository in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    return docs.select(F.col(path).alias("path"), repo.alias("repository"), F.sha2(text, 256).alias("blob"), text.alias("text")).where("text IS NOT NULL")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", repository: str | None = "source") -> DataFrame:
    """The ledger's new entries: (blob, rule, secrets) of every pair that it has not.

    One copy of each blob travels, and copies beyond the first are dropped before the exchange already.
    """
    seen = versions(docs, path, repository).select("blob", "text")
    one = seen.withColumn("_n", F.row_number().over(W.partitionBy("blob").orderBy("blob"))).where("_n = 1")
    if ledger is not None:
        done = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        one = one.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>"))).where(F.size("done") < len(rules))
    else:
        one = one.withColumn("done", F.array().cast("array<string>"))
    fresh = [
        F.when(F.array_contains("done", F.lit(r.key)), F.lit(None)).otherwise(F.struct(F.lit(r.key).alias("rule"), _found(F.col("text"), r).alias("secrets")))
        for r in rules
    ]
    return one.select("blob", F.explode(F.array_compact(F.array(*fresh))).alias("f")).select("blob", "f.rule", "f.secrets")


def findings(docs: DataFrame, entries: DataFrame, path: str = "doc_id", repository: str | None = "source") -> DataFrame:
    """path, repository, blob, rule, secret and number of occurrences in each path's text."""
    hits = (
        entries.where(F.size("secrets") > 0)
        .dropDuplicates(["blob", "rule"])
        .select("blob", F.split_part("rule", F.lit("@"), F.lit(1)).alias("rule"), F.explode("secrets").alias("secret"))
        .groupBy("blob", "rule", "secret")
        .agg(F.count("*").alias("occurrences"))
    )
    paths = versions(docs, path, repository).select("path", "repository", "blob").where("path IS NOT NULL").distinct()
    return paths.join(hits, "blob")


def report(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").cast("long").alias("doc_id"), F.col("repository").alias("source"), "blob", "rule", "secret", "occurrences")


def secret_findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, source, blob, rule, secret and occurrences of all findings, old ones of the ledger included."""
    entries = scan(docs, ledger, rules)
    if ledger is not None:
        entries = entries.unionByName(ledger.where(F.col("rule").isin([r.key for r in rules])))
    return report(findings(docs, entries))


class Ledger:
    """A ledger kept as Parquet: each scan appends the pairs it did, so that none is done twice."""

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path or shared_folder(spark).rstrip("/") + "/secret-ledger"

    def read(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def add(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans what is new and appends it."""
        with cleaning(self.spark):
            scan(docs, self.read(), rules).select("*").write.mode("append").parquet(self.path)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is new, appends it, and returns the findings of docs."""
        self.add(docs, rules)
        return findings(docs, self.read().where(F.col("rule").isin([r.key for r in rules])))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by [rule] where it was found, and n_chars counted again in rows that changed.

    Blobs are scanned once; only rows whose blob has findings are rewritten, rule by rule.
    """
    entries = scan(docs, None, rules, path="text", repository=None)
    dirty = entries.where(F.size("secrets") > 0).groupBy("blob").agg(F.count("*").alias("hits"))
    # the row travels as one struct, so that no column of docs can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(F.col("text").cast("string"), 256).alias("blob"))
    joined = whole.join(dirty, "blob", "left")

    found = F.col("hits").isNotNull()
    text = reduce(lambda t, r: F.regexp_replace(t, f"({r.before})(?:{r.secret})", f"$1[{r.name}]"), rules, F.col("row.text").cast("string"))
    out = joined.withColumn("clean", F.when(found, text))

    def column(c: str) -> Column:
        kept = F.col("row").getField(c)
        if c == "text":
            return F.when(found, F.col("clean")).otherwise(kept).alias(c)
        if c == "n_chars":
            return F.when(found, F.length("clean").cast(docs.schema[c].dataType)).otherwise(kept).alias(c)
        return kept.alias(c)

    return out.select(*map(column, docs.columns))
