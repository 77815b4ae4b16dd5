"""From documents to occurrences, and from occurrences to the tables of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

WORD, DEPENDENCY, ANCHOR_WORD, ANCHOR_DEPENDENCY = 0, 1, 2, 3


def block_bit(source: Column) -> Column:
    """A block-type bit (0 to 8) of a document's source."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.substring(source, 4, 9).cast("int") % 9)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of one small file would keep one core busy.

    A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def word_occurrences(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """doc, pos, term, index_type, score, feature, len: one row a word, its document's length beside it.

    With terms, only these become rows: documents without them are dropped while they are scanned.
    """
    base = docs.select(F.col("doc_id").alias("doc"), "text", block_bit(F.col("source")).alias("feature"))
    base = held(base, "ws", tokens(F.col("text"))).drop("text").withColumn("len", F.size("ws"))
    if terms is not None:
        spots = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda x: x["term"].isin(terms))
        some = base.select("doc", "feature", "len", F.explode(spots).alias("x"))
        return some.select("doc", "x.pos", "x.term", F.lit(WORD).alias("index_type"), F.lit(1.0).alias("score"), "feature", "len")
    return base.select("doc", F.posexplode("ws").alias("pos", "term"), F.lit(WORD).alias("index_type"), F.lit(1.0).alias("score"), "feature", "len")


def dependency_occurrences(docs: DataFrame) -> DataFrame:
    """The same for dependencies, here of each word on the next one of its line, at the first word's position."""
    base = docs.select(F.col("doc_id").alias("doc"), "text", block_bit(F.col("source")).alias("feature"))
    words = lambda x, i: F.transform(tokens(x), lambda w: F.struct(w.alias("w"), i.alias("line")))
    base = held(base, "ws", F.flatten(F.transform(F.split("text", "\n"), words))).drop("text").withColumn("len", F.size("ws"))
    n = F.greatest(F.size("ws") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("ws", F.lit(1), n), F.slice("ws", F.lit(2), n), lambda a, b: F.when(a["line"] == b["line"], F.concat(a["w"], F.lit("->"), b["w"])))
    out = base.select("doc", F.posexplode(pairs).alias("pos", "term"), "feature", "len").where("term IS NOT NULL")
    return out.select("doc", "pos", "term", F.lit(DEPENDENCY).alias("index_type"), F.lit(1.0).alias("score"), "feature", "len")


def held(base: DataFrame, name: str, value: Column) -> DataFrame:
    """base with a column out of a generator, evaluated once: a projection would be folded into later lambdas and filters."""
    return base.select("*", F.explode(F.array(value)).alias(name))


def own_ids(docs: DataFrame) -> bool:
    """No doc_id is repeated (a missing one counts as one). Reads this column alone, at once."""
    return (docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0) <= 1


def word_lists(docs: DataFrame) -> DataFrame:
    """doc, feature and terms: a document's words in order, one row a document."""
    base = docs.select(F.col("doc_id").alias("doc"), block_bit(F.col("source")).alias("feature"), "text")
    return held(base, "terms", tokens(F.col("text"))).drop("text")


def dependency_lists(docs: DataFrame) -> DataFrame:
    """The same of dependencies of each word on the next one of its line."""
    base = docs.select(F.col("doc_id").alias("doc"), block_bit(F.col("source")).alias("feature"), "text")

    def pairs(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - 1, F.lit(0))
        return F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.concat(a, F.lit("->"), b))

    lines = F.transform(F.split("text", "\n"), tokens)
    return held(base, "terms", F.flatten(F.transform(lines, pairs))).drop("text")


def term_counts(lists: DataFrame, n: bool = True) -> DataFrame:
    """term, n (occurrences, if asked for) and df of lists of documents with ids of their own: counts are added before
    the exchange, so that it holds a term of a task once and no document."""
    if not n:
        return lists.select("doc", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("doc").alias("df"))
    both = lists.select("doc", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("k", "ts")).select("doc", "k", F.explode("ts").alias("term"))
    return both.groupBy("term").agg(F.count_if(F.col("k") == 0).alias("n"), F.count(F.when(F.col("k") == 1, F.col("doc"))).alias("df"))


def document_postings(lists: DataFrame) -> DataFrame:
    """term, doc, total, feature, positions of lists of documents with ids of their own, grouped within each row."""
    at = F.sort_array(F.transform("terms", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))
    base = held(lists, "at", at).drop("terms")
    first = F.transform("at", lambda x, i: F.when((i == 0) | (x["term"] != F.get("at", i - 1)["term"]), i))
    base = held(base, "starts", F.filter(first, lambda i: i.isNotNull()))

    def posting(s: Column, k: Column) -> Column:
        n = F.coalesce(F.get("starts", k + 1), F.size("at")) - s
        return F.struct(F.get("at", s)["term"].alias("term"), n.cast("double").alias("total"), F.transform(F.slice("at", s + 1, n), lambda x: x["pos"]).alias("positions"))

    out = base.select("doc", "feature", F.explode(F.transform("starts", posting)).alias("p"))
    return out.select("p.term", "doc", "p.total", "feature", "p.positions")


def synonym_occurrences(words: DataFrame, synonyms: DataFrame, score: float = 0.99) -> DataFrame:
    """Occurrences of synonym nodes at their members' positions; synonyms: synid, member."""
    return words.join(synonyms, words["term"] == synonyms["member"]).select("doc", "pos", F.col("synid").alias("term"), "index_type", F.lit(score).alias("score"), "feature", "len")


def anchor_occurrences(links: DataFrame, doc: str = "dst_sid") -> DataFrame:
    """Words of the anchors that lead to a document, each scored by the number of its linking pages."""
    base = links.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc"), "anchor").agg(F.countDistinct("src_sid").alias("n"))
    return base.select("doc", F.posexplode(tokens(F.col("anchor"))).alias("pos", "term"), F.lit(ANCHOR_WORD).alias("index_type"), F.col("n").cast("double").alias("score"), F.lit(0).cast("long").alias("feature"), F.lit(0).alias("len"))


class Corpus:
    """Documents as an index without a stored one: occurrences of chosen terms, and lengths without any explode."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.sparkSession = docs.sparkSession

    def occurrences(self, terms: list[str]) -> DataFrame:
        return word_occurrences(self.docs, terms)

    def lengths(self) -> DataFrame:
        return self.docs.select(F.col("doc_id").alias("doc"), F.size(tokens(F.col("text"))).alias("len")).where("len > 0")


def last_wins(occurrences: DataFrame, order: str) -> DataFrame:
    """Of occurrences with one (doc, term, pos) the last by `order`."""
    w = W.partitionBy("doc", "index_type", "term", "pos").orderBy(F.desc(order))
    return occurrences.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def postings(occurrences: DataFrame) -> DataFrame:
    """index_type, term, doc, total, feature (bits of all occurrences), positions in order."""
    return occurrences.groupBy("index_type", "term", "doc").agg(F.sum("score").alias("total"), F.bit_or("feature").alias("feature"), F.array_sort(F.collect_set("pos")).alias("positions"))


def write_index(occurrences: DataFrame, path: str) -> None:
    """Postings as Parquet: a folder for each index type, ranges of terms in order, so that lookups skip row groups."""
    postings(occurrences).repartitionByRange("index_type", "term").sortWithinPartitions("term", "doc").write.partitionBy("index_type").mode("overwrite").parquet(path)


def lookup(path: str, spark, terms: list[str], index_type: int = WORD) -> DataFrame:
    """Postings of some terms: the folder is pruned and the term filter reaches the scan."""
    return spark.read.parquet(path).where((F.col("index_type") == index_type) & F.col("term").isin(terms))


def document_frequency(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("index_type", "term").agg(F.countDistinct("doc").alias("df"))


def merge_frequencies(shards: DataFrame) -> DataFrame:
    """Frequencies of several shards (term, df) as one table."""
    return shards.groupBy("term").agg(F.sum("df").alias("df"))


def cut_frequencies(df: DataFrame, dependency_above: int = 0, synonym_above: int = 9) -> DataFrame:
    """Words stay unless they hold '?'; dependencies and synonym dependencies need more documents than given."""
    t = F.col("term")
    dep = t.contains("->")
    keep = F.when(dep & t.rlike(r"^s\d+:"), F.col("df") > synonym_above).when(dep, F.col("df") > dependency_above).otherwise(~t.contains("?"))
    return df.where(keep)


def document_length(occurrences: DataFrame) -> DataFrame:
    """Sum of the scores of a document's surface words, cut to an integer."""
    return occurrences.where(F.col("index_type") == WORD).groupBy("doc").agg(F.floor(F.sum("score")).cast("long").alias("len"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.floor(F.avg("len")).cast("long").alias("average"))


def merge_indexes(*parts: DataFrame) -> DataFrame:
    """Postings of several indexes as one: equal (term, doc) add their totals and unite their positions."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("index_type", "term", "doc").agg(F.sum("total").alias("total"), F.bit_or("feature").alias("feature"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


def text_lines(posts: DataFrame) -> DataFrame:
    """Lines 'term doc:total@sentences#pos&score,...' of an index, one a term, in order of documents.

    posts: term, doc, total, sentences, occ (array of pos, score).
    """
    occ = F.array_join(F.transform("occ", lambda o: F.concat(o["pos"].cast("string"), F.lit("&"), F.call_function("format_number", o["score"], F.lit("0.##")))), ",")
    one = F.concat(F.col("doc").cast("string"), F.lit(":"), F.format_string("%.2f", "total"), F.lit("@"), F.array_join(F.transform("sentences", lambda s: s.cast("string")), ","), F.lit("#"), occ)
    lines = posts.select("term", "doc", one.alias("posting")).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc", "posting"))).alias("ps"))
    return lines.select("term", F.concat(F.col("term"), F.lit(" "), F.array_join(F.transform("ps", lambda p: p["posting"]), " ")).alias("line"))


def read_text_lines(lines: DataFrame) -> DataFrame:
    """The inverse: term, doc, total, sentences, pos, score, feature of every occurrence of such lines (column value)."""
    base = lines.select(F.split_part("value", F.lit(" "), F.lit(1)).alias("term"), F.explode(F.slice(F.split("value", " "), 2, 1 << 30)).alias("p"))
    head, tail = F.split_part("p", F.lit("#"), F.lit(1)), F.split_part("p", F.lit("#"), F.lit(2))
    base = base.select("term", F.split_part(head, F.lit(":"), F.lit(1)).alias("doc"), F.split_part(F.split_part(head, F.lit("@"), F.lit(1)), F.lit(":"), F.lit(2)).cast("double").alias("total"), F.split(F.split_part(head, F.lit("@"), F.lit(2)), ",").cast("array<int>").alias("sentences"), F.explode(F.split(tail, ",")).alias("o"))
    part = lambda i: F.split_part("o", F.lit("&"), F.lit(i))
    return base.select("term", "doc", "total", "sentences", part(1).cast("int").alias("pos"), part(2).cast("double").alias("score"), F.coalesce(F.expr("try_cast(split_part(o, '&', 3) AS BIGINT)"), F.lit(0).cast("long")).alias("feature"))


def well_formed(term: Column) -> Column:
    """Terms that an index may hold: not empty, no bare end of a dependency."""
    return (term != "") & ~term.rlike(r"^->|->$")


def hygiene(df: DataFrame, least: int = 4) -> DataFrame:
    """Terms of an index worth keeping, by frequency and by shape; dependencies need both their ends."""
    t, n = F.col("term"), F.col("df")
    symbols = F.length(F.regexp_replace(t, r"[\p{L}\p{N}]", "")) * 2 > F.length(t)
    bad = (n < least) | (t.rlike(r"^[0-9]{5,}$") & (n < 100000)) | t.rlike("[ァ-ヺ]{20,}") | t.rlike(r"[A-Za-z]{15,}") | t.rlike(r"^[A-Za-z]+(\+[A-Za-z]+){9,}$") | symbols
    # a filter stays above the generator, so that words and dependencies read one exchange of counts and not the texts again
    df = held(df, "_kind", F.when(t.contains("->"), F.when(n >= least, "dependency")).when(~bad, "word"))
    words = df.where("_kind = 'word'").drop("_kind")
    known = words.select(F.col("term").alias("_t"))
    deps = df.where("_kind = 'dependency'").drop("_kind")
    deps = deps.join(known, F.split_part("term", F.lit("->"), F.lit(1)) == F.col("_t"), "left_semi").join(known, F.split_part("term", F.lit("->"), F.lit(2)) == F.col("_t"), "left_semi")
    return words.unionByName(deps)


def dense_ids(docs: DataFrame, column: str = "sid") -> DataFrame:
    """column and tid, numbered from 0 in order, without one global sort in one task."""
    ordered = docs.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    ordered = ordered.withColumn("_p", F.spark_partition_id())
    ordered = ordered.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1)
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row a partition: a table of the cluster's width, not of the data's size
    base = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ordered.join(F.broadcast(base), "_p").select(column, (F.col("_i") + F.col("_b")).alias("tid"))
