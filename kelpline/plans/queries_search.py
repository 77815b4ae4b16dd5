"""Registered retrieval and index queries, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as ix
from .execute import hits, ranked
from .tree import OPTIONAL, Leaf, Node

QUERIES: dict = {}
SQL: dict[str, str] = {}
W_ = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
OCC = rf"""
d AS (SELECT doc_id AS doc, {W_} AS ws, 1::BIGINT << (substr(source, 4)::INT % 9) AS feature FROM documents),
o AS (SELECT doc, unnest(ws) AS term, unnest(range(len(ws))) AS pos, feature, len(ws) AS len FROM d),
st AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM d WHERE len(ws) > 0)
"""


def word_df(d: DataFrame) -> DataFrame:
    """term and df of the words of documents."""
    return ix.term_counts(ix.word_lists(d), n=False) if ix.own_ids(d) else ix.document_frequency(ix.word_occurrences(d)).select("term", "df")


def docs(spark, sf_dir: str) -> DataFrame:
    return ix.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def leaf_sql(term: str, weight: float = 1.0, where: str = "TRUE") -> str:
    """doc and score of one leaf."""
    return (
        f"(SELECT doc, 2 * f / (1 * (0.4 + 0.6 * len / (SELECT av FROM st)) + f) * ln(((SELECT n FROM st) - g + 0.5) / (g + 0.5)) AS s FROM "
        f"(SELECT doc, count(*) * {weight} AS f, any_value(len) AS len FROM o WHERE term = '{term}' AND {where} GROUP BY doc), (SELECT count(DISTINCT doc) AS g FROM o WHERE term = '{term}'))"
    )


def top_sql(body: str, k: int = 50, start: int = 0, extra: str = "") -> str:
    return f"WITH {OCC}{extra} SELECT doc, round(score, 6) AS final FROM ({body}) ORDER BY final DESC, doc DESC LIMIT {k} OFFSET {start}"


def top(found: DataFrame, k: int = 50, start: int = 0) -> DataFrame:
    return ranked(found, k, start).select("doc", "final")


A, B, C = "worthless", "trash", "clown"
A_, B_, C_ = (leaf_sql(x) for x in (A, B, C))


def boolean(name: str, tree, body: str, k: int = 50, start: int = 0):
    register(name, top_sql(body, k, start))(lambda spark, sf_dir: top(hits(ix.Corpus(docs(spark, sf_dir)), tree()), k, start))


R, D = "erth", "onth"
R_, D_ = leaf_sql(R), leaf_sql(D)
boolean("search_word", lambda: Leaf(A), f"SELECT doc, s AS score FROM {A_}")
boolean("search_and", lambda: Node("ROOT", [Node("AND", [Leaf(A), Leaf(B)])]), f"SELECT a.doc, a.s + b.s AS score FROM {A_} a JOIN {B_} b USING (doc)")
boolean("search_or", lambda: Node("OR", [Leaf(A), Leaf(B), Leaf(C)]), f"SELECT doc, sum(s) AS score FROM (SELECT * FROM {A_} UNION ALL SELECT * FROM {B_} UNION ALL SELECT * FROM {C_}) GROUP BY doc")
boolean("search_optional", lambda: Node("ROOT", [Leaf(A), Leaf(B, OPTIONAL)]), f"SELECT a.doc, a.s + coalesce(b.s, 0) AS score FROM {A_} a LEFT JOIN {B_} b USING (doc)")
boolean("search_and_of_or", lambda: Node("AND", [Leaf(A), Node("OR", [Leaf(B), Leaf(C)])]), f"SELECT a.doc, a.s + b.s AS score FROM {A_} a JOIN (SELECT doc, sum(s) AS s FROM (SELECT * FROM {B_} UNION ALL SELECT * FROM {C_}) GROUP BY doc) b USING (doc)")
boolean("search_page_2", lambda: Node("OR", [Leaf(A), Leaf(B)]), f"SELECT doc, sum(s) AS score FROM (SELECT * FROM {A_} UNION ALL SELECT * FROM {B_}) GROUP BY doc", 10, 10)
PHRASE_DOCS = "SELECT x.doc FROM o x JOIN o y ON x.doc = y.doc AND y.pos = x.pos + 1 WHERE x.term = 'of' AND y.term = 'the'"
OF, THE = leaf_sql("of"), leaf_sql("the")
boolean("search_phrase", lambda: Node("PHRASE", [Leaf("of"), Leaf("the")]), f"SELECT a.doc, a.s + b.s AS score FROM {OF} a JOIN {THE} b USING (doc) WHERE a.doc IN ({PHRASE_DOCS})", 200)
boolean("search_proximity", lambda: Node("PROX", [Leaf("edth"), Leaf("thed")], 20), f"SELECT a.doc, a.s + b.s AS score FROM {leaf_sql('edth')} a JOIN {leaf_sql('thed')} b USING (doc) WHERE a.doc IN (SELECT x.doc FROM o x JOIN o y USING (doc) WHERE x.term = 'edth' AND y.term = 'thed' AND abs(x.pos - y.pos) <= 20)", 200)
boolean("search_ordered_proximity", lambda: Node("ORDERED_PROX", [Leaf("in"), Leaf("to"), Leaf("the")], 5), f"SELECT a.doc, a.s + b.s + c.s AS score FROM {leaf_sql('in')} a JOIN {leaf_sql('to')} b USING (doc) JOIN {THE} c USING (doc) WHERE a.doc IN (SELECT x.doc FROM o x JOIN o y USING (doc) JOIN o z USING (doc) WHERE x.term = 'in' AND y.term = 'to' AND z.term = 'the' AND y.pos >= x.pos AND z.pos >= y.pos AND z.pos - x.pos <= 5)", 200)
boolean("search_block_filter", lambda: Leaf(A, feature=3), f"SELECT doc, s AS score FROM {leaf_sql(A, where='feature & 3 <> 0')}")

SYNONYMS = [("s1:insult", "idiot"), ("s1:insult", "moron"), ("s1:insult", "stupid"), ("s2:waste", "trash"), ("s2:waste", "scum")]


def with_synonyms(spark, sf_dir: str) -> DataFrame:
    words = ix.word_occurrences(docs(spark, sf_dir))
    table = F.broadcast(spark.createDataFrame(SYNONYMS, "synid string, member string"))
    return words.unionByName(ix.synonym_occurrences(words, table))


@register(
    "search_or_max_synonyms",
    f"""WITH {OCC},
    y AS (SELECT doc, CASE WHEN term IN ('idiot', 'moron', 'stupid') THEN 's1:insult' END AS t2, term, pos, len FROM o WHERE term IN ('idiot', 'moron', 'stupid')),
    kept AS (SELECT doc, 0 AS leaf, 1.0 AS w, len FROM y WHERE term = 'idiot' UNION ALL SELECT doc, 1, 0.99 * 0.9, len FROM y WHERE term <> 'idiot'),
    f AS (SELECT doc, leaf, sum(w) AS f, any_value(len) AS len FROM kept GROUP BY doc, leaf),
    g AS (SELECT 0 AS leaf, count(DISTINCT doc) AS g FROM o WHERE term = 'idiot' UNION ALL SELECT 1, count(DISTINCT doc) FROM y)
    SELECT doc, round(sum(2 * f / ((0.4 + 0.6 * len / (SELECT av FROM st)) + f) * ln(((SELECT n FROM st) - g + 0.5) / (g + 0.5))), 6) AS final
    FROM f JOIN g USING (leaf) GROUP BY doc ORDER BY final DESC, doc DESC LIMIT 50""",
)
def search_or_max(spark, sf_dir: str) -> DataFrame:
    return top(hits(with_synonyms(spark, sf_dir), Node("OR_MAX", [Leaf("idiot"), Leaf("s1:insult", basic=False)])))


@register("search_tombstones", top_sql(f"SELECT doc, s AS score FROM {A_} WHERE doc NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def search_tombstones(spark, sf_dir: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("doc"))
    return top(hits(ix.Corpus(docs(spark, sf_dir)), Leaf(A)).join(gone, "doc", "left_anti"))


@register("search_pagerank", f"WITH {OCC} SELECT doc, round(0.8 * s + 0.2 * 5 * coalesce(quality, 0), 6) AS final FROM {A_} LEFT JOIN (SELECT doc_id AS doc, quality FROM labels) USING (doc) ORDER BY final DESC, doc DESC LIMIT 50")
def search_pagerank(spark, sf_dir: str) -> DataFrame:
    from ..functions.scoring import Weights

    rank = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc"), F.col("quality").cast("double").alias("rank"))
    return ranked(hits(ix.Corpus(docs(spark, sf_dir)), Leaf(A)), 50, 0, rank, Weights(text_share=0.8)).select("doc", "final")


@register("search_except", f"WITH {OCC} SELECT DISTINCT doc FROM o WHERE term = '{A}' EXCEPT SELECT doc FROM o WHERE term = '{B}'")
def search_except(spark, sf_dir: str) -> DataFrame:
    o = ix.word_occurrences(docs(spark, sf_dir), [A, B])
    return o.where(F.col("term") == A).select("doc").distinct().join(o.where(F.col("term") == B).select("doc"), "doc", "left_anti")


@register("search_intersect", f"WITH {OCC} SELECT doc FROM o WHERE term = '{A}' INTERSECT SELECT doc FROM o WHERE term = '{B}'")
def search_intersect(spark, sf_dir: str) -> DataFrame:
    o = ix.word_occurrences(docs(spark, sf_dir), [A, B])
    return o.groupBy("doc").agg(F.countDistinct("term").alias("n")).where("n = 2").select("doc")


@register("hit_count", f"WITH {OCC} SELECT count(DISTINCT doc) AS hits FROM o WHERE term IN ('{A}', '{B}')")
def hit_count(spark, sf_dir: str) -> DataFrame:
    return hits(ix.Corpus(docs(spark, sf_dir)), Node("OR", [Leaf(A), Leaf(B)])).agg(F.count("*").alias("hits"))


@register("index_postings", f"WITH {OCC} SELECT term, doc, count(*)::DOUBLE AS total, any_value(feature) AS feature, list_sort(list(pos)) AS positions FROM o GROUP BY term, doc")
def index_postings(spark, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return ix.document_postings(ix.word_lists(d)) if ix.own_ids(d) else ix.postings(ix.word_occurrences(d)).drop("index_type")


@register("index_document_frequency", f"WITH {OCC} SELECT term, count(DISTINCT doc) AS df FROM o GROUP BY term")
def index_df(spark, sf_dir: str) -> DataFrame:
    return word_df(docs(spark, sf_dir))


@register("index_merge_shard_frequencies", f"WITH {OCC} SELECT term, count(DISTINCT doc) AS df FROM o GROUP BY term")
def index_df_shards(spark, sf_dir: str) -> DataFrame:
    base = docs(spark, sf_dir).withColumn("shard", F.col("doc_id") % 4)
    o = ix.word_occurrences(base).withColumn("shard", F.col("doc") % 4)
    return ix.merge_frequencies(o.groupBy("shard", "term").agg(F.countDistinct("doc").alias("df")))


@register("index_document_length", "SELECT doc_id AS doc, len(ws)::BIGINT AS len FROM (SELECT doc_id, " + W_ + " AS ws FROM documents) WHERE len(ws) > 0")
def index_length(spark, sf_dir: str) -> DataFrame:
    return ix.document_length(ix.word_occurrences(docs(spark, sf_dir)))


@register("index_statistics", "SELECT count(*) AS n_docs, floor(avg(len(ws)))::BIGINT AS average FROM (SELECT " + W_ + " AS ws FROM documents) WHERE len(ws) > 0")
def index_statistics(spark, sf_dir: str) -> DataFrame:
    return ix.corpus_statistics(ix.document_length(ix.word_occurrences(docs(spark, sf_dir))))


DEP = rf"""l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS ws FROM l),
p AS (SELECT doc, ws, unnest(range(1, len(ws))) AS i FROM t WHERE len(ws) > 1)"""


@register("index_dependencies", f"WITH {DEP} SELECT ws[i] || '->' || ws[i + 1] AS term, count(*) AS n, count(DISTINCT doc) AS df FROM p GROUP BY 1")
def index_dependencies(spark, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    if ix.own_ids(d):
        return ix.term_counts(ix.dependency_lists(d))
    return ix.dependency_occurrences(d).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("df"))


@register("index_frequency_cut", f"WITH {DEP} SELECT ws[i] || '->' || ws[i + 1] AS term, count(DISTINCT doc) AS df FROM p GROUP BY 1 HAVING count(DISTINCT doc) > 2")
def index_cut(spark, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    df = ix.term_counts(ix.dependency_lists(d), n=False) if ix.own_ids(d) else ix.document_frequency(ix.dependency_occurrences(d)).select("term", "df")
    return ix.cut_frequencies(df, dependency_above=2)


HYGIENE_BAD = r"df < 4 OR (regexp_matches(term, '^[0-9]{5,}$') AND df < 100000) OR regexp_matches(term, '[A-Za-z]{15,}')"


@register("index_term_hygiene", f"WITH {OCC}, f AS (SELECT term, count(DISTINCT doc) AS df FROM o GROUP BY term) SELECT term, df FROM f WHERE NOT ({HYGIENE_BAD})")
def index_hygiene(spark, sf_dir: str) -> DataFrame:
    return ix.hygiene(word_df(docs(spark, sf_dir)))


@register("index_text_lines", f"WITH {OCC}, p AS (SELECT term, doc, doc || ':' || printf('%.2f', count(*)::DOUBLE) || '@0#' || string_agg(pos || '&1', ',' ORDER BY pos) AS x FROM o GROUP BY term, doc) SELECT term, term || ' ' || string_agg(x, ' ' ORDER BY doc) AS line FROM p GROUP BY term")
def index_text_lines(spark, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    if ix.own_ids(d):
        posts = ix.document_postings(ix.word_lists(d)).select("term", "doc", "total", F.transform("positions", lambda p: F.struct(p.alias("pos"), F.lit(1.0).alias("score"))).alias("occ"))
    else:
        posts = ix.word_occurrences(d).groupBy("term", "doc").agg(F.sum("score").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("occ"))
    return ix.text_lines(posts.withColumn("sentences", F.array(F.lit(0))))


@register("index_document_feature", f"WITH {OCC} SELECT doc, bit_or(feature) AS feature FROM o GROUP BY doc")
def index_feature(spark, sf_dir: str) -> DataFrame:
    return ix.word_occurrences(docs(spark, sf_dir)).groupBy("doc").agg(F.bit_or("feature").alias("feature"))


@register("index_dense_ids", "SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS tid FROM (SELECT DISTINCT lpad(doc_id::VARCHAR, 10, '0') AS sid FROM documents)")
def index_dense(spark, sf_dir: str) -> DataFrame:
    from ..functions.text import pad_sid

    return ix.dense_ids(docs(spark, sf_dir).select(pad_sid(F.col("doc_id")).alias("sid")))
