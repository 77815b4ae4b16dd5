"""Registered queries of term extraction, stand-off annotation and the search language, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extraction as ex
from ..operators import index as ix
from ..operators import standoff as so
from . import parse as pr
from .execute import hits
from .queries_ops import SENT
from .queries_search import DEP, OCC, docs, leaf_sql, top, top_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("extract_words", rf"WITH {DEP}, z AS (SELECT doc, unnest(ws) AS w FROM t) SELECT w || '*' AS term, count(*) AS n FROM z GROUP BY 1 UNION ALL SELECT w, count(*) FROM z GROUP BY 1")
def extract_words(spark, sf_dir):
    t = ex.token_rows(ex.annotate(docs(spark, sf_dir)), ends=False)
    return ex.word_terms(t).groupBy("term").agg(F.count("*").alias("n"))


@register("extract_dependencies", f"WITH {DEP} SELECT ws[i] || '->' || ws[i + 1] AS term, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT ws[i] || '*->' || ws[i + 1] || '*', count(*) FROM p GROUP BY 1")
def extract_dependencies(spark, sf_dir):
    t = ex.token_rows(ex.annotate(docs(spark, sf_dir)), nodes=False)
    return ex.dependency_terms(t).groupBy("term").agg(F.count("*").alias("n"))


@register("extract_penalties", f"""WITH {DEP}, e AS (SELECT DISTINCT doc, ws[i] AS a, ws[i + 1] AS b FROM p),
m AS (SELECT doc, a, CASE b WHEN 'idiot' THEN 'clown' ELSE 'scum' END AS c FROM e WHERE b IN ('idiot', 'moron'))
SELECT DISTINCT m.doc, m.a || '->' || m.c || '$' AS term FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc = m.doc AND e.a = m.a AND e.b = m.c)""")
def extract_penalties(spark, sf_dir):
    coordinates = F.broadcast(spark.createDataFrame([("idiot", "clown"), ("moron", "scum")], "term string, partner string"))
    return ex.penalties(ix.dependency_occurrences(docs(spark, sf_dir)).select("doc", "term", "pos"), coordinates).select("doc", "term").distinct()


@register("information_rank", f"WITH {DEP}, s AS (SELECT ws[i + 1] AS verb, count(*) AS score FROM p WHERE ws[i] = 'the' GROUP BY 1) SELECT count_if(score > (SELECT score FROM s WHERE verb = 'of')) + 1 AS rank FROM s")
def information_rank(spark, sf_dir):
    part = lambda i: F.split_part("term", F.lit("->"), F.lit(i))
    pairs = ix.dependency_occurrences(docs(spark, sf_dir)).select(part(1).alias("noun"), part(2).alias("verb"), F.lit(1.0).alias("score"))
    return ex.information_rank(pairs, "the", "of")


@register("standoff_sentences", r"WITH a AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM a) SELECT doc, begin, begin + length(line) AS \"end\", 'sentence' AS tag FROM b WHERE line <> ''".replace('\\"', '"'))
def standoff_sentences(spark, sf_dir):
    return so.sentence_spans(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text"))


LINES = "la AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), lb AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p0 FROM la)"
SPAN = f"{LINES}, sp AS (SELECT doc, unnest([p0, p0 + length(line) // 4]) AS b, unnest([p0 + (length(line) + 1) // 2, p0 + length(line) // 2 + 1]) AS e FROM lb WHERE line <> '')"


def spans(spark, sf_dir):
    """Two spans in every line of every text, which meet but in the shortest lines; they come by their ends."""
    lines = so.sentence_spans(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")).withColumn("n", F.col("end") - F.col("begin"))
    two = F.array(
        F.struct(F.col("begin"), (F.col("begin") + F.floor((F.col("n") + 1) / 2)).alias("end")),
        F.struct((F.col("begin") + F.floor(F.col("n") / 4)).alias("begin"), (F.col("begin") + F.floor(F.col("n") / 2) + 1).alias("end")),
    )
    out = lines.select("doc", F.explode(two).alias("s")).select("doc", "s.begin", "s.end", F.lit("np").alias("tag"))
    return out.withColumn("seq", F.row_number().over(W.partitionBy("doc").orderBy("end", "begin")))


ISLE = f"""{SPAN}, fl AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY doc ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM fl), rg AS (SELECT doc, k, min(b) AS b, max(e) AS e FROM isl GROUP BY doc, k)"""


@register("standoff_clip", f"WITH {ISLE} SELECT doc, string_agg(substr(text, b + 1, e - b), chr(10) ORDER BY b) AS clipped FROM rg JOIN (SELECT doc_id AS doc, text FROM documents) USING (doc) GROUP BY doc")
def standoff_clip(spark, sf_dir):
    return so.clip(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text"), spans(spark, sf_dir), ["np"])


@register("standoff_sort", f"WITH {SPAN} SELECT doc, b AS begin, e AS \"end\", row_number() OVER (PARTITION BY doc ORDER BY b, e DESC) AS seq FROM sp")
def standoff_sort(spark, sf_dir):
    return so.ordered(spans(spark, sf_dir), ["np"]).select("doc", "begin", "end", "seq")


@register("standoff_verify", f"""WITH {SPAN}, sq AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY e, b) AS seq FROM sp), st AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY b, e DESC) AS seq FROM sp),
pr AS (SELECT 'by_end' AS spans, b, e, lag(b) OVER w AS pb, lag(e) OVER w AS pe FROM sq WINDOW w AS (PARTITION BY doc ORDER BY seq) UNION ALL SELECT 'sorted', b, e, lag(b) OVER w, lag(e) OVER w FROM st WINDOW w AS (PARTITION BY doc ORDER BY seq))
SELECT spans, count(*) FILTER (WHERE b < pb OR b = pb AND e > pe) AS broken FROM pr GROUP BY spans""")
def standoff_verify(spark, sf_dir):
    """Spans that stand wrong, as they come and after sorting."""
    s = spans(spark, sf_dir)
    count = lambda x, name: so.violations(x).agg(F.count("*").alias("broken")).select(F.lit(name).alias("spans"), "broken")
    return count(s, "by_end").union(count(so.ordered(s, ["np"]), "sorted"))


@register("standoff_embed", f"""WITH {ISLE}, mp AS (SELECT doc, b, e, coalesce(sum(e - b + 1) OVER (PARTITION BY doc ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ofs FROM rg),
inn AS (SELECT doc, ofs + (e - b) // 2 AS x, ofs + (e - b) // 2 + 5 AS y FROM mp)
SELECT doc, arg_max(x + b - ofs, ofs) FILTER (WHERE ofs <= x) AS begin, arg_min(y + b - ofs, ofs) FILTER (WHERE ofs + e - b >= y) AS "end" FROM inn JOIN mp USING (doc) GROUP BY doc, x, y""")
def standoff_embed(spark, sf_dir):
    """Spans of the clipped text from the middle of each region on, many of them into the next one."""
    mapped = so.clip_map(spans(spark, sf_dir))
    x = F.col("at") + F.floor((F.col("end") - F.col("begin")) / 2)
    inner = mapped.select("doc", x.alias("begin"), (x + 5).alias("end"), F.lit("x").alias("tag"), F.lit(None).cast("map<string,string>").alias("attrs"))
    return so.embed(inner, mapped).select("doc", "begin", "end")


@register("language_query", top_sql(f"SELECT a.doc, a.s + b.s AS score FROM {leaf_sql('worthless')} a JOIN {leaf_sql('trash')} b USING (doc)"))
def language_query(spark, sf_dir):
    o = ix.Corpus(docs(spark, sf_dir))
    tree, _ = pr.parse("worthless trash~AND", o=pr.Options(near=0, dependencies=False))
    return top(hits(o, tree))


@register("functions_readings", f"WITH {OCC} SELECT DISTINCT term AS plain, length(term) AS n FROM o")
def functions_readings(spark, sf_dir):
    o = ix.word_occurrences(docs(spark, sf_dir)).select("term").distinct()
    marked = F.concat("term", F.lit("/x"))
    return o.select(tx.strip_readings(marked).alias("plain"), F.length(tx.strip_all_readings(marked)).alias("n")).distinct()


@register("functions_escape", "SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x, length(url) AS n FROM pages")
def functions_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tx.escape_basic(F.col("url")).alias("x"), F.length("url").alias("n"))


@register("basic_phrase_count", f"WITH {SENT} SELECT doc, sum(kinds)::BIGINT AS kinds, sum(matches)::BIGINT AS matches FROM m GROUP BY doc")
def basic_phrase_count(spark, sf_dir):
    from .queries_ops import scored

    return scored(spark, sf_dir).groupBy("doc").agg(F.sum("kinds").alias("kinds"), F.sum("matches").alias("matches"))


@register("jst_time", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS jst FROM events")
def jst_time(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", tx.gmt_to_jst(F.to_utc_timestamp(F.col("ts").cast("string").cast("timestamp"), F.current_timezone())).alias("jst"))


