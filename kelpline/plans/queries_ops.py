"""Registered operator queries on documents, pages, events and keys, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index as ix
from ..operators import maintenance as mt
from ..operators import proximity as px
from ..operators import results as rs
from ..operators import snippets as sn
from ..sources import pages as pg
from .queries_search import OCC, W_, docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occ(spark, sf_dir: str, *terms: str) -> DataFrame:
    return ix.word_occurrences(docs(spark, sf_dir), list(terms) or None)


# positions


@register("prox_minimum_forward_distance", f"WITH {OCC} SELECT doc, min(d) AS distance FROM (SELECT a.doc, min(CASE WHEN b.pos >= a.pos THEN b.pos - a.pos END) AS d FROM o a JOIN o b USING (doc) WHERE a.term = 'for' AND b.term = 'with' GROUP BY a.doc) GROUP BY doc")
def prox_forward(spark, sf_dir):
    return px.minimum_forward_distance(occ(spark, sf_dir, "for", "with"), "for", "with")


@register("prox_adjacent_distance", f"WITH {OCC}, m AS (SELECT doc, pos, term, lag(pos) OVER w AS lp, lag(term) OVER w AS lt FROM o WHERE term IN ('for', 'with') WINDOW w AS (PARTITION BY doc ORDER BY pos)) SELECT doc, min(pos - lp) AS distance FROM m WHERE lt <> term GROUP BY doc")
def prox_adjacent(spark, sf_dir):
    return px.adjacent_distance(occ(spark, sf_dir, "for", "with"), "for", "with")


@register(
    "prox_tightest_region",
    f"""WITH {OCC}, s AS (SELECT doc, pos AS begin, greatest(
      min(CASE WHEN term = 'for' THEN pos END) OVER w, min(CASE WHEN term = 'with' THEN pos END) OVER w, min(CASE WHEN term = 'as' THEN pos END) OVER w) AS e,
      count_if(term = 'for') OVER w > 0 AND count_if(term = 'with') OVER w > 0 AND count_if(term = 'as') OVER w > 0 AS whole
      FROM o WHERE term IN ('for', 'with', 'as') WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    r AS (SELECT doc, begin, e, row_number() OVER (PARTITION BY doc ORDER BY e - begin, begin DESC) AS n FROM s WHERE whole AND e - begin < 30)
    SELECT doc, begin, e AS end_pos FROM r WHERE n = 1""",
)
def prox_region(spark, sf_dir):
    return px.tightest_region(occ(spark, sf_dir, "for", "with", "as"), ["for", "with", "as"], 30)


@register("prox_chained_near", f"WITH {OCC} SELECT DISTINCT a.doc FROM o a JOIN o b USING (doc) JOIN o c USING (doc) WHERE a.term = 'for' AND b.term = 'with' AND c.term = 'as' AND b.pos > a.pos AND c.pos > b.pos AND c.pos - a.pos <= 25")
def prox_chained(spark, sf_dir):
    return px.chained_near(occ(spark, sf_dir, "for", "with", "as"), ["for", "with", "as"], 25)


@register("phrase_positions", f"WITH {OCC} SELECT a.doc, a.pos AS begin FROM o a JOIN o b ON a.doc = b.doc AND b.pos = a.pos + 1 JOIN o c ON a.doc = c.doc AND c.pos = a.pos + 2 WHERE a.term = 'in' AND b.term = 'the' AND c.term = 'of'")
def phrase_positions(spark, sf_dir):
    return px.phrase_by_key(occ(spark, sf_dir, "in", "the", "of"), ["in", "the", "of"])


@register("coordinate_terms_near", f"WITH {OCC} SELECT a.doc, a.term AS term_a, a.pos AS pos_a, b.term AS term_b, b.pos AS pos_b FROM o a JOIN o b USING (doc) WHERE a.term = 'idiot' AND b.term IN ('moron', 'clown') AND abs(a.pos - b.pos) <= 100")
def coordinate_near(spark, sf_dir):
    partners = spark.createDataFrame([("idiot", "moron"), ("idiot", "clown")], "term string, partner string")
    return px.band_pairs(occ(spark, sf_dir, "idiot", "moron", "clown"), F.broadcast(partners), 100)


# sentences and snippets

SENT = r"""
sl AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS para FROM documents),
sp AS (SELECT doc, para, unnest(string_split(line, '. ')) AS sentence, unnest(range(len(string_split(line, '. ')))) AS k FROM sl),
s AS (SELECT doc, para, sentence, row_number() OVER (PARTITION BY doc ORDER BY para, k) - 1 AS sid FROM sp WHERE sentence <> ''),
h AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+') AS ws FROM s),
m AS (SELECT doc, para, sid, sentence, len(list_filter(ws, lambda w: w IN ('idiot', 'clown', 'scum'))) AS matches,
      len(list_distinct(list_filter(ws, lambda w: w IN ('idiot', 'clown', 'scum')))) AS kinds, greatest(len(ws), 1) AS n FROM h),
f AS (SELECT *, CASE WHEN matches > 0 THEN kinds * matches * (ln(n) + 1) ELSE 0 END AS score FROM m)
"""
TERMS = ["idiot", "clown", "scum"]


def scored(spark, sf_dir):
    return sn.matched(sn.sentences(docs(spark, sf_dir)), TERMS)


@register("snippet_sentence_scores", f"WITH {SENT} SELECT doc, sid, para, matches, kinds, kinds = 3 AS covered, round(score, 6) AS score FROM f WHERE matches > 0")
def snippet_scores(spark, sf_dir):
    return scored(spark, sf_dir).where("matches > 0").select("doc", "sid", "para", "matches", "kinds", "covered", F.round("score", 6).alias("score"))


SMOOTH = (
    "g AS (SELECT *, score + "
    + " + ".join(f"(coalesce(lag(score, {j}) OVER w, 0) + coalesce(lead(score, {j}) OVER w, 0)) / {2 ** j}" for j in range(1, 6))
    + " AS smooth FROM f WINDOW w AS (PARTITION BY doc, para ORDER BY sid))"
)


@register("snippet_smoothing", f"WITH {SENT}, {SMOOTH} SELECT doc, sid, round(smooth, 6) AS smooth FROM g WHERE smooth > 0")
def snippet_smoothing(spark, sf_dir):
    return sn.smoothed(scored(spark, sf_dir)).where("smooth > 0").select("doc", "sid", F.round("smooth", 6).alias("smooth"))


@register(
    "snippet_text",
    f"""WITH {SENT}, {SMOOTH},
    t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY smooth DESC, sid) AS r FROM g WHERE smooth > 0),
    b AS (SELECT *, coalesce(sum(len(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+'))) OVER (PARTITION BY doc ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM t WHERE r <= 3),
    c AS (SELECT doc, sid, sentence, lag(sid) OVER (PARTITION BY doc ORDER BY sid) AS l FROM b WHERE u < 80)
    SELECT doc, string_agg(CASE WHEN l IS NULL THEN '' WHEN sid - l > 1 THEN ' ... ' ELSE ' ' END || sentence, '' ORDER BY sid) AS snippet FROM c GROUP BY doc""",
)
def snippet_text(spark, sf_dir):
    return sn.snippets(sn.smoothed(scored(spark, sf_dir)))


@register("snippet_paragraph_starts", f"WITH {SENT} SELECT doc, count(*) AS starts FROM (SELECT doc, coalesce(lag(para) OVER (PARTITION BY doc ORDER BY sid) <> para, TRUE) AS first FROM s) WHERE first GROUP BY doc")
def snippet_starts(spark, sf_dir):
    return sn.paragraph_starts(sn.sentences(docs(spark, sf_dir))).where("first").groupBy("doc").agg(F.count("*").alias("starts"))


@register("snippet_early_stop", f"WITH {SENT}, z AS (SELECT doc, sid, min(CASE WHEN score > 0 THEN sid END) OVER (PARTITION BY doc) AS stop FROM f) SELECT doc, count(*) AS n FROM z WHERE stop IS NULL OR sid <= stop + 5 GROUP BY doc")
def snippet_stop(spark, sf_dir):
    return sn.until_first_hit(scored(spark, sf_dir), 5).groupBy("doc").agg(F.count("*").alias("n"))


@register("snippet_dedup", f"WITH {SENT} SELECT doc, sentence, min(sid) AS sid FROM m WHERE kinds > 0 OR length(regexp_replace(sentence, '[^\\s]', '', 'g')) / greatest(length(sentence), 1) <= 0.2 GROUP BY doc, sentence")
def snippet_dedup(spark, sf_dir):
    return sn.without_blank(scored(spark, sf_dir)).select("doc", "sentence", "sid")


KWIC = rf"""k AS (SELECT doc_id AS doc, {W_} AS ws FROM documents),
x AS (SELECT doc, ws, unnest(range(0, len(ws) - 2)) AS pos FROM k WHERE len(ws) >= 3)
SELECT doc, pos, array_to_string(ws[greatest(pos - 4, 1) : pos], ' ') AS "left", array_to_string(ws[pos + 1 : pos + 3], ' ') AS keyword, array_to_string(ws[pos + 4 : pos + 8], ' ') AS "right" FROM x WHERE ws[pos + 1] = 'of' AND ws[pos + 3] = 'the'"""


@register("kwic", f"WITH {KWIC}")
def kwic(spark, sf_dir):
    return sn.kwic(docs(spark, sf_dir), ["of", "*", "the"])


@register("kwic_by_left", f"WITH {KWIC} ORDER BY reverse(\"left\"), doc, pos")
def kwic_left(spark, sf_dir):
    return sn.sort_kwic(sn.kwic(docs(spark, sf_dir), ["of", "*", "the"]), by_left=True)


# pages and links

NORM = r"upper(array_to_string(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^www\d*\.', ''), '\d+', '0', 'g'), '/+', '/', 'g'), 'index\.html?$', ''), '/$', ''), '/')[1:3], '/'))"


@register("pages_fold_by_url", f"""WITH n AS (SELECT page_id AS doc, url, length(html) AS score, {NORM} AS key FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc DESC) AS n FROM n)
SELECT key, arg_min(doc, n) AS doc, arg_min(url, n) AS url, arg_min(score, n) AS score, coalesce(list(doc ORDER BY n) FILTER (WHERE n > 1), []) AS similar FROM r GROUP BY key""")
def pages_fold(spark, sf_dir):
    return rs.fold_by_url(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "url", F.length("html").alias("score")))


UNESC = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@register("pages_titles", f"SELECT page_id, coalesce(nullif(regexp_replace(trim({UNESC.format(chr(34) + 't' + chr(34))}), '\\s+', '_', 'g'), ''), 'none') AS title, length(html)::BIGINT AS size FROM (SELECT *, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)")
def pages_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pg.title(F.col("html")).alias("title"), F.length("html").cast("long").alias("size"))


@register("pages_text", f"""SELECT page_id, trim(regexp_replace({UNESC.format("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS body FROM pages""")
def pages_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pg.plain_text(F.col("html")).alias("body"))


LINK = r"""a AS (SELECT page_id AS src_sid, url AS src_url, regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 2) AS xs FROM pages),
l AS (SELECT src_sid, src_url, unnest(range(len(hs))) AS n, unnest(hs) AS href, regexp_replace(unnest(xs), '<[^>]+>', '', 'g') AS anchor FROM a)"""


@register("pages_links", f"WITH {LINK} SELECT * FROM l")
def pages_links(spark, sf_dir):
    return pg.links(table(spark, sf_dir, "pages"))


@register("pages_link_table", None)
def pages_link_table(spark, sf_dir):
    return pg.link_table(table(spark, sf_dir, "pages"))


@register("pages_highlight")
def pages_highlight(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", tx.highlight(F.col("text"), ["worthless", "trash"]).alias("x"))


SQL["pages_highlight"] = """SELECT doc_id, replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?i)(worthless)', chr(57344) || '\\1' || chr(57345), 'g'), '(?i)(trash)', chr(57346) || '\\1' || chr(57347), 'g'),
  chr(57344), '<span class="hit0">'), chr(57345), '</span>'), chr(57346), '<span class="hit1">'), chr(57347), '</span>') AS x FROM documents"""


# logs


@register("log_congestion", """SELECT event_id, recent, CASE WHEN recent <= 2 THEN 0 WHEN recent <= 5 THEN 1 WHEN recent <= 9 THEN 2 WHEN recent <= 19 THEN 3 ELSE 4 END AS band FROM (
  SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS recent FROM events)""")
def log_congestion(spark, sf_dir):
    return rs.congestion(table(spark, sf_dir, "events"), 600).select("event_id", "recent", "band")


@register("log_timings", "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def log_timings(spark, sf_dir):
    return rs.timings(table(spark, sf_dir, "events"), "event_type", "value")


@register("log_parameters", "SELECT event_type AS owner, regexp_extract(props, '\"k\": (\\d+)', 1) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def log_parameters(spark, sf_dir):
    line = F.concat_ws(" ", F.date_format("ts", "MMdd-HHmmss"), F.concat(F.lit("h"), F.col("user_id")), "event_type", F.concat(F.lit("k="), F.regexp_extract("props", r'"k": (\d+)', 1), F.lit(",a=1")))
    log = rs.parameters(table(spark, sf_dir, "events").select(line.alias("line")))
    return log.groupBy("owner", F.element_at("options", "k").alias("k")).agg(F.count("*").alias("n"))


@register("log_latest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


# ids and placement

SID = "lpad(doc_id::VARCHAR, 10, '0')"


def sids(spark, sf_dir):
    return docs(spark, sf_dir).select(tx.pad_sid(F.col("doc_id")).alias("sid"), "source", "doc_id")


@register("place_hash", f"SELECT sid, (list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 5), lambda i: substr(sid, 2 * i + 1, 2)::BIGINT)), lambda h, d: (h * 137 + d) % 120) + 11)::BIGINT AS host FROM (SELECT {SID} AS sid FROM documents)")
def place_hash(spark, sf_dir):
    return sids(spark, sf_dir).select("sid", tx.placement(F.col("sid")).alias("host"))


BOUNDS = [("0000000099", "h1"), ("0000000499", "h2"), ("0000000899", "h3")]


@register("place_by_range", f"SELECT sid, coalesce((SELECT arg_min(host, upper) FROM (VALUES {', '.join(map(str, BOUNDS))}) b(upper, host) WHERE upper >= sid), 'none') AS host FROM (SELECT {SID} AS sid FROM documents)")
def place_range(spark, sf_dir):
    return mt.host_of(sids(spark, sf_dir), spark.createDataFrame(BOUNDS, "upper string, host string"))


@register("place_rebalance", f"""WITH o AS (SELECT {SID} AS sid, 'h' || (doc_id % 3) AS source FROM documents WHERE lang <> 'fr'), n AS (SELECT {SID} AS sid, 'h' || (doc_id % 4) AS target FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT * FROM (SELECT sid, CASE WHEN source IS NULL THEN 'copy' WHEN target IS NULL THEN 'delete' WHEN source <> target THEN 'move' END AS action, source, target FROM o FULL JOIN n USING (sid)) WHERE action IS NOT NULL""")
def place_rebalance(spark, sf_dir):
    """A new language comes in, documents labelled toxic go, and there are four hosts in place of three."""
    d = docs(spark, sf_dir).select(tx.pad_sid(F.col("doc_id")).alias("sid"), "doc_id", "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    old = d.where("lang <> 'fr'").select("sid", F.concat(F.lit("h"), F.col("doc_id") % 3).alias("host"))
    new = d.join(toxic, "doc_id", "left_anti").select("sid", F.concat(F.lit("h"), F.col("doc_id") % 4).alias("host"))
    return mt.rebalance(old, new)


@register("versions_latest", f"SELECT lpad((doc_id // 3)::VARCHAR, 10, '0') || '-' || max(doc_id % 3) AS sid FROM documents GROUP BY doc_id // 3")
def versions_latest(spark, sf_dir):
    v = docs(spark, sf_dir).select(F.concat(tx.pad_sid(F.floor(F.col("doc_id") / 3)), F.lit("-"), F.col("doc_id") % 3).alias("sid"))
    return mt.latest_versions(v)


@register("ids_live", f"SELECT {SID} AS sid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def ids_live(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("sid", tx.pad_sid(F.col("doc_id")))
    return mt.live_ids(sids(spark, sf_dir).select("sid"), lab.where("toxic = 1"), lab.where("quality = 0"))


@register("ids_paths", f"SELECT sid, substr(sid, 1, 4) || '/' || substr(sid, 1, 6) AS path FROM (SELECT {SID} AS sid FROM documents)")
def ids_paths(spark, sf_dir):
    return sids(spark, sf_dir).select("sid", tx.sid_path(F.col("sid")).alias("path"))


@register("archive_offsets", "WITH c AS (SELECT source AS path, count(*) AS n FROM documents GROUP BY 1) SELECT path, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id, (coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100)::BIGINT AS target FROM c")
def archive_offsets(spark, sf_dir):
    return mt.running_offsets(docs(spark, sf_dir).groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n")), per_file=100)


@register("ids_remap", f"WITH t AS (SELECT {SID} AS sid, row_number() OVER (ORDER BY doc_id) - 1 AS tid FROM documents), l AS (SELECT {SID} AS sid, quality FROM labels) SELECT sid, quality, tid FROM l JOIN t USING (sid)")
def ids_remap(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(tx.pad_sid(F.col("doc_id")).alias("sid"), "quality")
    return mt.remap(lab, ix.dense_ids(sids(spark, sf_dir).select("sid")))


@register("tombstones_update", "SELECT DISTINCT page_id AS sid FROM pages WHERE url IN (SELECT url FROM pages WHERE length(html) < 3000) OR contains(html, 'lang=\"de\"')")
def tombstones_update(spark, sf_dir):
    """The urls of thin pages are removed, wherever they occur; pages in one language were before."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("sid"), "url", F.length("html").alias("n"), F.contains("html", F.lit('lang="de"')).alias("before"))
    return mt.update_tombstones(p.where("n < 3000").select("url"), p.select("url", "sid"), p.where("before").select("sid"))


@register("stream_islands", "SELECT conv_id, turn, sum(c) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT conv_id, turn, CASE WHEN lag(role) OVER (ORDER BY conv_id, turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS c FROM conversations)")
def stream_islands(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return mt.islands(c, "k", "role").select("conv_id", "turn", "run")


@register("sentence_guards", f"WITH {SENT} SELECT doc, count(*) AS n FROM h WHERE octet_length(encode(sentence)) <= 300 AND len(ws) <= 40 GROUP BY doc")
def sentence_guards(spark, sf_dir):
    return mt.guarded(sn.sentences(docs(spark, sf_dir)), 300, 40).groupBy("doc").agg(F.count("*").alias("n"))
