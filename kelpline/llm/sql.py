"""DuckDB SQL for the results that SQL can express."""

#: Words of the documents, numbered within each.
WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS gs
  FROM w WHERE len(ws) > 0
),
heads AS (SELECT gs, min(doc_id) AS head, list(doc_id) AS members FROM g GROUP BY gs),
grams AS (SELECT head, len(gs) AS size, unnest(gs) AS gram FROM heads),
rare AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
shared AS (SELECT * FROM grams SEMI JOIN rare USING (gram)),
pairs AS (
  SELECT x.head AS a, y.head AS b, any_value(x.size) AS sa, any_value(y.size) AS sb, count(*) AS overlap
  FROM shared x JOIN shared y ON x.gram = y.gram AND x.head < y.head GROUP BY ALL
),
links AS (
  SELECT unnest([a, b]) AS head, unnest([b, a]) AS other FROM pairs WHERE overlap / (sa + sb - overlap)::DOUBLE >= 0.5
),
degree AS (SELECT head, count(*) AS n_links FROM links GROUP BY head),
reach AS (SELECT head, head AS root FROM heads UNION SELECT other, root FROM reach JOIN links USING (head) WHERE root < other),
class AS (SELECT head, min(root) AS class_id FROM reach GROUP BY head)
SELECT m AS doc_id, class_id, head AS set_id, coalesce(n_links, 0) AS n_links, n_docs - 1 AS n_copies
FROM (SELECT head, len(members) AS n_docs, unnest(members) AS m FROM heads) JOIN class USING (head) LEFT JOIN degree USING (head)
WHERE n_docs > 1 OR n_links > 0
"""

DECONTAMINATE_SQL = rf"""
WITH item AS (SELECT row_number() OVER () AS item, {WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
phrase AS (
  SELECT DISTINCT item, least(8, len(ws)) AS n, array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ') AS p
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS i FROM item WHERE len(ws) > 0)
),
doc AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
spot AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(ws) >= n),
hit AS (
  SELECT doc_id, i - 1 AS a, i - 1 + s.n AS b, item
  FROM (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS p FROM spot) s JOIN phrase USING (n, p)
),
flag AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b, item ROWS UNBOUNDED PRECEDING) AS k FROM flag)
SELECT doc_id, min(a) AS word_start, max(b) AS word_end, count(DISTINCT item) AS n_items FROM isle GROUP BY doc_id, k
"""


def secrets_sql() -> str:
    from .op3_secret_scan import RULES

    quoted = [(r.name, r.pattern.replace("'", "''")) for r in RULES]
    each = " UNION ALL ".join(f"SELECT blob, '{name}' AS rule, unnest(regexp_extract_all(text, '{pattern}', 1)) AS secret FROM blobs" for name, pattern in quoted)
    return f"""
WITH versions AS (SELECT DISTINCT doc_id, source, sha256(text) AS blob FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
blobs AS (SELECT DISTINCT sha256(text) AS blob, text FROM documents WHERE text IS NOT NULL),
hits AS (SELECT blob, rule, secret, count(*) AS occurrences FROM ({each}) GROUP BY ALL)
SELECT doc_id, source, blob, rule, secret, occurrences FROM versions JOIN hits USING (blob)
"""


SECRETS_SQL = secrets_sql()

SUFFIX_SQL = rf"""
WITH doc AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
run AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM doc WHERE len(ws) >= 50)),
shared AS (SELECT p FROM run GROUP BY p HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM run SEMI JOIN shared USING (p)),
flag AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM flag)
SELECT doc_id, min(i) AS word_start, max(i) + 50 AS word_end FROM isle GROUP BY doc_id, k
"""
