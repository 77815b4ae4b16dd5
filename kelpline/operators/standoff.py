"""Stand-off annotation: spans (doc, begin, end, tag, attrs) over texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import escape_basic  # noqa: F401  (the export's companion for plain columns)


def parse_lines(lines: DataFrame) -> DataFrame:
    """doc, seq, begin, end, tag, attrs of tab-separated lines (doc, seq, line)."""
    part = F.split("line", "\t")
    pairs = F.regexp_extract_all(F.coalesce(F.get(part, F.lit(3)), F.lit("")), F.lit(r'(\w+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(F.coalesce(F.get(part, F.lit(3)), F.lit("")), F.lit(r'\w+="([^"]*)"'), F.lit(1))
    return lines.select("doc", "seq", part[0].cast("long").alias("begin"), part[1].cast("long").alias("end"), part[2].alias("tag"), F.map_from_arrays(pairs, values).alias("attrs"))


def sort_key(tags: list[str]):
    """Begin rising, end falling, then the order of tags; tags not listed come first."""
    place = F.lit(0)
    for i, t in enumerate(tags, 1):
        place = F.when(F.col("tag") == t, i).otherwise(place)
    return [F.col("begin"), F.desc("end"), place]


def ordered(spans: DataFrame, tags: list[str]) -> DataFrame:
    """seq renumbered by the sort order within each document; equal tags keep their order."""
    return spans.withColumn("seq", F.row_number().over(W.partitionBy("doc").orderBy(*sort_key(tags), "seq")))


def merge(tags: list[str], *parts: DataFrame) -> DataFrame:
    every = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_part", F.lit(i)))
    by = W.partitionBy("doc").orderBy(*sort_key(tags), "_part", "seq")
    return every.withColumn("seq", F.row_number().over(by)).drop("_part")


def violations(spans: DataFrame) -> DataFrame:
    """Spans that stand before their neighbour by begin, or by end where begins are equal; none means sorted."""
    by = W.partitionBy("doc").orderBy("seq")
    b, e = F.lag("begin").over(by), F.lag("end").over(by)
    return spans.withColumn("_b", b).withColumn("_e", e).where((F.col("begin") < F.col("_b")) | ((F.col("begin") == F.col("_b")) & (F.col("end") > F.col("_e"))) | (F.col("end") < F.col("begin"))).drop("_b", "_e")


def regions(spans: DataFrame) -> DataFrame:
    """Spans of each document united where they overlap or touch: doc, begin, end, n."""
    by = W.partitionBy("doc").orderBy("begin", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    isle = F.sum(F.when(reach >= F.col("begin"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    out = spans.withColumn("_r", reach).withColumn("_i", isle)
    out = out.groupBy("doc", "_i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return out.select("doc", "begin", "end", F.row_number().over(W.partitionBy("doc").orderBy("begin")).alias("n"))


def clip(texts: DataFrame, spans: DataFrame, tags: list[str]) -> DataFrame:
    """doc and clipped: the text of the tags' regions, a newline between regions that do not meet."""
    own = regions(spans.where(F.col("tag").isin(tags)))
    piece = texts.join(own, "doc").select("doc", "n", F.expr("substring(text, CAST(begin + 1 AS INT), CAST(end - begin AS INT))").alias("piece"))
    return piece.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "\n").alias("clipped"))


def clip_map(outer: DataFrame) -> DataFrame:
    """doc, begin, end, at: where each region's text begins in the clipped text."""
    own = regions(outer)
    before = F.sum(F.col("end") - F.col("begin") + 1).over(W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    return own.select("doc", "begin", "end", F.coalesce(before, F.lit(0)).alias("at"))


def embed(inner: DataFrame, mapped: DataFrame) -> DataFrame:
    """Spans over a clipped text as spans over its outer text.

    A start belongs to the last region that begins at or before it, an end to the first that ends at or after
    it; spans without such regions have a null begin or end.
    """
    regions_ = mapped.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "begin", "end"))).alias("rs"))
    both = inner.join(regions_, "doc", "left")
    first = F.try_element_at(F.filter("rs", lambda r: r["at"] <= F.col("begin")), F.lit(-1))
    last = F.get(F.filter("rs", lambda r: r["at"] + (r["end"] - r["begin"]) >= F.col("end")), F.lit(0))
    return both.withColumn("_f", first).withColumn("_l", last).select("doc", (F.col("_f.begin") + F.col("begin") - F.col("_f.at")).alias("begin"), (F.col("_l.begin") + F.col("end") - F.col("_l.at")).alias("end"), "tag", "attrs")


def sentence_spans(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """doc, begin, end, tag of each line of a text, by running lengths."""
    parts = docs.select("doc", F.posexplode(F.split("text", separator)).alias("n", "line"))
    before = F.sum(F.length("line") + len(separator)).over(W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    out = parts.withColumn("begin", F.coalesce(before, F.lit(0)))
    return out.where("line <> ''").select("doc", "begin", (F.col("begin") + F.length("line")).alias("end"), F.lit("sentence").alias("tag"))


_TAG = re.compile(r"<(/?)([\w:.-]+)((?:\s+[\w:.-]+=\"[^\"]*\")*)\s*(/?)>")
_REF = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _unescape(x: str) -> str:
    return re.sub(r"&(?:#(\d+)|#x([0-9a-fA-F]+)|(\w+));", lambda m: chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else _REF.get(m[3], m[0]), x)


def import_text(marked: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """Raw text and (begin, end, tag, attributes) of marked text; tags need only balance by name.

    Text behind the root's end is dropped; a tag that closes or opens alone raises ValueError.
    """
    out, spans, open_, n, at, depth, started = [], [], {}, 0, 0, 0, False
    for m in _TAG.finditer(marked):
        text = _unescape(marked[at : m.start()])
        if not (started and depth == 0):
            out.append(text)
            n += len(text)
        at = m.end()
        if started and depth == 0:
            continue
        close, name, attrs, empty = m.groups()
        if empty:
            spans.append((n, n, name, attrs.strip()))
        elif not close:
            open_.setdefault(name, []).append((len(spans), n))
            spans.append((n, -1, name, attrs.strip()))
            depth, started = depth + 1, True
        else:
            if not open_.get(name):
                raise ValueError(f"</{name}> closes nothing")
            i, begin = open_[name].pop()
            spans[i] = (begin, n, name, spans[i][3])
            depth -= 1
    if depth:
        raise ValueError("a tag is left open")
    if not started:
        out.append(_unescape(marked[at:]))
    return "".join(out), spans


def export_text(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """Marked text: at one place empty tags, end tags (last opened first), start tags, then the character."""
    begins: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for i, (b, e, _, _) in enumerate(spans):
        begins.setdefault(b, []).append(i)
        if e > b:
            ends.setdefault(e, []).append(i)
    out = []
    for p in range(len(text) + 1):
        mark = lambda i: f"<{spans[i][2]}{' ' if spans[i][3] else ''}{spans[i][3]}"
        out += [mark(i) + "/>" for i in begins.get(p, []) if spans[i][1] == p]
        out += [f"</{spans[i][2]}>" for i in sorted(ends.get(p, []), key=lambda i: (spans[i][0], -spans[i][1], i), reverse=True)]
        out += [mark(i) + ">" for i in begins.get(p, []) if spans[i][1] > p]
        if p < len(text):
            out.append({"&": "&amp;", "<": "&lt;", ">": "&gt;"}.get(text[p], text[p]))
    return "".join(out)


def import_documents(docs: DataFrame) -> DataFrame:
    """doc, text and spans of marked documents (doc, marked); broken ones have an error and nothing else."""

    def run(it):
        for pdf in it:
            rows = []
            for d, x in zip(pdf["doc"], pdf["marked"]):
                try:
                    text, spans = import_text(x or "")
                    rows.append((d, text, [{"begin": b, "end": e, "tag": t, "attrs": a} for b, e, t, a in spans], None))
                except ValueError as e:
                    rows.append((d, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc", "text", "spans", "error"])

    return docs.select(F.col("doc").cast("string").alias("doc"), "marked").mapInPandas(run, "doc string, text string, spans array<struct<begin:bigint,end:bigint,tag:string,attrs:string>>, error string")
