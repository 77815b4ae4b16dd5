"""Annotated XML documents: reading into nested rows, and writing back; CoNLL-like and key-value text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import CASES, CHUNK, SENTENCE

_ARGUMENTS = "struct<" + ",".join(f"_{c}:string" for c in CASES) + ">"
_TOKEN = f"struct<_id:string,_surf:string,_orig:string,_repname:string,_content_p:string,synnode:array<struct<_synid:string,_score:double,_wordid:string>>,Predicate:array<{_ARGUMENTS}>>"
_CHUNK = f"struct<_id:string,_head:string,_type:string,Token:array<{_TOKEN}>>"
_ANNOTATION = f"struct<Chunk:array<{_CHUNK}>>"
_S = f"struct<_Id:int,_Paragraph:int,_BlockType:string,RawString:string,Annotation:{_ANNOTATION}>"
XML = f"struct<_Url:string,_OriginalEncoding:string,_Time:string,Header:struct<Title:struct<RawString:string,Annotation:{_ANNOTATION}>>,Text:struct<S:array<{_S}>>>"


def parse(xml: DataFrame, column: str = "xml") -> DataFrame:
    """doc, url, encoding, time, title and sentences of documents (doc, xml)."""
    x = F.from_xml(F.col(column), XML)
    out = xml.withColumn("_x", x)

    # predicate arguments per sentence and token, by attribute
    def token(t: Column) -> Column:
        syn = F.transform(F.coalesce(t["synnode"], F.array().cast("array<struct<_synid:string,_score:double,_wordid:string>>")), lambda n: F.struct(n["_synid"].alias("synid"), n["_score"].alias("score"), n["_wordid"].alias("wordid")))
        args = F.try_element_at(t["Predicate"], F.lit(1))
        named = F.filter(F.array(*(F.struct(args[f"_{c}"].alias("k"), F.lit(c).alias("v")) for c in CASES)), lambda e: e["k"].isNotNull())
        # a token in two cases counts in the first one
        pairs = F.map_from_entries(F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda x: x["k"] == e["k"])))
        return F.struct(t["_id"].alias("id"), t["_surf"].alias("surf"), t["_orig"].alias("orig"), t["_repname"].alias("repname"), (F.coalesce(t["_content_p"], F.lit("0")) == "1").alias("content"), F.coalesce(pairs, F.create_map().cast("map<string,string>")).alias("args"), syn.alias("synnodes"))

    def chunk(c: Column) -> Column:
        return F.struct(c["_id"].alias("id"), F.split(F.coalesce(c["_head"], F.lit("")), "/").alias("heads"), c["_type"].alias("dpnd_type"), F.transform(c["Token"], token).alias("tokens")).cast(CHUNK)

    def sentence(s: Column) -> Column:
        return F.struct(s["_Id"].alias("id"), s["_Paragraph"].alias("para"), s["_BlockType"].alias("block"), s["RawString"].alias("rawstring"), F.transform(F.coalesce(s["Annotation"]["Chunk"], F.array().cast(f"array<{_CHUNK}>")), chunk).alias("chunks")).cast(SENTENCE)

    return out.select(
        "doc",
        F.col("_x._Url").alias("url"),
        F.col("_x._OriginalEncoding").alias("encoding"),
        F.col("_x._Time").alias("time"),
        F.col("_x.Header.Title.RawString").alias("title"),
        F.transform("_x.Text.S", sentence).alias("sentences"),
    )


def read(spark, path: str) -> DataFrame:
    """A folder of such files; doc is the file's name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse(raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.xml)?$", 1).alias("doc"), F.decode("content", "UTF-8").alias("xml")))


def raw_strings(xml: DataFrame, column: str = "xml") -> DataFrame:
    """doc, n, rawstring by pattern alone, for documents that are not well formed."""
    found = F.regexp_extract_all(column, F.lit(r"(?s)<RawString>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</RawString>"), F.lit(1))
    return xml.select("doc", F.posexplode(found).alias("n", "rawstring"))


def url_and_title(xml: DataFrame, column: str = "xml") -> DataFrame:
    """doc, url, title (first raw string, blanks as '_'), size; 'none' where there is none."""
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))
    first = F.regexp_extract(column, r"(?s)<RawString>(.*?)</RawString>", 1)
    return xml.select("doc", none(F.regexp_extract(column, r'Url="([^"]*)"', 1)).alias("url"), none(F.replace(F.trim(first), F.lit(" "), F.lit("_"))).alias("title"), F.octet_length(column).alias("size"))


def to_xml(annotated: DataFrame) -> DataFrame:
    """doc and xml of annotated documents, raw strings and tokens."""
    def token(t: Column) -> Column:
        return F.struct(t["id"].alias("_id"), t["surf"].alias("_surf"), t["orig"].alias("_orig"))

    def sentence(s: Column) -> Column:
        chunks = F.transform(s["chunks"], lambda c: F.struct(c["id"].alias("_id"), F.array_join(c["heads"], "/").alias("_head"), F.transform(c["tokens"], token).alias("Token")))
        return F.struct(s["id"].alias("_Id"), s["para"].alias("_Paragraph"), s["block"].alias("_BlockType"), s["rawstring"].alias("RawString"), F.struct(chunks.alias("Chunk")).alias("Annotation"))

    body = F.struct(F.struct(F.transform("sentences", sentence).alias("S")).alias("Text"))
    return annotated.select("doc", F.to_xml(body, {"rowTag": "StandardFormat"}).alias("xml"))


def to_lines(annotated: DataFrame) -> DataFrame:
    """doc and text: one line a chunk '* id head' and one a token, 'EOS' after each sentence."""
    def chunk(c: Column) -> Column:
        lines = F.transform(c["tokens"], lambda t: F.concat_ws(" ", t["surf"], t["orig"]))
        return F.concat(F.lit("* "), c["id"], F.lit(" "), F.array_join(c["heads"], "/"), F.lit("\n"), F.array_join(lines, "\n"))

    text = F.transform("sentences", lambda s: F.concat(F.array_join(F.transform(s["chunks"], chunk), "\n"), F.lit("\nEOS")))
    return annotated.select("doc", F.array_join(text, "\n").alias("text"))


def read_key_values(spark, path: str) -> DataFrame:
    """Lines 'key value': the value is all behind the first blank."""
    return spark.read.text(path).select(F.split_part("value", F.lit(" "), F.lit(1)).alias("key"), F.expr("substring(value, instr(value, ' ') + 1)").alias("value"))


def write_key_values(table: DataFrame, path: str) -> None:
    """Ranges of keys in order, so that a point lookup reads one row group."""
    table.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def sum_key_values(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.sum(F.col("value").cast("double")).alias("value")).orderBy("key")


def nth_value(table: DataFrame, key: str, n: int) -> DataFrame:
    """The n-th value (from 1) of a key with several, in the order of `seq`."""
    from pyspark.sql import Window as W

    own = table.where(F.col("key") == key).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("seq")))
    return own.where(F.col("n") == n).select("key", "value")


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as XML files."""
    rows.write.format("xml").option("rowTag", "Result").option("rootTag", "ResultSet").mode("overwrite").save(path)
