"""search(), hit_count(), kwic() and fetch() over an index and its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snippets as sn
from ..operators.results import fold_by_url
from .execute import hits, ranked
from .parse import Lexicon, Options, parse, words_of
from .tree import leaves


def search(query: str, occurrences: DataFrame, lexicon: Lexicon = Lexicon(), options: Options | None = None, tombstones: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """A page of ranked hits; tombstones: doc; pages: doc and url, to fold near-duplicate addresses."""
    tree, o = parse(query, lexicon, options)
    if tree is None:
        raise ValueError("the query has no word")
    found = hits(occurrences, tree)
    if tombstones is not None:
        found = found.join(tombstones.select("doc"), "doc", "left_anti")
    if o.sort_by == "random":
        return found.orderBy(F.rand(0)).limit(o.results)
    if pages is not None:
        found = fold_by_url(found.join(pages.select("doc", "url"), "doc"))
    return ranked(found, o.results, o.start - 1)


def hit_count(query: str, occurrences: DataFrame, lexicon: Lexicon = Lexicon(), options: Options | None = None) -> DataFrame:
    tree, _ = parse(query, lexicon, options)
    if tree is None:
        raise ValueError("the query has no word")
    return hits(occurrences, tree).agg(F.count("*").alias("hits"))


def with_snippets(page: DataFrame, docs: DataFrame, query: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """A page of hits with snippets; only its documents are cut into sentences. A page is small by its limit."""
    tree, _ = parse(query, lexicon)
    terms = sorted({x.term for x in leaves(tree) if not x.dependency})
    own = docs.join(F.broadcast(page.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi")
    found = sn.snippets(sn.smoothed(sn.matched(sn.sentences(own), terms)))
    return page.join(found, "doc", "left")


def kwic(query: str, docs: DataFrame, width: int = 20, by_left: bool = False) -> DataFrame:
    return sn.sort_kwic(sn.kwic(docs, words_of(query) or ["*"], width), by_left)


def fetch(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Documents by id: the filter reaches the scan."""
    return docs.where(F.col("doc_id").isin(ids))
