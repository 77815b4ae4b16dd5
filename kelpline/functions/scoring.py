"""Ranking formulas as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Constants of the ranking; all may be set per query."""

    k1: float = 1.0
    b: float = 0.6
    synonym: float = 0.90
    dependency: float = 1.00
    case_match: float = 1.00
    type_mismatch: float = 0.95
    case_damping: float = 0.18
    dependency_damping: float = 0.15
    strict_bonus: float = 0.0
    proximity_bonus: float = 0.0
    text_share: float = 1.0
    pagerank_scale: float = 5.0


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)); negative for terms of more than half of the documents."""
    return F.log((n_docs - df + 0.5) / (df + 0.5))


def bm25(freq: Column, length: Column, n_docs: Column, average: Column, df: Column, w: Weights = Weights()) -> Column:
    """Saturated frequency, normalised by length, times idf; 0 for a negative frequency."""
    tf = (w.k1 + 1) * freq / (w.k1 * ((1 - w.b) + w.b * length / average) + freq)
    return F.when(freq < 0, F.lit(0.0)).otherwise(tf * idf(n_docs, df))


def legacy_bm25(freq: Column, length: Column, n_docs: Column, average: Column, df: Column) -> Column:
    """The list engine's variant: 3f / ((0.5 + 1.5 len/avg) + f); -1 for non-positive input, 0 where df is -1."""
    value = 3 * freq / ((0.5 + 1.5 * length / average) + freq) * idf(n_docs, df)
    return F.when(df == -1, 0.0).when((freq <= 0) | (length <= 0) | (df <= 0), -1.0).otherwise(value)


def phrase_boost(score: Column, n_phrases: Column) -> Column:
    return F.when(n_phrases > 1, score * F.sqrt(n_phrases.cast("double"))).otherwise(score)


def occurrence_weight(basic: Column, dependency: Column, case_match: Column, type_match: Column, conditioned: Column, w: Weights = Weights()) -> Column:
    """Weight of one occurrence: synonym nodes count less, a case match and differing dependency types adjust it."""
    kind = F.when(~basic & ~dependency, w.synonym).when(dependency, w.dependency).otherwise(1.0)
    return kind * F.when(case_match, w.case_match).otherwise(1.0) * F.when(conditioned & ~type_match, w.type_mismatch).otherwise(1.0)


def damping(dependency: Column, case_match: Column, w: Weights = Weights()) -> Column:
    """Factor of a dependency's score in its parent."""
    return F.when(dependency & case_match, w.case_damping).when(dependency, w.dependency_damping).otherwise(1.0)


def final_score(score: Column, strict: Column, proximate: Column, pagerank: Column, w: Weights = Weights()) -> Column:
    text = score + w.strict_bonus * strict.cast("double") + w.proximity_bonus * proximate.cast("double")
    return w.text_share * text + (1 - w.text_share) * w.pagerank_scale * pagerank


def distance_bonus(distance: Column, limit: int = 30) -> Column:
    """(limit - d) / limit for 0 <= d < limit, else 0."""
    return F.when((distance >= 0) & (distance < limit), (limit - distance) / float(limit)).otherwise(0.0)


def legacy_final(word: Column, anchor: Column, dependency: Column, dependency_anchor: Column, distance: Column) -> Column:
    """Word and anchor scores, plus the dependency's, or the distance bonus where the dependency is absent."""
    zero = F.lit(0.0)
    tail = F.when(dependency.isNull(), F.coalesce(distance, zero)).otherwise(dependency)
    return F.coalesce(word, zero) + F.coalesce(anchor, zero) + tail + F.coalesce(dependency_anchor, zero)


def sentence_score(kinds: Column, matches: Column, length: Column) -> Column:
    """kinds * matches * (ln(length) + 1)."""
    return kinds * matches * (F.log(length.cast("double")) + 1)


def compound_strength(df_joined: Column, df_linked: Column) -> Column:
    return df_joined / (df_linked + 1)


def per_shard_results(wanted: int, shards: int) -> int:
    """Rows to ask of each of several shards so that the merged list is long enough."""
    if wanted <= 100:
        return wanted
    alpha = 1.5 if wanted > 5000 else 30 * wanted**-0.34
    return int(1 + wanted / shards * alpha)
