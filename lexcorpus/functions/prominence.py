"""Weights and scores of citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexcorpus.functions.dictionaries import COURT_PATTERNS, MODIFIERS


def _court(citation: Column, found: int, other: object, unknown: object) -> Column:
    chain = F.when(F.coalesce(citation, F.lit("")) == "", F.lit(unknown))
    for pattern, *values in COURT_PATTERNS:
        chain = chain.when(citation.rlike(f"(?i){pattern}"), F.lit(values[found]))
    return chain.otherwise(F.lit(other))


def court(citation: Column) -> Column:
    return _court(citation, 0, "Other", "Unknown")


def court_weight(citation: Column) -> Column:
    return _court(citation, 1, 2, 2)


def modifier(relationship: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MODIFIERS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(relationship))), F.lit(1.0))


def prominence(count: Column, weight: Column, relationship: Column, confidence: Column) -> Column:
    """0 to 100, cut to a whole number; a confidence of 0 or null adds what 0.5 would."""
    counted = F.least(F.greatest(count, F.lit(0)) / F.lit(500.0) * 100, F.lit(100.0))
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.25).otherwise(confidence * 0.5)
    score = (counted + weight * 2.0 + modifier(relationship) * 1.5 + sure) / 122.45 * 100
    return F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))


def score_status(score: Column, relationship: Column) -> Column:
    return F.when(F.lower(relationship) == "overruled", "overruled").when(score >= 80, "good_law").when(score >= 60, "active_authority").when(score >= 40, "limited_precedent").when(score >= 20, "background").otherwise("minimal_precedent")


def simple_status(relationship: Column) -> Column:
    return F.when(relationship.isin(list(MODIFIERS)), relationship).otherwise("unknown")


def simple_strength(confidence: Column) -> Column:
    return F.when(confidence.isNull(), 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), (confidence * 100).cast("int"))))
