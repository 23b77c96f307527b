"""Scores and orders of hits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions.dictionaries import COURT_SCORES, MATCH_SCORES
from lexcorpus.functions.text import GAP


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def factors() -> dict[str, Column]:
    """The six parts of relevance, each from 0 to 1, over the columns of an assembled case."""
    log = lambda n: F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(_clamped(F.log1p(n) / math.log1p(10_000)))
    total = F.col("total_paragraphs")
    courts = F.create_map(*[F.lit(x) for pair in COURT_SCORES.items() for x in pair])
    return {
        "authority": F.when(F.col("authority_score").isNull(), 0.3).otherwise(_clamped(F.col("authority_score"))),
        "citation_count": log(F.col("citation_count")),
        "cited_by": log(F.col("cited_by_count")),
        "term_density": F.when(F.coalesce(total, F.lit(0)) <= 0, 0.3).otherwise(_clamped(F.col("matched") / total * 5.0)),
        "recency": F.when(F.col("year").isNull(), 0.5).otherwise((F.greatest(F.lit(1950), F.least(F.lit(2025), F.col("year"))) - 1950) / 75.0),
        "court": F.coalesce(F.element_at(courts, F.col("court_type")), F.lit(0.3)),
    }


def relevance(hits: DataFrame) -> DataFrame:
    """Adds relevance_score (0 to 100, one decimal) and score_breakdown."""
    parts = factors()
    final = parts["authority"] * 0.30 + parts["citation_count"] * 0.20 + parts["cited_by"] * 0.15 + parts["term_density"] * 0.15 + parts["recency"] * 0.10 + parts["court"] * 0.10
    return hits.withColumns({"relevance_score": F.round(_clamped(final) * 100, 1), "score_breakdown": F.struct(*[F.round(v, 4).alias(k) for k, v in parts.items()])})


def order(mode: str) -> list[Column]:
    """Sort keys of relevance, date_desc, date_asc or citations; ties by case."""
    keys = {"relevance": F.desc_nulls_last("relevance_score"), "date_desc": F.desc_nulls_last("year"), "date_asc": F.asc_nulls_last("year"), "citations": F.desc_nulls_last("cited_by_count")}
    return [keys[mode], F.col("case_id")]


def rerank(hits: DataFrame, cites: DataFrame) -> DataFrame:
    """Adds rerank_score: relevance, out-citations of case hits (at most 10 count) and recency."""
    degree = cites.groupBy(F.col("source_case_id").alias("case_id")).agg(F.least(F.count("*"), F.lit(10)).alias("degree"))
    joined = hits.join(degree, "case_id", "left")
    cited = F.when(F.col("result_type") == "case", F.coalesce("degree", F.lit(0)) / 10.0).otherwise(0.0)
    return joined.withColumn("rerank_score", rerank_score(cited)).drop("degree")


def rerank_score(cited: Column) -> Column:
    """From relevance_score and year, and how much the case cites (0 for a paragraph)."""
    recent = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("year") - 2010) / 20.0)), F.lit(0.0))
    return F.coalesce("relevance_score", F.lit(0.5)) * 0.6 + cited * 0.2 + recent * 0.2


def name_hits(name: Column, query: Column) -> Column:
    """How many words of over two letters of the query stand in the name; 0 below two."""
    n = F.size(F.filter(name_words(query), lambda w: F.contains(F.lower(name), w)))
    return F.when(n >= 2, n).otherwise(0)


def name_words(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(query), GAP), lambda w: F.length(w) > 2))


def match_score(match_type: Column, confidence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MATCH_SCORES.items() for x in pair])
    return F.coalesce(F.element_at(known, match_type), F.lit(50)) * F.coalesce(confidence, F.lit(0.5))


def type_first(para_type: Column, targets: Sequence[str]) -> Column:
    """Sort key: 0 for paragraphs whose type holds a target type, else 1."""
    some = F.lit(False)
    for t in targets:
        some = some | F.coalesce(F.contains(F.lower(para_type), F.lit(t)), F.lit(False))
    return F.when(some, 0).otherwise(1)
