"""Counts and lists over the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def act_lists(acts: DataFrame) -> DataFrame:
    return acts.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("act_name")), " | ").alias("act_names"), F.array_join(F.array_sort(F.collect_set("section")), ", ").alias("sections"))


def cited_by_counts(cites: DataFrame) -> DataFrame:
    return cites.where(F.col("cited_case_id").isNotNull()).groupBy("cited_case_id").agg(F.count("*").alias("cited_by_count"))


#: Facets and how many of their values are kept; null keeps all.
FACETS = {"court": 15, "year": None, "outcome": 10, "court_type": 10}


def facets(hits: DataFrame) -> DataFrame:
    """facet, value, n: all facets from one pass; ties go by value, null values are left out."""
    rows = hits.select(*[F.col(c).cast("string").alias(c) for c in FACETS])
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in FACETS]))
    counts = rows.select(kinds.alias("f")).select("f.*").where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, n in FACETS.items() if n for x in (c, n)]), F.col("facet")), F.lit(2**31 - 1))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("facet", "value", "n")


def top_values(rows: DataFrame, column: str, n: int = 50) -> DataFrame:
    """The commonest values of a column or of the elements of an array column; null and '' are left out."""
    value = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    some = rows.select(value.alias("value")).where("value <> ''")
    return some.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def filter_options(cases: DataFrame) -> DataFrame:
    """One row: sorted distinct courts, court types and outcomes, least and greatest year, number of cases."""
    lists = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s") for c in ("court", "court_type", "outcome")]
    return cases.agg(*lists, F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("n_cases"))


def corpus_counts(cases: DataFrame, paras: DataFrame, acts: DataFrame) -> DataFrame:
    """One row: how many cases, paragraphs and act rows there are."""
    tables = {"n_cases": cases, "n_paragraphs": paras, "n_acts": acts}
    ones = [t.select(*[F.lit(int(own == name)).alias(name) for name in tables]) for own, t in tables.items()]
    return reduce(DataFrame.union, ones).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in tables])


KINDS = ("arguments", "brief", "reasoning", "strategy", "timeline", "issues")


def analysis_coverage(cases: DataFrame, cache: DataFrame) -> DataFrame:
    """cache (cache_key 'case:kind'): which analyses of each case exist, which are pending, and whether all do."""
    keys = F.split("cache_key", ":", 2)
    done = cache.select(keys[0].alias("case_id"), keys[1].alias("kind")).groupBy("case_id").pivot("kind", list(KINDS)).agg(F.count(F.lit(1)))
    joined = cases.select("case_id").join(done, "case_id", "left")
    have = {k: F.coalesce(F.col(k), F.lit(0)) > 0 for k in KINDS}
    pending = F.array_join(F.array_compact(F.array(*[F.when(~h, k) for k, h in have.items()])), ",")
    return joined.select("case_id", *[h.alias(f"has_{k}") for k, h in have.items()], pending.alias("pending"), (pending == "").alias("all_cached"))
