"""All registered queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexcorpus.plans import corpus_queries, index_queries, search_queries, stored_queries, whole_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**search_queries.QUERIES, **corpus_queries.QUERIES, **index_queries.QUERIES, **stored_queries.QUERIES, **whole_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**search_queries.SQL, **corpus_queries.SQL, **index_queries.SQL, **stored_queries.SQL, **whole_queries.SQL}
