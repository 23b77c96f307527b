"""Deep trees and deep pages equal the plain ways."""

import pytest
from pyspark.sql import functions as F

from lexcorpus.operators import citations, paging
from lexcorpus.plans.fixtures import Fixtures


def test_recursive_tree_equals_the_joins(spark, folder):
    f = Fixtures(spark, folder)
    cites = f.cites.where("relationship = 'followed'")
    roots = spark.createDataFrame([("1",), ("7",), ("none",)], "case_id string")
    for depth in (1, 2, 3):
        a, b = citations.deep_citation_tree(cites, roots, depth), citations.citation_tree(cites, roots, depth)
        rows = lambda df: sorted((r.root, r.depth, tuple(r.path), r.relationship, r.confidence) for r in df.collect())
        assert rows(a) == rows(b)
    assert citations.deep_citation_tree(cites, roots.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        citations.deep_citation_tree(cites, roots, 0)


def test_recursive_tree_ends_on_cycles(spark):
    cites = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("b", "c"), ("c", "a"), ("c", "d")], "source_case_id string, cited_case_id string").withColumns({"relationship": F.lit(None).cast("string"), "confidence": F.lit(0.5)})
    got = {"/".join(r.path) for r in citations.deep_citation_tree(cites, spark.createDataFrame([("a",)], "case_id string"), 9).collect()}
    assert got == {"a/b", "a/b/c", "a/b/c/d"}


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_pages_by_key_equal_offsets(spark, monkeypatch, few):
    monkeypatch.setattr(paging, "FEW", few)
    monkeypatch.setattr(paging, "RANGES", 8)
    n = 500
    df = spark.range(n).select(
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 13) / 4.0).alias("score"), (F.col("id") % 3).cast("int").alias("year"), F.concat(F.lit("case"), (F.col("id") * 31 % n).cast("string")).alias("case_id")
    )
    order = [("score", True), ("year", False), ("case_id", False)]
    whole = [tuple(r) for r in df.orderBy(F.col("score").desc_nulls_last(), F.col("year").asc_nulls_last(), "case_id").collect()]
    for number, size in ((1, 10), (3, 7), (18, 25), (20, 25), (21, 25), (1, 1000)) if few > 1 else ((4, 40), (13, 40)):
        assert [tuple(r) for r in paging.page_by_key(df, order, number, size).collect()] == whole[(number - 1) * size : number * size], (number, size)
    assert paging.page_by_key(df.limit(0), order, 1, 5).count() == 0
    with pytest.raises(ValueError):
        paging.page_by_key(df, order, 0, 5)


def test_a_deep_page_sorts_one_range(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("score"), F.col("id").cast("string").alias("case_id"))
    page = paging.page_by_key(df, [("score", True), ("case_id", False)], 1000, 100)
    assert [r.score for r in page.collect()] == [r.score for r in df.orderBy(F.desc("score"), "case_id").offset(99_900).limit(100).collect()]
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" in plan and "Filter" in plan.split("Sort")[1]
    skipped = int(plan.split("Offset ")[1].split()[0]) if "Offset " in plan else 0
    assert skipped < paging.FEW


def test_a_deep_tree_has_no_limit_of_rows(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    edges = [(f"{a}.{i}", f"{a + 1}.{j}") for a in range(4) for i in range(3) for j in range(3)]
    cites = spark.createDataFrame(edges, "source_case_id string, cited_case_id string").withColumns({"relationship": F.lit("followed"), "confidence": F.lit(0.5)})
    try:
        spark.conf.set(limit, "5")
        made = citations.deep_citation_tree(cites, spark.createDataFrame([("0.0",)], "case_id string"), 4)
        assert made.count() == 3 + 9 + 27 + 81 and spark.conf.get(limit) == "5"
        assert "UnionLoop" not in made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(limit, before)
