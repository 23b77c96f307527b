"""The edges are read once for each thing that the status asks of them."""

import re

from pyspark.sql import functions as F

from lexcorpus.operators import citations
from lexcorpus.streaming import incremental

EDGES = "source_case_id string, target_citation string, relationship string, confidence double, created_at int"


def _scans(df, path):
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall("Relation .*created_at|Relation .*source_case_id|Relation .*target_citation", plan))


def test_edges_are_read_once_for_scores_and_once_for_groups(spark, tmp_path):
    rows = [(str(k % 7), f"1 SCC {k % 5}" if k % 3 else None, ("followed", "overruled", None)[k % 3], (0.9, None)[k % 2], k) for k in range(60)]
    spark.createDataFrame(rows, EDGES).write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    cases = spark.createDataFrame([(str(k),) for k in range(8)], "case_id string")
    made = citations.precedent_status(cases, edges)
    assert _scans(made, tmp_path) == 2  # before: 4
    rated = {r.target_citation: (r.total, round(r.avg_confidence, 9), r.most_common) for r in citations._rated(edges).collect()}
    plain = {r.target_citation: (r.total, round(r.avg_confidence, 9), r.most_common) for r in citations.statistics(edges).where("target_citation is not null").collect()}
    assert rated == plain


def test_touched_cases_are_found_once(spark, tmp_path):
    rows = [(str(k % 7), f"1 SCC {k % 5}", "followed", 0.9, k) for k in range(60)]
    spark.createDataFrame(rows, EDGES).write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    cases = spark.createDataFrame([(str(k),) for k in range(8)], "case_id string")
    none = citations.precedent_status(cases, edges.limit(0)).withColumn("updated_at", F.lit(0)).localCheckpoint()
    made = incremental.refresh_since(none, cases, edges, F.lit(30), F.lit(99))
    assert _scans(made, tmp_path) <= 3  # before: three more for each time that the touched cases were asked for
