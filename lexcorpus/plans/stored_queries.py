"""Registered queries over tables that they write first: loading, keyed writes, status by batches (S1, S3, S4, I1), and the lookup of A11."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.operators import citations
from lexcorpus.plans.corpus_queries import _LABEL, _STATUS, _VALID
from lexcorpus.plans.fixtures import Fixtures, oracle
from lexcorpus.sources import tables
from lexcorpus.sources.keyed import KeyedTable
from lexcorpus.streaming.incremental import StatusStore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = lambda spark, folder: make(Fixtures(spark, folder))
        if sql is not None:
            SQL[name] = oracle(sql)
        return make

    return add


def scratch(f: Fixtures) -> str:
    """A new folder beside the session's tables, which all executors share."""
    return f"{f.spark.conf.get('spark.sql.warehouse.dir')}/stored-{uuid.uuid4().hex}"


@register("s1_load_tables", "SELECT case_id, act_name, section, round(confidence, 6) AS confidence, CAST(NULL AS VARCHAR) AS judgment FROM acts UNION ALL SELECT case_id, case_name, court, round(authority_score, 6), judgment FROM cases")
def loaded(f: Fixtures) -> DataFrame:
    """Tables written as Parquet are read with the library's schemas; columns that a file lacks are null."""
    folder = scratch(f)
    f.cases.drop("quality").write.parquet(f"{folder}/cases.parquet")
    f.acts.write.parquet(f"{folder}/acts.parquet")
    read = tables.load_tables(f.spark, folder, ("cases", "acts"))
    acts = read["acts"].select("case_id", "act_name", "section", F.round("confidence", 6).alias("confidence"), F.lit(None).cast("string").alias("judgment"))
    return acts.union(read["cases"].select("case_id", "case_name", "court", F.round("authority_score", 6), "judgment"))


_KEYS = "SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS v FROM lineitem"
_PART = "CAST('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 8) AS BIGINT) % 64"
_UPDATES = "v > 3 AND k % 1009 = 5"


@register(
    "s3_keyed_upsert",
    f"""r AS ({_KEYS}), u AS (SELECT * FROM r WHERE {_UPDATES}), b AS (SELECT * FROM r WHERE v <= 3 UNION ALL SELECT * FROM u)
SELECT k, max(v) AS v, (SELECT count(DISTINCT {_PART}) FROM u) AS rewritten FROM b GROUP BY k""",
)
def upserted(f: Fixtures) -> DataFrame:
    rows = f.raw("lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").alias("v"))
    table = KeyedTable(f.spark, scratch(f), ("k",))
    table.upsert(rows.where("v <= 3"), F.col("v"))
    n = table.upsert(rows.where(_UPDATES), F.col("v"))
    return table.read().withColumn("rewritten", F.lit(n).cast("long"))


@register("s4_keyed_insert", f"r AS ({_KEYS}) SELECT k, max(v) AS v FROM r WHERE v = 1 OR k % 1009 = 5 AND k NOT IN (SELECT k FROM r WHERE v = 1) GROUP BY k")
def inserted(f: Fixtures) -> DataFrame:
    """Of the new rows of a key that the table lacks, the greatest comes in."""
    rows = f.raw("lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").alias("v"))
    table = KeyedTable(f.spark, scratch(f), ("k",))
    table.upsert(rows.where("v = 1"))
    table.insert_new(rows.where("k % 1009 = 5"))
    return table.read()


@register("i1_status_by_batches", _STATUS + f"SELECT case_id, status, strength, {_LABEL} AS label, citing_count FROM v")
def batches(f: Fixtures) -> DataFrame:
    """Three batches of edges, each added to the stored counts, leave the status of all edges."""
    store, edges = StatusStore(f.spark, scratch(f), parts=8), f.cites
    times = ["1900-01-01", "1996-01-01", "1998-01-01", "2100-01-01"]
    for number, (a, b) in enumerate(zip(times, times[1:], strict=False)):
        within = (F.col("created_at") >= F.lit(a).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(b).cast("timestamp_ntz"))
        store.add(edges.where(within).drop("created_at", "cited_case_id"), number)
    return store.current(f.cases).drop("treatment_counts")


register(
    "a11_validity_lookup",
    "p AS (SELECT CAST(p_partkey AS VARCHAR) AS case_id FROM part), v AS (WITH " + _VALID + ") SELECT case_id, coalesce(validity, 'unknown') AS validity, overruled_by, coalesce(cited_by, 0) AS cited_by FROM p LEFT JOIN v USING (case_id)",
)(lambda f: citations.validity_of(f.raw("part").select(F.col("p_partkey").cast("string").alias("case_id")), f.cases, f.cites))


# J4 to depth 4 along the edges of one kind; the unrolled joins stop at 3.
register(
    "j4_deep_tree",
    """e AS (SELECT source_case_id AS src, cited_case_id AS case_id, max(confidence) AS confidence, min(relationship) AS relationship FROM cites WHERE cited_case_id IS NOT NULL AND relationship = 'followed' GROUP BY ALL),
t AS (SELECT root, case_id, depth, relationship, round(confidence, 6) AS confidence, array_to_string(path, '/') AS path FROM (
 WITH RECURSIVE x AS (SELECT src AS root, case_id, 1 AS depth, relationship, confidence, [src, case_id] AS path FROM e WHERE CAST(src AS BIGINT) % 20 = 0 AND src <> case_id
 UNION ALL SELECT root, e.case_id, depth + 1, e.relationship, e.confidence, list_append(path, e.case_id) FROM x JOIN e ON e.src = x.case_id WHERE depth < 4 AND NOT list_contains(path, e.case_id)) SELECT * FROM x))
SELECT * FROM t""",
)(
    lambda f: citations.deep_citation_tree(f.cites.where("relationship = 'followed'"), f.cases.where(F.col("case_id").cast("bigint") % 20 == 0), 4).withColumns(
        {"path": F.array_join("path", "/"), "confidence": F.round("confidence", 6)}
    )
)
