"""The library's tables as views over the test tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.functions.text import word_count

CASES = """
SELECT CAST(d.doc_id AS STRING) AS case_id, substring(d.text, 1, 40) AS case_name,
       concat('App-', CAST(d.doc_id % 97 AS STRING)) AS appeal_no, d.source AS court,
       CASE d.doc_id % 5 WHEN 0 THEN 'SC' WHEN 1 THEN 'HC' WHEN 2 THEN 'Tribunal' WHEN 3 THEN 'District' ELSE NULL END AS court_type,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(1945 + d.doc_id % 82 AS INT) END AS year,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(d.n_chars % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS authority_score,
       CAST(d.n_chars % 700 AS BIGINT) AS citation_count, d.lang AS outcome, d.text AS judgment, l.quality AS quality,
       concat('party', CAST(d.doc_id % 31 AS STRING)) AS petitioner, concat('party', CAST(d.doc_id % 29 AS STRING)) AS respondent
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
CITES = """
SELECT CAST(l_orderkey % n AS STRING) AS source_case_id,
       CASE WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % n AS STRING) END AS cited_case_id,
       concat('(', CAST(1950 + l_partkey % 70 AS STRING), ') ', CAST(l_suppkey % 13 AS STRING), ' ',
              CASE l_partkey % 6 WHEN 0 THEN 'SCC' WHEN 1 THEN 'SCR' WHEN 2 THEN 'AIR' WHEN 3 THEN 'Cal' WHEN 4 THEN 'Delhi' ELSE 'XYZ' END,
              ' ', CAST(l_partkey AS STRING)) AS target_citation,
       CASE CAST(l_quantity AS INT) % 8 WHEN 0 THEN 'cited' WHEN 1 THEN 'approved' WHEN 2 THEN 'followed' WHEN 3 THEN 'affirmed'
            WHEN 4 THEN 'distinguished' WHEN 5 THEN 'doubted' WHEN 6 THEN 'overruled' ELSE NULL END AS relationship,
       0.5 + l_discount AS confidence, l_shipdate AS created_at
FROM {lineitem}, (SELECT count(*) AS n FROM {documents}) c"""
ACTS = """
SELECT CAST(o_orderkey % n AS STRING) AS case_id, o_orderpriority AS act_name, CAST(o_custkey % 500 AS STRING) AS section,
       o_totalprice / 1000000.0 AS confidence
FROM {orders}, (SELECT count(*) AS n FROM {documents}) c"""
LOG = """
SELECT event_id AS query_id, user_id, event_type AS match_type, CAST(floor(value) AS BIGINT) AS results_count, event_type <> 'error' AS success, ts
FROM {events}"""

#: The same as common table expressions for DuckDB.
_PARAS = """
SELECT case_id, CAST(para_no AS INT) AS para_no, text, case_id || '_' || CAST(para_no AS VARCHAR) AS paragraph_id,
       len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word_count,
       CASE para_no % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'issues' WHEN 2 THEN 'judgment' WHEN 3 THEN 'order' ELSE 'general' END AS para_type,
       CASE WHEN para_no % 7 = 0 THEN NULL ELSE CAST(length(text) % 100 AS DOUBLE) / 100 END AS quality_score
FROM (SELECT CAST(doc_id AS VARCHAR) AS case_id, pos - 1 AS para_no, p[pos] AS text
      FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""
_NAMES = {n: n for n in ("documents", "labels", "lineitem", "orders", "events")}
CTES = {"cases": CASES.format(**_NAMES), "cites": CITES.format(**_NAMES), "acts": ACTS.format(**_NAMES), "query_log": LOG.format(**_NAMES), "paras": _PARAS}


def oracle(body: str, *tables: str) -> str:
    """`body` behind the fixture tables it names."""
    named = tables or tuple(t for t in CTES if t in body)
    parts = ", ".join(f"{t} AS MATERIALIZED ({CTES[t]})" for t in named)
    more = not body.lstrip().startswith(("SELECT", "WITH"))
    return f"WITH {parts} {', ' if more else ''}{body}" if parts else f"WITH {body}" if more else body


class Fixtures:
    """The views over one folder, made when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.raw(n) for n in _NAMES if f"{{{n}}}" in text})

    @property
    def cases(self) -> DataFrame:
        return self._sql(CASES)

    @property
    def cites(self) -> DataFrame:
        return self._sql(CITES)

    @property
    def acts(self) -> DataFrame:
        return self._sql(ACTS)

    @property
    def log(self) -> DataFrame:
        return self._sql(LOG)

    @property
    def paras(self) -> DataFrame:
        rows = self.raw("documents").select(F.col("doc_id").cast("string").alias("case_id"), F.posexplode(F.split("text", "\n")).alias("para_no", "text"))
        types = F.array(*[F.lit(t) for t in ("facts", "issues", "judgment", "order", "general")])
        return rows.withColumns(
            {
                "paragraph_id": F.concat_ws("_", "case_id", "para_no"),
                "word_count": word_count(F.col("text")),
                "para_type": F.element_at(types, F.col("para_no") % 5 + 1),
                "quality_score": F.when(F.col("para_no") % 7 != 0, (F.length("text") % 100).cast("double") / 100),
                "judges_mentioned": F.array(F.concat(F.lit("judge"), (F.col("case_id").cast("bigint") % 37).cast("string")), F.concat(F.lit("judge"), (F.col("para_no") % 5).cast("string"))),
            }
        )

    @property
    def cases_with_lists(self) -> DataFrame:
        """Cases with subject_tags, acts_referred and total_paragraphs."""
        acts = self.acts.groupBy("case_id").agg(F.array_sort(F.collect_set("act_name")).alias("acts_referred"))
        lines = self.paras.groupBy("case_id").agg(F.count("*").alias("total_paragraphs"))
        return self.cases.withColumn("subject_tags", F.array("outcome", "court")).join(acts, "case_id", "left").join(lines, "case_id", "left")
