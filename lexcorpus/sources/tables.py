"""Corpus tables: schemas, loading, and writing with keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SCHEMAS = {
    "cases": "case_id string, case_name string, appeal_no string, court string, court_type string, year int, petitioner string, respondent string, judgment string, outcome string, authority_score double, citation_count bigint, total_paragraphs bigint, acts_referred array<string>, subject_tags array<string>, constitutional_articles array<string>",
    "paragraphs": "paragraph_id string, case_id string, para_no int, text string, para_type string, word_count int, quality_score double, judges_mentioned array<string>, embedding array<float>",
    "acts": "case_id string, act_name string, section string, confidence double",
    "citations": "source_case_id string, cited_case_id string, target_citation string, relationship string, confidence double, context_sentence string, paragraph_id string, created_at timestamp",
    "precedent_status": "case_id string, status string, strength int, label string, treatment_counts map<string,bigint>, citing_count bigint, updated_at timestamp",
}


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in names}


def total_order(df: DataFrame) -> list[Column]:
    """An order in which only equal rows are equal; columns that have no order count by their JSON."""
    plain = lambda t: not any(x in t.simpleString() for x in ("map<", "variant"))
    return [F.desc_nulls_last(f.name) if plain(f.dataType) else F.to_json(F.struct(f.name)).desc() for f in df.schema]


def upsert(target: DataFrame, updates: DataFrame, key: str | Sequence[str], newest: Column) -> DataFrame:
    """All rows of either side, the newest of each key; of equally new ones the updates', then the greatest by its columns."""
    both = target.withColumn("__side", F.lit(0)).unionByName(updates.withColumn("__side", F.lit(1)))
    order = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(newest.desc_nulls_last(), F.desc("__side"), *total_order(target))
    return both.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "__side")


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target and those rows whose key it does not hold, of each key the greatest by its columns."""
    first = Window.partitionBy(key).orderBy(*total_order(rows))
    new = rows.join(target.select(key), key, "left_anti").withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
    return target.unionByName(new)


def map_to_json(column: Column) -> Column:
    return F.to_json(F.coalesce(column, F.create_map().cast("map<string,bigint>")))


def map_from_json(column: Column) -> Column:
    return F.coalesce(F.from_json(column, T.MapType(T.StringType(), T.LongType())), F.create_map().cast("map<string,bigint>"))


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared checkpoint folder, its lineage cut there.

    Where spark.checkpoint.dir is unset and Spark runs on one machine (tests) a temporary folder is taken.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
