"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The remainder of crc32(doc_id as text) modulo 4 that is held out of every training step.
HELD_OUT = 2


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """Spark's checkpoint folder, set from spark.checkpoint.dir where it is not yet.

    Only where that is unset and Spark runs on one machine (tests) a temporary folder is taken.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and cuts its lineage there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder: smaller than a checkpoint, for columns that Parquet can hold."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """`df` as a table of the warehouse in `buckets` by `key`: a join on that key with as many partitions does not shuffle it."""
    name = f"table_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)


def hashable(df: DataFrame) -> list[str]:
    """The columns of `df` that can be hashed: all but those that hold a map or a variant."""
    return [f"`{f.name}`" for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About `rows` rows of `df` (all, if it has fewer), the same ones on every run.

    Rows whose keys fall in the lowest part of the hash range are taken, so the size is `rows`
    give or take its square root for distinct keys; rows of equal keys stay together.
    """
    total = df.count()
    if total <= rows:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(steps)) < int(steps * rows / total))
