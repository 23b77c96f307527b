"""The corpus pipeline: stages over `documents`, each one operator of lexcorpus.llm.

Every stage but the last returns the columns of the documents it was given. Language ID drops
texts in which no learned language stands out, toxicity those that score as toxic, and the
near-duplicate join all but one of each class; secrets are cut out of the texts that stay, and
packing lays the rest out in training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.llm import langid, near_dup, queries, secret_scan, toxicity
from lexcorpus.llm.common import checkpointed, held_out, table

#: The least posterior of a language, and the least score of a toxic text.
LEAST_LANGUAGE, LEAST_TOXIC = 0.5, 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a letter for which one language is likelier than all others together."""
    model = langid.fit(docs.where(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    told = langid.predict(docs, model, lang_out="__lang", score_out="__score")
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE)).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below the toxic threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model, out_col="__score").where(F.col("__score") < LEAST_TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate class."""
    return near_dup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets replaced by a mark and its length counted anew."""
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents out in sequences of at most 2048 tokens; one row per piece."""
    return queries.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No stage but the base patterns of the fourth can be written in SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what lies between them is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
