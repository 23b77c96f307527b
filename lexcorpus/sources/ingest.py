"""Reading text documents and cutting them into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "paragraph_id string, document_id string, para_no int, text string, word_count int"


def read_text_docs(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(document_id, text): one row per file under `path`, named by the file; texts under `least` letters are left out."""
    files = spark.read.text(path, wholetext=True).withColumn("document_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))
    return files.where(F.length(F.trim("value")) >= least).select("document_id", F.col("value").alias("text"))


def chunk_text(text: str | None, size: int = 300, overlap: int = 50, least: int = 30, separator: str = r"\n{2,}", shortest: int = 5) -> Iterator[list[str]]:
    """Words of each chunk: paragraphs gathered up to `size` words, the next one taking the last `overlap` along."""
    held: list[str] = []
    for para in re.split(separator, (text or "").replace("\r\n", "\n")):
        words = para.split()
        if len(words) < shortest:
            continue
        if held and len(held) + len(words) > size:
            if len(held) >= least:
                yield held
            held = held[-overlap:] + words if overlap else words
        else:
            held = held + words
    if len(held) >= least:
        yield held


def chunk_documents(docs: DataFrame, **options) -> DataFrame:
    """Chunks of documents (document_id, text); a document is cut where it lies, without a shuffle."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"DOC_{d}_P{k:04d}", d, k, " ".join(words), len(words)) for d, text in zip(pdf["document_id"], pdf["text"], strict=True) for k, words in enumerate(chunk_text(text, **options))]
            yield pd.DataFrame(rows, columns=["paragraph_id", "document_id", "para_no", "text", "word_count"])

    return docs.select(F.col("document_id").cast("string").alias("document_id"), "text").mapInPandas(cut, CHUNK)
