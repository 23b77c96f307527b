"""Vectors: exact nearest neighbours by blocks, embedding of a text column, and hybrid retrieval."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexcorpus.functions.text import tokens
from lexcorpus.operators import cells, evidence, postings, rank, search

#: Rows of either side in one block of the product; paragraphs in one block of the word search.
QUERIES_A_BLOCK, ROWS_A_BLOCK, PARAGRAPHS_A_BLOCK = 1024, 8192, 65_536


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, decimals: int = 9) -> DataFrame:
    """queries (query_id, vector) x corpus (id, vector): the k rows of highest cosine, ties to the smaller id.

    Both sides are dealt to blocks by hash, every pair of blocks is one cell, and a cell returns k
    rows per query, so neither side is broadcast or gathered. Scores are rounded before ranking,
    so that ties do not hang on the order of additions. Null vectors and null vectors' rows take
    no part, and neither do zero vectors.
    """
    fit = lambda df: df.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))
    queries, corpus = fit(queries), fit(corpus)
    wide, high = (max(1, math.ceil(x.count() / n)) for x, n in ((queries, QUERIES_A_BLOCK), (corpus, ROWS_A_BLOCK)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    # Numbers of blocks have one type on both sides, for ints and longs hash apart and a cogroup does not cast them.
    left = queries.select("query_id", "vector", block("query_id", wide).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("j"))
    right = corpus.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("i"), block("id", high).alias("j"))

    def normal(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_list()).astype(float)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        c = c.sort_values("id", kind="stable")
        scores = np.round(normal(q["vector"]) @ normal(c["vector"]).T, decimals)
        least = np.partition(scores, max(0, len(c) - k), axis=1)[:, max(0, len(c) - k)]
        row, at = np.nonzero(scores >= least[:, None])  # at least k of each query, with all that tie with the k-th
        score = scores[row, at]
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row[best]], "id": c["id"].to_numpy()[at[best]], "score": score[best]})

    met = left.select("i", "j", "query_id", "vector").groupBy("i", "j").cogroup(right.select("i", "j", "id", "vector").groupBy("i", "j")).applyInPandas(product, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def embed(df: DataFrame, encoder: Callable[[Sequence[str]], np.ndarray], text_col: str = "text", batch: int = 32) -> DataFrame:
    """Adds `embedding`, unit vectors of `text_col` from the encoder given; zero vectors stay zero."""

    @F.pandas_udf("array<double>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [np.asarray(encoder(texts.iloc[i : i + batch].fillna("").tolist()), dtype=float) for i in range(0, len(texts), batch)]
            yield pd.Series([row.tolist() for part in parts for row in part], dtype=object)

    made = df.withColumn("embedding", encoded(F.col(text_col)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return made.withColumn("embedding", F.transform("embedding", lambda x: F.when(norm > 0, x / norm).otherwise(x)))


def _leading(limit: int) -> cells.Maker:
    """Of the cases of a batch the hits of each query that can be among its first `limit`.

    A hit is left out if that many cases stand before it by their words alone. Another hit of one of these only
    lifts it, unless its own has no relevance, which counts as 0 among hits but as a half in the score; such
    a case keeps its place but counts for none.
    """

    def make(queries: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        names = queries["query_id"].combine_chunks()
        asking, word = cells.flat(queries["words"])
        word = word.dictionary_encode()
        words, number = word.dictionary.to_pylist(), word.indices.to_numpy()
        many = np.bincount(asking, minlength=len(names))
        starts = np.cumsum(many) - many
        least = [len(t) for t in queries["terms"].to_pylist()]
        match = postings._held_terms(pa.table({"query_id": np.arange(len(names)), "terms": queries["terms"], "least": pa.array(least, pa.int64())}))

        def boosts(query: np.ndarray, name: np.ndarray, called: pa.Array) -> np.ndarray:
            """How many words of each query stand in a name; 0 below two. Each word is looked for once in each name."""
            times = many[query]
            ends = np.cumsum(times)
            entry = number[np.arange(ends[-1]) + np.repeat(starts[query] - (ends - times), times)]
            pair, order = np.repeat(np.arange(len(query)), times), np.argsort(entry, kind="stable")
            borders = np.flatnonzero(np.diff(entry[order], prepend=-1, append=-1))
            boost = np.zeros(len(query), np.int64)
            for low, high in zip(borders, borders[1:], strict=False):
                stands = pc.match_substring(called, words[entry[order[low]]]).to_numpy(zero_copy_only=False)
                own = pair[order[low:high]]  # each once, for the words of a query are distinct
                boost[own] += stands[name[own]]
            boost[boost < 2] = 0
            return boost

        def lead(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ranked = lambda x: np.unique(np.array(x.to_pylist(), dtype=object), return_inverse=True)[1]
            case, relevance = ranked(rows["case_id"]), rows["relevance_score"].to_numpy().astype(float)  # nan where it is null
            # Rows are sorted once, as they stand in each query's hits: by case, in it the best first.
            order = np.lexsort((ranked(rows["paragraph_id"]), -np.nan_to_num(relevance), case))
            rows, case, relevance = rows.take(pa.array(order)).combine_chunks(), case[order], relevance[order]
            found = list(match(pa.table({"case_id": np.arange(rows.num_rows), "held": rows["held"]})))
            query, row = (np.concatenate([x[c].to_numpy() for x in found]) for c in ("query_id", "case_id"))
            if not len(query):
                return
            order = np.argsort(query, kind="stable")
            query, row = query[order], row[order]
            best = (np.diff(query, prepend=-1) != 0) | (np.diff(case[row], prepend=-1) != 0)
            query, row = query[best], row[best]
            called = rows["name"].combine_chunks().dictionary_encode()
            boost = boosts(query, called.indices.to_numpy()[row], called.dictionary)
            place = np.empty(rows.num_rows, np.int64)
            place[np.lexsort((case, -rows["score"].to_numpy()))] = np.arange(rows.num_rows)
            highest = boost.max() + 1
            order = np.argsort((query * highest + highest - 1 - boost) * rows.num_rows + place[row])
            query, row = query[order], row[order]
            ids, paragraphs = rows["case_id"].combine_chunks(), rows["paragraph_id"].combine_chunks()
            before = np.cumsum(~np.isnan(relevance[row])) - ~np.isnan(relevance[row])
            kept = before - before[np.searchsorted(query, query)] < limit
            at = pa.array(row[kept])
            columns = [names.take(pa.array(query[kept])), ids.take(at), paragraphs.take(at), rows["relevance_score"].combine_chunks().take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "case_id", "paragraph_id", "relevance_score"])

        return lead

    return make


def word_hits(queries: DataFrame, paras: DataFrame, cases: DataFrame, limit: int = 10, **filters) -> DataFrame:
    """queries (query_id, query, terms): paragraphs (case_id, paragraph_id, text, relevance_score) that hold all terms, as far as `hybrid` can rank them.

    Cases and queries meet in a grid, whose blocks leave out what cannot come among the first `limit` of a
    query, so what is shuffled grows with texts and with queries times blocks, not with all hits.
    """
    info = search.filter_hits(cases, **filters).select("case_id", "year", F.lower("case_name").alias("name"))
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms"), rank.name_words(F.col("query")).alias("words"))
    held = paras.select("case_id", "paragraph_id", "relevance_score", F.array_distinct(tokens(F.col("text"))).alias("held")).where("size(held) > 0")
    rows = held.join(info, "case_id").select("case_id", "paragraph_id", "relevance_score", "held", F.coalesce("name", F.lit("")).alias("name"), rank.rerank_score(F.lit(0.0)).alias("score"))
    numbers = cells.blocks(asked.count(), postings.QUERIES_A_BLOCK), cells.blocks(paras.count(), PARAGRAPHS_A_BLOCK, queries.sparkSession.sparkContext.defaultParallelism)
    schema = T.StructType([asked.schema["query_id"], *[rows.schema[c] for c in ("case_id", "paragraph_id", "relevance_score")]])
    return cells.met(asked, rows, ("query_id", "case_id"), numbers, _leading(limit), schema, grouped=True)


def hybrid(queries: DataFrame, lexical: DataFrame, named: DataFrame, near: DataFrame, cases: DataFrame, cites: DataFrame, limit: int = 10, **filters) -> DataFrame:
    """Word hits, name hits (0.95) and vector hits, the best of each case, filtered, boosted and ranked."""
    columns = ["query_id", "case_id", "paragraph_id", "relevance_score", "result_type"]
    hits = lexical.select(columns).unionByName(named.withColumns({"relevance_score": F.lit(0.95), "result_type": F.lit("case")}).select(columns)).unionByName(near.select(columns))
    best = search.filter_hits(evidence.best_hits(hits).join(cases, "case_id"), **filters)
    scored = rank.rerank(best, cites).join(queries.select("query_id", "query"), "query_id")
    boosted = scored.withColumn("boost", rank.name_hits(F.col("case_name"), F.col("query")))
    order = Window.partitionBy("query_id").orderBy(F.desc("boost"), F.desc("rerank_score"), "case_id")
    return boosted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "case_id", "rerank_score", "boost")
