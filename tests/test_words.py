"""Texts are cut once for what is asked of their words."""

from pyspark.sql import functions as F

from lexcorpus.functions import text as X
from lexcorpus.operators import query_tables


def test_words_are_cut_once_and_counted_alike(spark):
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        cuts.add(1)
        return text

    rows = [("a", "the runs, running RUN  of"), ("b", None), ("b", ""), ("b", "cats cat\ncat Élan"), ("c", "...")]
    paras = spark.createDataFrame(rows, "case_id string, text string")
    told = lambda df: sorted((r.case_id, r.token, r.n) for r in df.collect())
    plain = told(X.english_tokens(paras, "case_id").groupBy("case_id", "token").agg(F.count("*").alias("n")))
    read = paras.withColumn("text", seen("text"))
    assert told(X.english_counts(read, "case_id")) == plain and ("a", "run", 3) in plain
    assert cuts.value == len(rows)
    vocabulary = X.token_table(read).groupBy("token").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([("runing",), ("cat",), ("cass",)], "word string")
    assert {tuple(r) for r in query_tables.did_you_mean(asked, vocabulary).collect()} == {("runing", "running", 1), ("cass", "cats", 1)}
    assert cuts.value == 2 * len(rows)


def test_words_need_no_lambda(spark):
    made = spark.createDataFrame([(" a  B-c. ",)], "text string").select(X.tokens(F.col("text")).alias("w"))
    assert made.first().w == ["a", "b", "c"] and "lambda" not in made._jdf.queryExecution().analyzed().toString()
