"""Dictionaries as tables against patterns and plain code."""

import random
import re

from lexcorpus.functions import dictionaries as D
from lexcorpus.functions import text as X
from lexcorpus.operators import phrase_tables
from pyspark.sql import functions as F

WORDS = ["natural", "justice", "law", "of", "the", "land", "a", "b"]


def plain_phrases(text, phrases):
    order = sorted(phrases, key=lambda p: (-len(p.split()), -len(p)))
    return [m.group(1) for m in re.finditer(r"(?<!\w)(" + "|".join(map(re.escape, order)) + r")(?!\w)", text.lower())]


def test_phrases_equal_one_large_pattern(spark):
    rng = random.Random(13)
    phrases = list({" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(60)} | {"law-land"})
    texts = ["".join(x for _ in range(rng.randrange(25)) for x in (rng.choice(WORDS), rng.choice([" ", " ", " ", "  ", ", ", "-"]))) for _ in range(300)] + ["", None, "(Natural Justice)", "  law"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(p, p.upper(), i) for i, p in enumerate(phrases)], "phrase string, canonical string, rank int")
    got = {r.id: [(x.phrase, x.canonical) for x in r.found] for r in phrase_tables.phrases_in(df, table, "id").collect()}
    wanted = {i: [(p, p.upper()) for p in found] for i, t in enumerate(texts) if t and (found := plain_phrases(t, phrases))}
    assert got == wanted
    bare = phrase_tables.phrases_in(df, table.select("phrase"), "id")
    assert {r.id: len(r.found) for r in bare.collect()} == {k: len(v) for k, v in wanted.items()}
    assert phrase_tables.phrases_in(df, table.limit(0), "id").count() == phrase_tables.phrases_in(df.limit(0), table, "id").count() == 0


def test_a_hundred_thousand_phrases(spark, monkeypatch):
    table = spark.range(100_001).select(F.concat(F.lit("phrase "), F.col("id").cast("string"), F.lit(" of law")).alias("phrase"))
    df = spark.range(300).select("id", F.concat(F.lit("The Phrase "), (F.col("id") * 700).cast("string"), F.lit(" of law, phrase 5 of")).alias("text"))
    made = phrase_tables.phrases_in(df, table, "id")
    assert {(r.id, r.found[0].phrase, r.found[0].position) for r in made.collect()} == {(i, f"phrase {i * 700} of law", 1) for i in range(143)}
    assert "phrase 70000" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_legal_phrases_equal_the_column_function(spark):
    texts = ["bail and anticipatory bail under natural justice", "Quashing of FIR, cheque bounce"] + [f"x {p} y {q}" for p in D.PHRASES for q in D.PHRASES]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(p, c) for p, (c, *_) in D.PHRASES.items()], "phrase string, canonical string")
    got = {r.id: [x.canonical for x in r.found] for r in phrase_tables.phrases_in(df, table, "id").collect()}
    wanted = {r.id: r.c for r in df.select("id", X.legal_phrases(F.col("text"))["canonical"].alias("c")).collect() if r.c}
    assert got == wanted


def test_keys_and_replacements_equal_plain_code(spark):
    rng = random.Random(14)
    keys = list({"".join(rng.choices("abcé ", k=rng.randrange(1, 6))) for _ in range(80)})
    texts = ["".join(rng.choices("abcÉé .-", k=rng.randrange(30))) for _ in range(200)] + ["", None, "...", " a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, query string")
    entries = spark.createDataFrame([(k, 1) for k in keys], "entry string, n int")
    got = {(r.id, r.entry) for r in phrase_tables.keys_within(df, entries, "id").collect()}
    assert got == {(i, k) for i, t in enumerate(texts) if t for k in keys if k in t.lower()}
    words = {"a": "alpha", "bc": "b c", "é": ""}
    table = spark.createDataFrame(list(words.items()), "word string, replacement string")
    got = {r.id: r.replaced for r in phrase_tables.replaced_words(df, table, "id", "query").collect()}
    assert got == {i: None if t is None else re.sub(r"\w+", lambda m: words.get(m.group(), m.group()), t.lower()) for i, t in enumerate(texts)}
