"""Dictionaries of any size as tables: phrases in texts, keys within queries, words that stand for others.

Texts are cut into what an entry could equal, and these pieces meet the entries in an equi-join, so
work grows with the texts and not with the dictionary. The lengths that entries have are read
first; no others are cut. Up to `SMALL` entries are broadcast. Null texts hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions.text import LETTER

#: Entries up to which a dictionary is broadcast.
SMALL = 100_000


def _lengths(entries: DataFrame, length: Column) -> Column:
    """The distinct lengths of the entries: a few numbers."""
    found = entries.select(length.cast("int").alias("n")).where("n > 0").distinct().collect()
    return F.array(*[F.lit(r.n) for r in found]).cast("array<int>")


def _offered(entries: DataFrame) -> DataFrame:
    return F.broadcast(entries) if entries.limit(SMALL + 1).count() <= SMALL else entries


def _words(text: Column) -> Column:
    """Words with what follows each, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LETTER}+)(?:[^{LETTER[1:-1]}]*)"), F.lit(0))


def phrases_in(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts (key, text) x phrases (distinct phrase in lower case, and more columns): the phrases that each text holds as whole words.

    Reads from the left, takes the longest phrase at each place, and goes on behind it. A row for every
    text that holds one: key and `found`, an array of (position in words from 0, words, phrase, more columns).
    Phrases begin and end with letters or digits, and match with the same signs between their words.
    """
    more = [c for c in phrases.columns if c != "phrase"]
    size = F.regexp_count("phrase", F.lit(f"{LETTER}+"))
    entries = phrases.where(size > 0).select("phrase", size.cast("int").alias("words"), F.struct(*more).alias("more") if more else F.lit(0).alias("more"))
    cut = texts.select(key, _words(F.col(text)).alias("w"), _lengths(entries, F.col("words")).alias("sizes"))
    grams = cut.select(key, "w", F.explode("sizes").alias("words")).where(F.size("w") >= F.col("words"))
    at = F.sequence(F.lit(0), F.size("w") - F.col("words"))
    gram = lambda i: F.regexp_replace(F.array_join(F.slice("w", i + 1, F.col("words")), ""), f"[^{LETTER[1:-1]}]+$", "")
    each = grams.select(key, "words", F.posexplode(F.transform(at, gram)).alias("position", "phrase"))
    met = each.join(_offered(entries), ["phrase", "words"])
    hit = F.struct("position", (-F.col("words")).alias("longest"), "words", "phrase", "more")
    # One text's hits, in reading order; the fold keeps what begins behind the last one kept.
    hits = met.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast(hits.schema["hits"].dataType).alias("kept"))

    def step(state: Column, x: Column) -> Column:
        end = (x["position"] + x["words"]).cast("int")
        return F.when(x["position"] >= state["free"], F.struct(end.alias("free"), F.concat(state["kept"], F.array(x)).alias("kept"))).otherwise(state)

    kept = F.aggregate("hits", start, step, lambda state: state["kept"])
    shown = lambda x: F.struct(x["position"].alias("position"), x["words"].alias("words"), x["phrase"].alias("phrase"), *[x["more"][c].alias(c) for c in more])
    return hits.select(key, F.transform(kept, shown).alias("found"))


def keys_within(queries: DataFrame, entries: DataFrame, key: str, text: str = "query") -> DataFrame:
    """queries (key, text) x entries (distinct entry in lower case, and more columns): every entry that a query holds anywhere, in any case."""
    low = F.lower(F.col(text))
    cut = queries.select(key, low.alias("__low"), F.explode(_lengths(entries, F.length("entry"))).alias("n")).where(F.length("__low") >= F.col("n"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__low") - F.col("n") + 1), lambda i: F.substring(F.col("__low"), i, F.col("n"))))
    return cut.select(key, F.explode(pieces).alias("entry")).join(_offered(entries), "entry")


def replaced_words(texts: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts (key, text) x words (distinct word in lower case, replacement): key and `replaced`, the text in lower case with every such word replaced."""
    low = F.lower(F.col(text))
    lead = F.regexp_extract(low, f"^[^{LETTER[1:-1]}]*", 0)
    cut = texts.select(key, lead.alias("lead"), F.posexplode_outer(_words(F.col(text))).alias("at", "piece"), low.isNull().alias("none"))
    parts = cut.withColumns({"word": F.regexp_extract("piece", f"^({LETTER}+)", 1), "gap": F.regexp_extract("piece", f"([^{LETTER[1:-1]}]*)$", 1)})
    made = parts.join(_offered(words), "word", "left").withColumn("part", F.concat(F.coalesce("replacement", "word"), "gap"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return made.groupBy(key).agg(F.when(~F.first("none"), F.concat(F.first("lead"), joined)).alias("replaced"))
