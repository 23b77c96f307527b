"""Work on tables of queries: names, spelling, expansion, intents, enrichment and the query log."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexcorpus.functions import dictionaries as D
from lexcorpus.functions import text as X
from lexcorpus.operators.similarity import similar_names, within_edits
from lexcorpus.sources import tables


def name_words(mention: Column) -> Column:
    """Words of a mention that can name a case; null where it names none."""
    words = F.filter(X.tokens(mention), lambda w: (F.length(w) > 2) & ~w.isin(D.FUNCTION_WORDS + D.INTENT_WORDS))
    generic = F.size(F.filter(words, lambda w: w.isin(D.GENERIC_NOUNS)))
    telling = F.exists(words, lambda w: (F.length(w) >= 4) & ~w.isin(D.GENERIC_NOUNS))
    topic = (F.size(words) >= 2) & (generic >= F.size(words) * 0.6)
    return F.when(telling & ~topic, words)


def _words_inside(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words (distinct word) x vocabulary (distinct token): which tokens hold each word, met on the word's rarest piece."""
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    known = vocabulary.where(F.length("token") > 2).select("token", F.explode(pieces("token")).alias("piece"))
    counts = known.groupBy("piece").agg(F.count("*").alias("__n"))
    asked = words.where(F.length("word") > 2).select("word", F.explode(pieces("word")).alias("piece"))
    rarest = asked.join(counts, "piece", "left").groupBy("word").agg(F.min_by("piece", F.struct(F.coalesce("__n", F.lit(0)), "piece")).alias("piece"))
    return known.join(rarest, "piece").where(F.contains("token", F.col("word"))).select("word", "token")


def resolve_names(mentions: DataFrame, cases: DataFrame) -> DataFrame:
    """mentions (mention_id, mention) -> the case each one names, by the strictest level that finds one.

    1: three-letter pieces more than half in common (not for a single word under 7 letters);
    2: all of two or more words in the name; 3: at least two of them; 4: a single word of 6 letters.
    Names are deduplicated, and so are mentions of the same words: these are resolved once, so the work grows
    with different wordings. Level 1 is a similarity join. For the others the distinct words of the
    mentions meet the distinct words of the names that hold them, and mentions meet names through all
    their words but the commonest: a name that holds two of them holds one of those.
    """
    stated = mentions.select("mention_id", F.array_join(name_words(F.col("mention")), " ").alias("search")).where("search is not null")
    asked = tables.written(stated.select("search").distinct()).withColumn("words", F.split("search", " "))
    names = tables.written(cases.where(F.col("case_name").isNotNull()).groupBy(F.lower("case_name").alias("name")).agg(F.min("case_id").alias("case_id")))
    n, first = F.size("words"), F.element_at("words", 1)
    alike = similar_names(asked.select(F.col("search").alias("name")), names.select("name")).withColumnsRenamed({"a": "search", "b": "name"})
    closest = asked.join(alike, "search").where((n > 1) | (F.length(first) >= 7)).select("search", "name", F.lit(1).alias("level"), (-F.col("similarity")).alias("within"))

    held = names.select("name", F.explode(F.array_distinct(X.tokens(F.col("name")))).alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    inside = _words_inside(asked.select(F.explode("words").alias("word")).distinct(), counts).join(counts, "token")
    each = asked.select("search", F.explode(F.array_distinct("words")).alias("word"))
    rated = each.join(inside.groupBy("word").agg(F.sum("n").alias("n")), "word")  # words that no name holds find nothing
    by_rarity = F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"])
    known = rated.groupBy("search").agg(by_rarity.alias("known")).join(asked, "search")
    telling = F.when((F.size("known") > 1) & (F.size(F.array_distinct("words")) == n), F.slice("known", 1, F.size("known") - 1)).otherwise(F.col("known"))
    heads = known.select("search", F.explode(telling).alias("word")).join(inside.select("word", "token"), "word")
    pairs = heads.join(held, "token").select("search", "name").distinct().join(asked, "search")
    found = F.size(F.filter("words", lambda w: F.contains(F.col("name"), w)))
    level = F.when((n >= 2) & (found == n), 2).when((n >= 2) & (found >= 2), 3).when((n == 1) & (F.length(first) >= 6) & (found == 1), 4)
    within = F.when(F.col("level") == 3, -found.cast("double")).when(F.col("level") == 4, F.length("name").cast("double")).otherwise(0.0)
    worded = pairs.withColumn("level", level).where("level is not null").select("search", "name", "level", within.alias("within"))

    best = F.min(F.struct("level", "within", "case_id")).alias("best")
    resolved = closest.unionByName(worded).join(names, "name").groupBy("search").agg(best)
    return stated.join(resolved, "search").groupBy("mention_id").agg(F.min("best").alias("best")).select("mention_id", "best.case_id", "best.level")


def expand(queries: DataFrame, dictionary: Mapping[str, Sequence[str]] = D.SYNONYMS) -> DataFrame:
    """Adds `synonyms`: what the dictionary has for the keys that a query holds, sorted."""
    found = F.flatten(F.array(*[F.when(F.contains(F.lower("query"), F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in dictionary.items()]))
    return queries.withColumn("synonyms", F.array_sort(F.array_distinct(found)))


def corrections(words: DataFrame, spellings: Mapping[str, Sequence[str]] = D.SPELLINGS, threshold: float = 0.8) -> DataFrame:
    """`words` (distinct word) with `corrected`: by variant, else the most alike canonical word; null if none.

    The dictionary is a parameter of fixed size; each distinct word is compared with it once.
    """
    variants = {v.lower(): c for c, some in spellings.items() for v in some}

    def corrected(word: str) -> str | None:
        low = word.lower()
        if low in variants or low in spellings:
            return variants.get(low, low)
        best, most = None, threshold
        for canonical in spellings:
            ratio = SequenceMatcher(None, low, canonical).ratio()
            if ratio > most:
                best, most = canonical, ratio
        return best

    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([corrected(w) for w in part], dtype=object)

    return words.withColumn("corrected", each("word"))


def boosted_terms(queries: DataFrame, terms: Mapping[str, tuple[float, Sequence[str]]] = D.NATIVE_TERMS) -> DataFrame:
    """Adds `native_terms`: (term, boost) of the terms of which a query holds some wording, by term."""
    low = F.lower("query")
    found = [F.when(_holds(low, wordings), F.struct(F.lit(t).alias("term"), F.lit(boost).alias("boost"))) for t, (boost, wordings) in sorted(terms.items())]
    return queries.withColumn("native_terms", F.array_compact(F.array(*found)))


def spellings(queries: DataFrame, variants: Mapping[str, Sequence[str]] = D.TRANSLITERATIONS) -> DataFrame:
    """Adds `spellings`: the query, and in lower case each rewrite of a word it holds to another spelling."""
    low = F.lower("query")
    made = [F.when(F.contains(low, F.lit(k)), F.replace(low, F.lit(k), F.lit(v))) for k, vs in variants.items() for v in vs]
    return queries.withColumn("spellings", F.array_distinct(F.concat(F.array("query"), F.array_compact(F.array(*made)))))


def learned_corrections(suggestions: DataFrame) -> DataFrame:
    """suggestions (misspelling, correction, confidence, at): per misspelling the newest ones and how many there were.

    Of suggestions made at one time the alphabetically last correction counts, then the highest confidence.
    """
    newest = F.max_by(F.struct("correction", "confidence"), F.struct("at", "correction", "confidence")).alias("newest")
    return suggestions.groupBy("misspelling").agg(newest, F.count("*").alias("n")).select("misspelling", "newest.*", "n")


def correct_queries(queries: DataFrame, **options) -> DataFrame:
    """Adds corrected_query and n_corrections; words that need none keep their form."""
    spread = queries.select("query_id", F.posexplode(F.filter(F.split("query", r"\s+"), lambda w: w != "")).alias("pos", "raw")).withColumn("word", F.regexp_replace("raw", X.GAP, ""))
    fixed = corrections(spread.where("word <> ''").select("word").distinct(), **options)
    joined = spread.join(fixed, "word", "left")
    changed = F.col("corrected").isNotNull() & (F.col("corrected") != F.col("word"))
    parts = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.when(changed, F.col("corrected")).otherwise(F.col("raw")).alias("word")))).alias("parts"), F.count_if(changed).alias("n_corrections"))
    made = parts.select("query_id", F.array_join("parts.word", " ").alias("corrected_query"), "n_corrections")
    return queries.join(made, "query_id", "left").withColumns({"corrected_query": F.coalesce("corrected_query", "query"), "n_corrections": F.coalesce("n_corrections", F.lit(0))})


def did_you_mean(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words (word) absent from vocabulary (token, n): the nearest word within two edits with the same two letters in front.

    Both tables are read several times, so they are written first: the texts behind a vocabulary are cut once.
    """
    vocabulary = tables.written(vocabulary.select("token", "n"))
    absent = words.select(F.lower("word").alias("word")).distinct().where(F.length("word") >= 3)
    absent = absent.join(vocabulary.select(F.col("token").alias("word")), "word", "left_anti")
    absent = tables.written(absent)
    known = vocabulary.where(F.length("token") >= 3)
    pairs = within_edits(absent.select("word", F.lit(2).alias("most")), known, same_start=2).join(known, "token")
    best = F.min_by(F.struct(F.col("token").alias("suggestion"), "edits"), F.struct("edits", -F.col("n"), "token"))
    return pairs.groupBy("word").agg(best.alias("best")).select("word", "best.*")


def _holds(query: Column, words: Sequence[str]) -> Column:
    some = F.lit(False)
    for w in words:
        some = some | F.contains(query, F.lit(w))
    return some


def intents(queries: DataFrame) -> DataFrame:
    """Adds output_type, para_types, confidence and study_type; case_id, where a query names one, is used."""
    q = F.lower(F.trim("query"))
    for form in (" vs. ", " versus ", " v/s ", " v/s. "):
        q = F.replace(q, F.lit(form), F.lit(" v. "))
    named = F.col("case_id").isNotNull() if "case_id" in queries.columns else F.lit(False)
    question = _holds(q, D.QUESTIONS)
    none = F.lit(None).cast("string")
    rule, types = none, F.array().cast("array<string>")
    for words, intent, paras in reversed(D.INTENTS):
        rule = F.when(_holds(q, words), intent).otherwise(rule)
        types = F.when(_holds(q, words), F.array(*map(F.lit, paras)).cast("array<string>")).otherwise(types)
    listed = _holds(q, D.TABLE_TRIGGERS)
    law = _holds(q, D.LAW_TRIGGERS)
    output = (
        F.when(listed, "table")
        .when(law, "law")
        .when(named & (rule == "citation_graph"), "citation_graph")
        .when(named & question, "case_answer")
        .when(named & (rule == "judgment_only"), "judgment_only")
        .when(named, "full_case")
        .otherwise(F.coalesce(rule, F.lit("hybrid")))
    )
    of = lambda *t: F.array(*map(F.lit, t))
    para_types = (
        F.when(listed, F.array().cast("array<string>"))
        .when(law, of("law", "statute", "legal"))
        .when(named & (rule == "citation_graph"), of("citation"))
        .when(named & question, of("judgment", "order", "facts", "issues"))
        .when(named & (rule == "judgment_only"), of("judgment", "order"))
        .when(named, of("judgment", "order", "facts"))
        .when(rule.isNull(), of("judgment", "order", "facts", "issues", "citation", "law"))
        .otherwise(types)
    )
    score = F.when(named & ~listed & ~law, 0.4).otherwise(0.0) + F.when(output.isin("table", "law"), 0.0).otherwise(0.3) + F.when(question, 0.3).otherwise(0.0)
    score = F.when(F.contains(q, F.lit("what is")) & ~(named & ~listed & ~law), F.least(score, F.lit(0.5))).otherwise(score)
    study = F.lit("concept_explanation")
    for words, intent in reversed(D.STUDY_INTENTS):
        study = F.when(_holds(q, words), intent).otherwise(study)
    return queries.withColumns({"output_type": output, "para_types": para_types, "confidence": F.round(score, 2), "study_type": study})


def enrich(queries: DataFrame, **options) -> DataFrame:
    """Phrases, sections, corrections and synonyms of each query, its match type and rank score."""
    made = expand(correct_queries(queries, **options))
    q = F.col("corrected_query")
    made = made.withColumns({"phrases": X.legal_phrases(q), "sections": X.section_meanings(q)})
    kind = F.when(F.size("phrases") > 0, "exact_phrase").when(F.size("sections") > 0, "exact_section").otherwise("semantic")
    kind = F.when((F.col("n_corrections") > 0) & F.startswith(kind, F.lit("exact")), F.replace(kind, F.lit("exact"), F.lit("corrected"))).otherwise(kind)
    ranks = F.create_map(*[F.lit(x) for pair in D.MATCH_RANKS.items() for x in pair])
    return made.withColumn("match_type", kind).withColumn("rank_score", F.coalesce(F.element_at(ranks, F.col("match_type")), F.lit(0.5)))


def log_statistics(log: DataFrame) -> DataFrame:
    """One row: queries, successes and their rate, 0 where there is none."""
    done = F.count_if("success")
    return log.agg(F.count("*").alias("total"), done.alias("successes"), F.coalesce(F.try_divide(done, F.count("*")), F.lit(0.0)).alias("success_rate"))


def log_patterns(log: DataFrame, n: int = 5) -> DataFrame:
    """The n commonest match types of successes, and all failures by match type."""
    counts = log.groupBy("success", "match_type").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("success").orderBy(F.desc("n"), "match_type")))
    return ranked.where(~F.col("success") | (F.col("rank") <= n)).select("success", "match_type", "n")
