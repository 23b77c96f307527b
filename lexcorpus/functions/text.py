"""Text functions, column to column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions import dictionaries as D
from lexcorpus.functions import stem
from lexcorpus.sources import tables


def escaped(word: str) -> str:
    """A word as a regular expression that matches it."""
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}-" else c for c in word)


#: What words consist of, in any script, with the marks that letters carry; what lies between them; and the borders of a whole word.
LETTER, GAP = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]+"
BEGIN, END = rf"(?<!{LETTER})", rf"(?!{LETTER})"


def tokens(text: Column) -> Column:
    """Lower-case words of a text in order."""
    return F.array_remove(F.split(F.lower(text), GAP), "")  # compiled with the rest of its stage, as a lambda is not


def words_of(text: str) -> list[str]:
    """The same words of a plain string."""
    return regex.findall(f"{LETTER}+", text.lower())


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_table(paras: DataFrame, *keys: str) -> DataFrame:
    """One row per word of each paragraph: keys, pos, token."""
    return paras.select(*keys, F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def english_tokens(paras: DataFrame, *keys: str) -> DataFrame:
    """`token_table` as English: without stop words, with Snowball stems, which each distinct word gets once."""
    found = token_table(paras, *keys).where(~F.col("token").isin(stem.STOP_WORDS))
    stems = stem.stemmed(found.select("token").distinct())
    return found.join(stems, "token").select(*keys, "pos", F.col("stem").alias("token"))


def english_counts(paras: DataFrame, *keys: str) -> DataFrame:
    """keys, token, n: how often each stem stands under the keys, without stop words.

    Words are counted before they are joined: texts are cut once, and what is written and joined is a row for each
    distinct word of a key, not each word.
    """
    found = token_table(paras, *keys).where(~F.col("token").isin(stem.STOP_WORDS))
    counts = tables.written(found.groupBy(*keys, "token").agg(F.count("*").alias("n")))
    stems = stem.stemmed(counts.select("token").distinct())
    return counts.join(stems, "token").groupBy(*keys, F.col("stem").alias("token")).agg(F.sum("n").alias("n"))


def context_window(text: Column, needle: Column, chars: int, low: Column | None = None) -> Column:
    """What stands within `chars` of the first occurrence in any case, white space joined; null without one.

    `low` is the text in lower case, where that is at hand.
    """
    at = F.instr(F.lower(text) if low is None else low, F.lower(needle))
    start = F.greatest(at - chars, F.lit(1))
    cut = F.substring(text, start, at + F.length(needle) + chars - start)
    return F.when(at > 0, F.regexp_replace(F.trim(cut), r"\s+", " "))


def highlighted(text: Column, terms: Sequence[str], window: int = 80, most: int = 300) -> Column:
    """Spans (text, highlighted) of the window around the first term; joined they are the window."""
    any_term = "(?iu)(" + "|".join(escaped(t) for t in terms) + ")"
    at = F.regexp_instr(text, F.lit(any_term))
    hit = F.regexp_extract(text, any_term, 1)
    start = F.greatest(at - window, F.lit(1))
    end = F.least(at + F.length(hit) + window - 1, F.length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    plain = F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise(""))
    parts = F.split(F.regexp_replace(F.when(at > 0, cut).otherwise(plain), any_term, "\x01\x02$1\x01"), "\x01")
    spans = F.transform(parts, lambda p: F.struct(F.replace(p, F.lit("\x02"), F.lit("")).alias("text"), F.startswith(p, F.lit("\x02")).alias("highlighted")))
    return F.filter(spans, lambda s: s["text"] != "")


def section_references(text: Column) -> Column:
    """Distinct section and article numbers, in the order of the four wordings."""
    wordings = (r"(?i)\bsection\s+(\d{1,4}[a-zA-Z]?)\b", r"(?i)\bs\.?\s+(\d{1,4}[a-zA-Z]?)\b", r"(?i)\barticle\s+(\d{1,3})\b", r"(?i)\bart\.?\s+(\d{1,3})\b")
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in wordings])))


def section_meanings(text: Column) -> Column:
    """Numbers of three or four digits with their meanings, as (section, meaning)."""
    known = F.create_map(*[F.lit(x) for pair in D.SECTION_MEANINGS.items() for x in pair])
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b([0-9]{3,4}[a-z]?)\b"), F.lit(1))
    return F.transform(found, lambda s: F.struct(s.alias("section"), F.coalesce(F.element_at(known, s), F.concat(F.lit("Section "), s)).alias("meaning")))


def legal_phrases(text: Column) -> Column:
    """Whole-word legal phrases, the longest first and none inside another: wording, canonical, type, priority."""
    longest = sorted(D.PHRASES, key=lambda p: (-len(p), p))
    info = F.create_map(*[x for p, (c, t, n) in D.PHRASES.items() for x in (F.lit(p), F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("canonical"), F.lit(t).alias("type"), F.lit(n).alias("priority")))])
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(longest) + r")\b"), F.lit(1))
    return F.transform(found, lambda p: F.element_at(info, p))


def expand_abbreviations(text: Column) -> Column:
    return reduce(lambda out, pair: F.regexp_replace(out, rf"\b{pair[0]}\b", pair[1]), D.ABBREVIATIONS.items(), F.lower(text))


def trigrams(name: Column) -> Column:
    """Distinct three-letter pieces of the words of a name, each word padded by two spaces and one."""
    pieces = F.transform(tokens(name), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Shared three-letter pieces over all of them."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def year_of(date: Column) -> Column:
    """The year of YYYY, D/M/YYYY or YYYY-M-D (also with dots or other signs between); else null."""
    trimmed = F.trim(date)
    forms = (r"^(\d{4})$", r"^\d{1,2}[/.-]\d{1,2}[/.-](\d{4})$", r"^(\d{4})[/.-]\d{1,2}[/.-]\d{1,2}$")
    return F.coalesce(*[F.nullif(F.regexp_extract(trimmed, f, 1), F.lit("")) for f in forms]).cast("int")


def resolved(name: Column, aliases: Mapping[str, str]) -> Column:
    """The canonical name of a shorthand in any case; what is not known is only trimmed."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(name))), F.trim(name))
