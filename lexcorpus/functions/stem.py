"""The Snowball English stemmer ("Porter2") as columns over a vocabulary, and the English stop words.

The rules are SQL expressions that Spark and the oracle both read, one projection after another, so
that each distinct word of a corpus is stemmed once and no Python runs. A step finds the longest of
its suffixes and then asks whether it lies in R1 or R2, the parts of a word behind its first and
second vowel with a consonant; both are kept as the number of letters in front of them.

Words are tokens: lower case, without apostrophes, so the rule for 's has nothing to do. Words of
one or two letters, with a digit or an underscore stay as they are; null stays null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that the English analysis leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()

#: Words with stems of their own, words that are stems, and words that go no further than the first step.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes of the second to fourth step and what takes their place.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V, _C = "[aeiouy]", "[^aeiouy]"


def _found(pattern: str, word: str = "w") -> str:
    return f"regexp_extract({word}, '({pattern})', 1) <> ''"


def _suffix(suffixes: Sequence[str]) -> str:
    """The longest of some suffixes that the word ends in: a search from the left meets it first."""
    return f"regexp_extract(w, '({'|'.join(suffixes)})$', 1)"


def _listed(words: Sequence[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _behind(pattern: str, word: str) -> str:
    """Letters of `word` up to the end of its first match, all of them without one."""
    return f"CASE WHEN {_found(pattern, word)} THEN length(regexp_extract({word}, '({pattern})', 1)) ELSE length({word}) END"


_CUT = "left(w, length(w) - length(s))"
_IN_R1, _IN_R2 = "length(w) - length(s) >= r1", "length(w) - length(s) >= r2"
_SHORT = f"({_found(f'{_C}{_V}[^aeiouywxY]$', '{0}')} OR {_found(f'^{_V}{_C}$', '{0}')})"


def _replaced(table: Mapping[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " ELSE s END"


#: One step after another: the values that each replaces or adds.
_FIRST = f"^{_C}*{_V}+{_C}"
_STEPS: tuple[dict[str, str], ...] = (
    {"r1": f"CASE WHEN {_found('^(gener|commun|arsen)')} THEN length(regexp_extract(w, '^(gener|commun|arsen)', 1)) ELSE {_behind(_FIRST, 'w')} END"},
    {"r2": f"r1 + {_behind(_FIRST, 'substr(w, r1 + 1)')}", "s": _suffix(("sses", "ied", "ies", "us", "ss", "s"))},
    {
        "w": f"CASE WHEN s = 'sses' THEN left(w, length(w) - 2) WHEN s IN ('ied', 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) "
        f"WHEN s = 's' AND {_found(f'{_V}.+s$')} THEN left(w, length(w) - 1) ELSE w END"
    },
    {"done": f"CASE WHEN w IN ({_listed(FINISHED)}) THEN w END", "s": _suffix(("eedly", "eed", "edly", "ed", "ingly", "ing"))},
    {
        "cut": f"s NOT IN ('', 'eed', 'eedly') AND {_found(_V, _CUT)}",
        "w": f"CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN {_IN_R1} THEN {_CUT} || 'ee' ELSE w END WHEN s <> '' AND {_found(_V, _CUT)} THEN {_CUT} ELSE w END",
    },
    {
        "w": f"CASE WHEN NOT cut THEN w WHEN {_found('(at|bl|iz)$')} THEN w || 'e' WHEN {_found('(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN left(w, length(w) - 1) "
        f"WHEN r1 = length(w) AND {_SHORT.format('w')} THEN w || 'e' ELSE w END"
    },
    {"w": f"CASE WHEN {_found(f'^.+{_C}[yY]$')} THEN left(w, length(w) - 1) || 'i' ELSE w END"},
    {"s": _suffix(tuple(STEP_2))},
    {
        "w": f"CASE WHEN s = '' OR NOT {_IN_R1} OR (s = 'ogi' AND NOT {_found('logi$')}) OR (s = 'li' AND NOT {_found('[cdeghkmnrt]li$')}) THEN w ELSE {_CUT} || {_replaced(STEP_2)} END"
    },
    {"s": _suffix(tuple(STEP_3))},
    {"w": f"CASE WHEN s = '' OR NOT {_IN_R1} OR (s = 'ative' AND NOT {_IN_R2}) THEN w ELSE {_CUT} || {_replaced(STEP_3)} END"},
    {"s": _suffix(STEP_4)},
    {"w": f"CASE WHEN s = '' OR NOT {_IN_R2} OR (s = 'ion' AND NOT {_found('[st]ion$')}) THEN w ELSE {_CUT} END"},
    {"s": "left(w, length(w) - 1)"},
    {
        "w": f"CASE WHEN {_found('e$')} AND (length(s) >= r2 OR (length(s) >= r1 AND NOT {_SHORT.format('s')})) THEN s WHEN {_found('ll$')} AND length(s) >= r2 THEN s ELSE w END"
    },
)
_STEM = (
    f"CASE token {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in IRREGULAR.items())} ELSE "
    f"CASE WHEN token IN ({_listed(INVARIANT)}) OR length(token) < 3 OR {_found('[0-9_]', 'token')} THEN token ELSE replace(coalesce(done, w), 'Y', 'y') END END"
)


def stemmed(words: DataFrame) -> DataFrame:
    """words (distinct token and more columns) with the `stem` of each token.

    The last group-by, which moves nothing where the words are grouped by token already, keeps the
    optimiser from copying the rules into each other when a filter on the stem comes from above.
    """
    kept = [c for c in words.columns if c not in ("token", "stem")]
    quoted = [f"`{c}`" for c in kept]
    marked = F.regexp_replace(F.regexp_replace("token", "^y", "Y"), f"({_V})y", "$1Y")
    made, names = words.select("token", *quoted, marked.alias("w")), ["w"]
    for step in _STEPS:
        names = [*names, *(c for c in step if c not in names)]
        made = made.selectExpr("token", *quoted, *[f"{step.get(c, c)} AS {c}" for c in names])
    made = made.selectExpr("token", *quoted, f"{_STEM} AS stem")
    return made.groupBy("token").agg(*[F.first(c).alias(c) for c in kept], F.first("stem").alias("stem"))


def oracle(source: str) -> str:
    """The same for DuckDB: a query that adds `stem` to the tokens that `source` selects."""
    query, names = f"SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM ({source})", ["w"]
    for step in _STEPS:
        names = [*names, *(c for c in step if c not in names)]
        query = f"SELECT token, {', '.join(f'{step.get(c, c)} AS {c}' for c in names)} FROM ({query})"
    return f"SELECT token, {_STEM} AS stem FROM ({query})"


def forms(vocabulary: DataFrame, words: Sequence[str]) -> list[tuple[str, ...]]:
    """For each word the tokens of vocabulary (token, stem) with its stem, and itself; empty for a stop word."""
    spark = vocabulary.sparkSession
    asked = stemmed(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "token string")).withColumnRenamed("token", "word")
    met = vocabulary.select("token", "stem").join(F.broadcast(asked), "stem").groupBy("word").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    known = {r.word: r.tokens for r in met.collect()}
    return [() if w in STOP_WORDS else tuple(dict.fromkeys([w, *known.get(w, [])])) for w in words]
