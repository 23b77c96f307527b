"""Boolean search over paragraphs, combined at case level.

A query is built from leaves with &, | and ~. All paragraph leaves become columns of one scan of
the paragraphs; one group-by on the case folds them, and the query is evaluated on its rows. AND,
OR and NOT work on cases, proximity and same-paragraph within one paragraph.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexcorpus.functions import stem
from lexcorpus.functions.text import BEGIN, END, GAP, LETTER, escaped, tokens, words_of
from lexcorpus.operators.similarity import within_edits

#: Distinct query terms up to which they are broadcast.
SMALL = 100_000


@dataclass(frozen=True)
class Query:
    """A node: `op` over `parts`, or a leaf on a paragraph's text, a case's row, or its acts."""

    op: str
    parts: tuple[Query, ...] = ()
    test: object = None  # of a paragraph's text and words, or of a case's row; made when the query is compiled
    terms: tuple[str, ...] = field(default=())
    pattern: str = ""
    words: tuple[str, ...] = ()  # every match of the pattern holds these words

    def __and__(self, other: Query) -> Query:
        return Query("and", (self, other), terms=self.terms + other.terms, pattern=self.pattern, words=self.words)

    def __or__(self, other: Query) -> Query:
        return Query("or", (self, other), terms=self.terms + other.terms, pattern=self.pattern, words=self.words)

    def __invert__(self) -> Query:
        return Query("not", (self,))  # what is excluded is no search term

    def search_terms(self) -> list[str]:
        """Distinct terms in order; a phrase adds its words."""
        return list(dict.fromkeys(self.terms))


def _text(test, terms: Sequence[str], pattern: str, words: Sequence[str] = ()) -> Query:
    return Query("text", test=test, terms=tuple(terms), pattern=pattern, words=tuple(words))


def _matches(pattern: str):
    return lambda text, words: F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def _has(found: Column, each: Sequence[str]) -> Column:
    out = F.lit(True)
    for w in each:
        out = out & F.coalesce(F.array_contains(found, w), F.lit(False))
    return out


def _asked(words: str) -> list[str]:
    """The words of an operand; one without any is refused, as it would find everything."""
    each = words_of(words)
    if not each:
        raise ValueError(f"no word to look for in {words!r}")
    return each


def _whole(pattern: str) -> str:
    return BEGIN + pattern + END


def _english(words: str, vocabulary: DataFrame) -> list[tuple[str, ...]]:
    """For each word the forms that share its stem, none for a stop word; an operand of stop words alone is refused."""
    each = stem.forms(vocabulary, _asked(words))
    if not any(each):
        raise ValueError(f"only stop words in {words!r}")
    return each


def term(words: str, vocabulary: DataFrame | None = None) -> Query:
    """Every word of `words` in one paragraph.

    With a vocabulary (token, stem) of the corpus the words are analysed as English: stop words are
    left out, and each other word stands for all tokens with its stem.
    """
    plain = words.lower().split()
    pattern = r"\s+".join(_whole(escaped(w)) for w in plain)
    each = _asked(words)
    if vocabulary is None:
        return _text(lambda text, found: _has(found, each), plain, pattern, each)
    forms = [f for f in _english(words, vocabulary) if f]

    def test(text: Column, found: Column) -> Column:
        out = F.lit(True)
        for some in forms:
            out = out & F.coalesce(F.arrays_overlap(found, F.array(*map(F.lit, some))), F.lit(False))
        return out

    return _text(test, plain, pattern, each)


def phrase(words: str, vocabulary: DataFrame | None = None) -> Query:
    """Words one behind the other; with a vocabulary (token, stem) as English, where any word may stand for a stop word."""
    each = _asked(words)
    plain = words.lower().split()
    if vocabulary is not None:
        forms = _english(words, vocabulary)
        first = next(i for i, f in enumerate(forms) if f)
        forms = forms[first : len(forms) - next(i for i, f in enumerate(reversed(forms)) if f)]
        each = ["(?:" + "|".join(map(escaped, f)) + ")" if f else f"{LETTER}+" for f in forms]
    else:
        each = [escaped(w) for w in each]
    return _text(_matches(_whole(GAP.join(each))), [words.lower(), *plain], r"\s+".join(escaped(w) for w in plain))


def prefix(root: str) -> Query:
    root = root.rstrip("*!").lower()
    _asked(root)
    return _text(_matches(BEGIN + escaped(root)), [root], rf"{BEGIN}{escaped(root)}\S*")


def wildcard(word: str) -> Query:
    """Each ? stands for exactly one letter of a whole word."""
    _asked(word)
    inner = _whole(LETTER.join(escaped(p) for p in word.lower().split("?")))
    return _text(_matches(inner), [word.lower()], inner)


def at_least(n: int, word: str) -> Query:
    if not 1 <= n <= 50:
        raise ValueError("n must be from 1 to 50")
    _asked(word)
    pattern = _whole(escaped(word.lower()))
    return _text(lambda text, words: F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)) >= n, F.lit(False)), [word.lower()], pattern)


def _near(left: Query, right: Query, n: int, both_ways: bool) -> Query:
    if not 1 <= n <= 100:
        raise ValueError("n must be from 1 to 100")
    ways = [(left, right), (right, left)] if both_ways else [(left, right)]
    patterns = [rf"{a.pattern}(?:\s+\S+){{0,{n - 1}}}\s+{b.pattern}" for a, b in ways]

    def test(text: Column, words: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | _matches(p)(text, words)
        return _has(words, left.words + right.words) & out  # the pattern runs only where the words are

    close = Query("text", test=test)
    return Query("and", (close, Query("and", (left, right))), terms=left.terms + right.terms, pattern=left.pattern)


def within(left: Query, right: Query, n: int = 5) -> Query:
    """Left, then right, with at most n - 1 words between them."""
    return _near(left, right, n, False)


def near(left: Query, right: Query, n: int = 5) -> Query:
    return _near(left, right, n, True)


def same_sentence(left: Query, right: Query) -> Query:
    return _near(left, right, 30, True)


def _in_paragraph(query: Query):
    """The test of a query on one paragraph, compound queries included."""
    if query.op == "text":
        return query.test
    parts = [_in_paragraph(p) for p in query.parts]
    if query.op == "and":
        return lambda text, words: parts[0](text, words) & parts[1](text, words)
    if query.op == "or":
        return lambda text, words: parts[0](text, words) | parts[1](text, words)
    if query.op == "not":
        return lambda text, words: ~parts[0](text, words)
    raise ValueError("fields of a case have no place within a paragraph")


def same_paragraph(left: Query, right: Query) -> Query:
    """Both operands, which may be compound, within one paragraph."""
    a, b = _in_paragraph(left), _in_paragraph(right)
    return Query("text", test=lambda text, words: a(text, words) & b(text, words), terms=left.terms + right.terms, pattern=left.pattern)


def _value(value: str) -> str:
    if not value.strip():
        raise ValueError("a field needs a value to look for")
    return value.lower()


def field_contains(column: str, value: str) -> Query:
    value = _value(value)
    return Query("case", test=lambda: F.coalesce(F.contains(F.lower(F.col(column)), F.lit(value)), F.lit(False)))


def array_contains_like(column: str, value: str) -> Query:
    value = _value(value)
    return Query("case", test=lambda: F.coalesce(F.exists(column, lambda x: F.contains(F.lower(x), F.lit(value.lower()))), F.lit(False)))


def year_is(year: int) -> Query:
    return Query("case", test=lambda: F.coalesce(F.col("year") == int(year), F.lit(False)))


def name_has(column: str, words: str) -> Query:
    each = _asked(words)
    return Query("case", test=lambda: _has(tokens(F.col(column)), each))


def act_contains(column: str, value: str) -> Query:
    """`column` of some row of the case's acts holds the value."""
    value = _value(value)
    return Query("act", test=lambda: F.coalesce(F.contains(F.lower(F.col(column)), F.lit(value)), F.lit(False)))


def search(query: Query, cases: DataFrame, paras: DataFrame, acts: DataFrame | None = None) -> DataFrame:
    """case_id, matched (paragraphs in which some text leaf holds) and total of the cases found."""
    leaves: dict[str, list[Query]] = {"text": [], "case": [], "act": []}

    def walk(q: Query) -> None:
        if q.op in leaves:
            leaves[q.op].append(q)
        for p in q.parts:
            walk(p)

    def holds(q: Query) -> Column:
        if q.op in leaves:
            k = next(i for i, x in enumerate(leaves[q.op]) if x is q)
            return F.coalesce(F.col(f"__{q.op}{k}"), F.lit(False))
        if q.op == "not":
            return ~holds(q.parts[0])
        a, b = map(holds, q.parts)
        return (a & b) if q.op == "and" else (a | b)

    walk(query)
    found = cases.select("case_id", *[q.test().alias(f"__case{i}") for i, q in enumerate(leaves["case"])])
    tests = [q.test(F.col("text"), F.col("__words")).alias(f"__text{i}") for i, q in enumerate(leaves["text"])]
    marked = paras.select("case_id", "text", tokens(F.col("text")).alias("__words")).select("case_id", *tests)  # words are cut once for all leaves
    any_ = F.lit(False)
    for i in range(len(tests)):
        any_ = any_ | F.col(f"__text{i}")
    folded = marked.groupBy("case_id").agg(F.sum(any_.cast("long")).alias("matched"), F.count("*").alias("total"), *[F.bool_or(f"__text{i}").alias(f"__text{i}") for i in range(len(tests))])
    found = found.join(folded, "case_id", "left")
    if leaves["act"]:
        if acts is None:
            raise ValueError("the query asks for acts")
        found = found.join(acts.groupBy("case_id").agg(*[F.bool_or(q.test()).alias(f"__act{i}") for i, q in enumerate(leaves["act"])]), "case_id", "left")
    return found.where(holds(query)).select("case_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("total", F.lit(0)).alias("total"))


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("case_id").intersect(b.select("case_id"))


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("case_id").union(b.select("case_id")).distinct()


def not_(a: DataFrame, cases: DataFrame) -> DataFrame:
    return cases.select("case_id").join(a.select("case_id"), "case_id", "left_anti")


def filter_metadata(cases: DataFrame, court: str | None = None, court_type: str | None = None, year_from: int | None = None, year_to: int | None = None, outcome: str | None = None) -> DataFrame:
    """Strict filters: what is null fails."""
    if court is not None:
        cases = cases.where(F.contains(F.lower("court"), F.lit(court.lower())))
    if court_type is not None:
        cases = cases.where(F.col("court_type") == court_type)
    if year_from is not None:
        cases = cases.where(F.col("year") >= year_from)
    if year_to is not None:
        cases = cases.where(F.col("year") <= year_to)
    if outcome is not None:
        cases = cases.where(F.contains(F.lower("outcome"), F.lit(outcome.lower())))
    return cases


def with_act(cases: DataFrame, acts: DataFrame, column: str, value: str) -> DataFrame:
    """Cases that have an act row whose `column` holds the value."""
    return cases.join(acts.where(F.contains(F.lower(column), F.lit(value.lower()))).select("case_id"), "case_id", "left_semi")


def filter_hits(hits: DataFrame, court: str | None = None, year_from: int | None = None, year_to: int | None = None, acts: Sequence[str] = (), court_code: str | None = None) -> DataFrame:
    """Lenient filters: a null year passes; any of `acts` in the acts referred to is enough."""
    if court_code is not None:
        hits = hits.where(F.col("court_code") == court_code)
    if court is not None:
        hits = hits.where(F.contains(F.lower("court"), F.lit(court.lower())))
    if year_from is not None:
        hits = hits.where(F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to is not None:
        hits = hits.where(F.col("year").isNull() | (F.col("year") <= year_to))
    if acts:
        held = F.lower(F.concat_ws(" ", "acts_referred"))
        some = F.lit(False)
        for a in acts:
            some = some | F.contains(held, F.lit(a.lower()))
        hits = hits.where(some)
    return hits


def by_field(cases: DataFrame, kind: str, value: str) -> DataFrame:
    """Exact-field search, the highest authority first."""
    low = F.lit(value.lower())
    referred = [c for c in ("acts_referred", "constitutional_articles") if c in cases.columns]
    tests = {
        "court": F.col("court") == value,
        "case_id": (F.col("case_id") == value) | F.startswith("case_id", F.lit(value)),
        "year": F.col("year") == F.lit(value).cast("int"),
        "outcome": F.lower("outcome") == low,
        "party": F.coalesce(F.lower("petitioner") == low, F.lit(False)) | F.coalesce(F.lower("respondent") == low, F.lit(False)) if kind == "party" else F.lit(False),
        "section": F.contains(F.lower(F.concat_ws(" ", *referred)), low) if kind == "section" else F.lit(False),
    }
    return cases.where(tests[kind]).orderBy(F.coalesce("authority_score", F.lit(0.0)).desc(), "case_id")


def within_results(hits: DataFrame, among: DataFrame) -> DataFrame:
    return hits.join(among.select("case_id"), "case_id", "left_semi")


def cases_for_issues(issues: DataFrame, cases: DataFrame, n: int = 4) -> DataFrame:
    """issues (issue_id, acts, query): the newest cases that share an act, or else hold a long query word.

    A query word holds no white space and five letters at least, so a case that holds it has it
    within one of its strings between white space; these meet it by its first five letters.
    """
    own = issues.select("issue_id", F.explode("acts").alias("act"))
    acts = cases.select("case_id", "year", F.explode("acts_referred").alias("act"))
    by_act = own.join(acts, "act").select("issue_id", "case_id", "year").distinct().withColumn("by", F.lit("act"))
    rest = issues.join(by_act.select("issue_id").distinct(), "issue_id", "left_anti")
    words = rest.select("issue_id", F.explode(F.slice(F.filter(F.split("query", r"\s+"), lambda w: F.length(w) > 4), 1, 4)).alias("word"))
    words = words.select("issue_id", F.lower("word").alias("word")).distinct().withColumn("head", F.substring("word", 1, 5))
    strings = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "case_name", "judgment")), r"\s+"))
    held = cases.select("case_id", "year", F.explode(strings).alias("string")).where(F.length("string") >= 5)
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("string") - 4), lambda i: F.substring(F.col("string"), i, F.lit(5))))
    vocabulary = held.select("string").distinct().select("string", F.explode(heads).alias("head"))
    known = vocabulary.join(words, "head").where(F.contains("string", F.col("word"))).select("issue_id", "string").distinct()
    by_word = held.join(known, "string").select("issue_id", "case_id", "year").distinct().withColumn("by", F.lit("word"))
    newest = Window.partitionBy("issue_id").orderBy(F.desc_nulls_last("year"), "case_id")
    return by_act.union(by_word).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def assemble(matched: DataFrame, cases: DataFrame, acts: DataFrame, cites: DataFrame) -> DataFrame:
    """Matched cases with their rows, act and section lists and cited-by counts (0 where nothing cites)."""
    ids = matched.select("case_id")
    lists = acts.join(ids, "case_id", "left_semi").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("act_name")), " | ").alias("act_names"), F.array_join(F.array_sort(F.collect_set("section")), ", ").alias("sections"))
    cited = cites.select(F.col("cited_case_id").alias("case_id")).join(ids, "case_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("cited_by_count"))
    return matched.join(cases, "case_id").join(lists, "case_id", "left").join(cited, "case_id", "left").withColumn("cited_by_count", F.coalesce("cited_by_count", F.lit(0)))


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) with the number of rows and pages; the order must end in a unique key."""
    total = rows.agg(F.count("*").alias("total_rows")).withColumn("total_pages", F.ceil(F.col("total_rows") / size).cast("long"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))


def search_many(queries: DataFrame, paras: DataFrame, share: float = 1.0) -> DataFrame:
    """queries (query_id, terms): cases that hold at least that share of a query's terms, one at least.

    Words and terms meet in an equi-join; distinct words of a paragraph are formed first. Up to
    `SMALL` distinct terms are broadcast, so that only words asked for are shuffled; more of them
    meet the words in a shuffle.
    """
    wanted = queries.select("query_id", F.array_distinct(F.transform("terms", F.lower)).alias("terms")).withColumn("k", F.size("terms"))
    terms = wanted.select("query_id", "k", F.explode("terms").alias("token"))
    held = paras.select("case_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    asked = terms.select("token").distinct()
    asked = F.broadcast(asked) if asked.limit(SMALL + 1).count() <= SMALL else asked
    held = held.join(asked, "token", "left_semi").distinct()
    met = held.join(terms, "token").groupBy("query_id", "case_id").agg(F.count("*").alias("met"), F.first("k").alias("k"))
    return met.where(F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("k") * share + 1e-9))).select("query_id", "case_id", "met")


def fuzzy_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """queries (query_id, term) x vocabulary (token): words within 0, 1 or 2 edits by the term's length."""
    most = F.when(F.length("term") <= 2, 0).when(F.length("term") <= 5, 1).otherwise(2)
    asked = queries.select("query_id", F.lower("term").alias("term")).withColumn("most", most)
    near = within_edits(asked.select(F.col("term").alias("word"), "most"), vocabulary)
    return asked.join(near.withColumnRenamed("word", "term"), ["term", "most"]).select("query_id", "term", "token", "edits")
