"""Registered queries: predicates, filters, set operations and search (groups P, F, B, J1, K1, K10, R, A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions import text as X
from lexcorpus.operators import evidence, rank, search
from lexcorpus.operators.search import act_contains, array_contains_like, at_least, field_contains, name_has, near, phrase, prefix, same_paragraph, same_sentence, term, wildcard, within, year_is
from lexcorpus.plans.fixtures import Fixtures, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = lambda spark, folder: make(Fixtures(spark, folder))
        if sql is not None:
            SQL[name] = oracle(sql)
        return make

    return add


def _found(query, lists: bool = False):
    return lambda f: search.search(query, f.cases_with_lists if lists else f.cases, f.paras, f.acts).select("case_id")


_BY_PARA = "SELECT DISTINCT case_id FROM paras WHERE {}"
_TERM = "list_contains(string_split_regex(lower(text), '[^\\pL\\pM\\pN_]+'), '{}')"
_LEAVES = {
    "p1_term": (term("the of"), f"{_TERM.format('the')} AND {_TERM.format('of')}"),
    "p2_phrase": (phrase("of the"), r"regexp_matches(text, '(^|[^\pL\pM\pN_])of[^\pL\pM\pN_]+the($|[^\pL\pM\pN_])', 'i')"),
    "p3_prefix": (prefix("thea*"), r"regexp_matches(text, '(^|[^\pL\pM\pN_])thea', 'i')"),
    "p4_wildcard": (wildcard("th?n"), r"regexp_matches(text, '(^|[^\pL\pM\pN_])th[\pL\pM\pN_]n($|[^\pL\pM\pN_])', 'i')"),
    "p5_at_least": (at_least(3, "the"), r"len(list_filter(string_split_regex(lower(text), '[^\pL\pM\pN_]+'), lambda w: w = 'the')) >= 3"),
    "p9_same_paragraph": (same_paragraph(term("the"), term("with")), f"{_TERM.format('the')} AND {_TERM.format('with')}"),
}
_LEAVES["p9_compound_operands"] = (
    same_paragraph(term("the") & ~term("with"), phrase("of the") | prefix("thea*")),
    f"{_TERM.format('the')} AND NOT {_TERM.format('with')} AND (" + _LEAVES["p2_phrase"][1] + " OR " + _LEAVES["p3_prefix"][1] + ")",
)
_LEAVES["p1_accented_term"] = (term("NOCH Größe") | term("für") | phrase("É de"), f"{_TERM.format('für')} OR ({_TERM.format('noch')} AND {_TERM.format('größe')}) OR regexp_matches(text, '(^|[^\\pL\\pM\\pN_])é[^\\pL\\pM\\pN_]+de($|[^\\pL\\pM\\pN_])', 'i')")
for _name, (_query, _where) in _LEAVES.items():
    register(_name, _BY_PARA.format(_where))(_found(_query))

_A, _B = "the", "of"
_CLOSE = "SELECT case_id FROM paras GROUP BY case_id HAVING bool_or({}) AND bool_or(" + _TERM.format("the") + ") AND bool_or(" + _TERM.format("of") + ")"


def _within(a: str, b: str, n: int) -> str:
    return rf"regexp_matches(text, '(^|[^\pL\pM\pN_]){a}(?:\s+\S+){{0,{n - 1}}}\s+{b}($|[^\pL\pM\pN_])', 'i')"


register("p6_within", _CLOSE.format(_within(_A, _B, 5)))(_found(within(term("the"), term("of"), 5)))
register("p7_near", _CLOSE.format(f"{_within(_A, _B, 3)} OR {_within(_B, _A, 3)}"))(_found(near(term("the"), term("of"), 3)))
register("p8_same_sentence", _CLOSE.format(f"{_within(_A, _B, 30)} OR {_within(_B, _A, 30)}"))(_found(same_sentence(term("the"), term("of"))))
register("p10_operand_patterns", r"SELECT case_id FROM paras GROUP BY case_id HAVING bool_or(regexp_matches(text, '(^|[^\pL\pM\pN_])th\S*(?:\s+\S+){0,1}\s+of\s+the', 'i')) AND bool_or(regexp_matches(text, '(^|[^\pL\pM\pN_])th', 'i')) AND bool_or(regexp_matches(text, '(^|[^\pL\pM\pN_])of[^\pL\pM\pN_]+the($|[^\pL\pM\pN_])', 'i'))")(_found(within(prefix("th*"), phrase("of the"), 2)))

_TERMS = ("the", "of", "and", "that", "with", "thatin", "rewh")
_MANY = "SELECT * FROM (VALUES " + ", ".join(f"({i}, ['{a}', '{b}', '{c}'])" for i, (a, b, c) in enumerate(zip(_TERMS, _TERMS[1:] + _TERMS[:1], _TERMS[3:] + _TERMS[:3], strict=True))) + ") q(query_id, terms)"
_MET = f"""q AS ({_MANY}), t AS (SELECT query_id, len(terms) AS k, unnest(terms) AS token FROM q),
h AS (SELECT DISTINCT case_id, unnest(string_split_regex(lower(text), '[^\\pL\\pM\\pN_]+')) AS token FROM paras)
SELECT query_id, case_id, count(*) AS met FROM h JOIN t USING (token) GROUP BY query_id, case_id, k HAVING count(*) >= """


def many(f: Fixtures) -> DataFrame:
    rows = [(i, [a, b, c]) for i, (a, b, c) in enumerate(zip(_TERMS, _TERMS[1:] + _TERMS[:1], _TERMS[3:] + _TERMS[:3], strict=True))]
    return f.spark.createDataFrame(rows, "query_id int, terms array<string>")


register("p11_search_many", _MET + "k")(lambda f: search.search_many(many(f), f.paras))
register("p13_minimum_match", _MET + "greatest(1, floor(k * 0.6))")(lambda f: search.search_many(many(f), f.paras, 0.6))


@register(
    "p12_fuzzy_term",
    """v AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\pL\\pM\\pN_]+')) AS token FROM paras),
q AS (SELECT * FROM (VALUES (1, 'thatin'), (2, 'rewh'), (3, 'of')) x(query_id, term))
SELECT query_id, term, token, CAST(levenshtein(term, token) AS INT) AS edits FROM q, v
WHERE token <> '' AND levenshtein(term, token) <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END""",
)
def fuzzy(f: Fixtures) -> DataFrame:
    asked = f.spark.createDataFrame([(1, "thatin"), (2, "rewh"), (3, "of")], "query_id int, term string")
    return search.fuzzy_terms(asked, X.token_table(f.paras).select("token").distinct())


register("f1_field_contains", "SELECT case_id FROM cases WHERE contains(lower(court), 'src1') AND case_id IN (SELECT case_id FROM acts WHERE contains(lower(act_name), 'urgent')) AND case_id IN (SELECT case_id FROM acts WHERE contains(section, '49'))")(_found(field_contains("court", "SRC1") & act_contains("act_name", "urgent") & act_contains("section", "49")))
register("f2_array_contains", "SELECT case_id FROM cases WHERE contains(outcome, 'en') OR contains(court, 'en')")(_found(array_contains_like("subject_tags", "EN"), lists=True))
register("f3_year", "SELECT case_id FROM cases WHERE year = 1984")(_found(year_is(1984)))
register("f4_name_field", f"SELECT case_id FROM cases WHERE {_TERM.format('the').replace('text', 'case_name')}")(_found(name_has("case_name", "the")))
register("f5_metadata", "SELECT case_id, year FROM cases WHERE contains(lower(court), 'src') AND court_type = 'HC' AND year BETWEEN 1960 AND 2000 AND contains(lower(outcome), 'en')")(lambda f: search.filter_metadata(f.cases, "src", "HC", 1960, 2000, "EN").select("case_id", "year"))
register("f6_existence", "SELECT case_id FROM cases WHERE case_id IN (SELECT case_id FROM acts WHERE contains(lower(act_name), 'high')) AND case_id IN (SELECT case_id FROM acts WHERE contains(section, '12'))")(lambda f: search.with_act(search.with_act(f.cases, f.acts, "act_name", "HIGH"), f.acts, "section", "12").select("case_id"))
register("f7_lenient", "SELECT case_id, year FROM cases WHERE contains(lower(court), 'src2') AND (year IS NULL OR year BETWEEN 1990 AND 2010) AND case_id IN (SELECT case_id FROM acts WHERE contains(lower(act_name), 'urgent'))")(lambda f: search.filter_hits(f.cases_with_lists, "src2", 1990, 2010, ["urgent"]).select("case_id", "year"))
register("f8_exact_field", "SELECT case_id, authority_score FROM cases WHERE lower(petitioner) = 'party7' OR lower(respondent) = 'party7'")(lambda f: search.by_field(f.cases, "party", "Party7").select("case_id", "authority_score"))
register("f9_quality_gate", "SELECT paragraph_id FROM paras WHERE coalesce(quality_score, 0.5) > 0.4 AND length(text) > 80")(lambda f: evidence.quality_gate(f.paras, 0.4).select("paragraph_id"))


@register(
    "f10_act_overlap",
    """i AS (SELECT * FROM (VALUES (1, ['1-URGENT'], 'unused'), (2, ['no act'], 'and thatin rewhnd thereaou')) x(issue_id, acts_of, query)),
a AS (SELECT DISTINCT case_id, act_name FROM acts),
m AS (SELECT DISTINCT issue_id, c.case_id, c.year, 'act' AS "by" FROM (SELECT issue_id, unnest(acts_of) AS act_name FROM i) o JOIN a USING (act_name) JOIN cases c USING (case_id)),
w AS (SELECT issue_id, unnest(list_filter(string_split(query, ' '), lambda x: length(x) > 4)[1:4]) AS word FROM i WHERE issue_id NOT IN (SELECT issue_id FROM m)),
b AS (SELECT DISTINCT issue_id, case_id, year, 'word' AS "by" FROM w JOIN cases ON contains(lower(case_name || ' ' || judgment), word)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY year DESC NULLS LAST, case_id) AS INT) AS rank FROM (SELECT * FROM m UNION ALL SELECT * FROM b))
SELECT * FROM r WHERE rank <= 4""",
)
def act_overlap(f: Fixtures) -> DataFrame:
    issues = f.spark.createDataFrame([(1, ["1-URGENT"], "unused"), (2, ["no act"], "and thatin rewhnd thereaou")], "issue_id int, acts array<string>, query string")
    return search.cases_for_issues(issues, f.cases_with_lists)


register("f11_within_results", f"SELECT case_id FROM cases WHERE year > 1990 AND case_id IN ({_BY_PARA.format(_TERM.format('rewh'))})")(lambda f: search.within_results(f.cases.where("year > 1990"), search.search(term("rewh"), f.cases, f.paras)).select("case_id"))

_THE, _WITH = _BY_PARA.format(_TERM.format("thatin")), _BY_PARA.format(_TERM.format("with"))
_sets = lambda f: (search.search(term("thatin"), f.cases, f.paras), search.search(term("with"), f.cases, f.paras))
register("b1_and", f"SELECT case_id FROM ({_THE} INTERSECT {_WITH})")(lambda f: search.and_(*_sets(f)))
register("b2_or", f"SELECT case_id FROM ({_THE} UNION {_WITH})")(lambda f: search.or_(*_sets(f)))
register("b3_not", f"SELECT case_id FROM cases WHERE case_id NOT IN ({_WITH})")(lambda f: search.not_(_sets(f)[1], f.cases))
_COMPOSED = (phrase("of the") & term("and") | prefix("rewh*")) & ~field_contains("court", "src3") & ~term("thatin")
_COMPOSED_SQL = rf"""x AS (SELECT case_id, bool_or(regexp_matches(text, '(^|[^\pL\pM\pN_])of[^\pL\pM\pN_]+the($|[^\pL\pM\pN_])', 'i')) AS a, bool_or({_TERM.format("and")}) AS b,
bool_or(regexp_matches(text, '(^|[^\pL\pM\pN_])rewh', 'i')) AS c, bool_or({_TERM.format("thatin")}) AS d,
count_if(regexp_matches(text, '(^|[^\pL\pM\pN_])of[^\pL\pM\pN_]+the($|[^\pL\pM\pN_])', 'i') OR {_TERM.format("and")} OR regexp_matches(text, '(^|[^\pL\pM\pN_])rewh', 'i') OR {_TERM.format("thatin")}) AS matched, count(*) AS total FROM paras GROUP BY case_id)
SELECT case_id, CAST(matched AS BIGINT) AS matched, total FROM x JOIN cases USING (case_id) WHERE (a AND b OR c) AND NOT contains(court, 'src3') AND NOT d"""
register("b4_composition", _COMPOSED_SQL)(lambda f: search.search(_COMPOSED, f.cases, f.paras))
register("a3_matched_paragraphs", _COMPOSED_SQL)(lambda f: search.search(_COMPOSED, f.cases, f.paras))


@register("b5_search_terms", f"SELECT lower(term) AS term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\\pL\\pM\\pN_]+')) AS term FROM paras) WHERE term IN ('of', 'the', 'and', 'rewh') GROUP BY 1")
def search_terms(f: Fixtures) -> DataFrame:
    wanted = [t for t in _COMPOSED.search_terms() if " " not in t]
    return X.token_table(f.paras).where(F.col("token").isin(wanted)).groupBy(F.col("token").alias("term")).agg(F.count("*").alias("n"))


_RELEVANCE = """round(100 * greatest(0, least(1, 0.30 * CASE WHEN authority_score IS NULL THEN 0.3 ELSE greatest(0, least(1, authority_score)) END
+ 0.20 * least(1, ln(1 + citation_count) / ln(10001)) + 0.15 * least(1, ln(1 + cited_by_count) / ln(10001))
+ 0.15 * least(1, 5.0 * matched / total_paragraphs) + 0.10 * CASE WHEN year IS NULL THEN 0.5 ELSE (greatest(1950, least(2025, year)) - 1950) / 75.0 END
+ 0.10 * CASE court_type WHEN 'SC' THEN 1.0 WHEN 'HC' THEN 0.7 WHEN 'Tribunal' THEN 0.4 WHEN 'District' THEN 0.2 ELSE 0.3 END)), 1)"""
_ASSEMBLED = _COMPOSED_SQL.replace("SELECT case_id, CAST(matched", "m AS (SELECT case_id, CAST(matched").rstrip().replace("FROM paras GROUP BY case_id)\nm AS", "FROM paras GROUP BY case_id),\nm AS") + f"""),
l AS (SELECT case_id, string_agg(DISTINCT act_name, ' | ' ORDER BY act_name) AS act_names, string_agg(DISTINCT section, ', ' ORDER BY section) AS sections FROM acts GROUP BY case_id),
n AS (SELECT cited_case_id AS case_id, count(*) AS cited_by FROM cites GROUP BY 1),
s AS (SELECT case_id, year, cited_by_count, act_names, sections, matched, {_RELEVANCE} AS relevance_score FROM
  (SELECT m.case_id, c.year, coalesce(n.cited_by, 0) AS cited_by_count, act_names, sections, matched, m.total AS total_paragraphs, authority_score, citation_count, court_type
   FROM m JOIN cases c USING (case_id) LEFT JOIN l USING (case_id) LEFT JOIN n USING (case_id)))
"""


def _assembled(f: Fixtures) -> DataFrame:
    found = search.search(_COMPOSED, f.cases, f.paras).withColumnRenamed("total", "total_paragraphs")
    return rank.relevance(search.assemble(found, f.cases, f.acts, f.cites))


register("j1_assembly", _ASSEMBLED + "SELECT case_id, year, cited_by_count, act_names, sections FROM s")(lambda f: _assembled(f).select("case_id", "year", "cited_by_count", "act_names", "sections"))
register("r1_relevance", _ASSEMBLED + "SELECT case_id, relevance_score FROM s")(lambda f: _assembled(f).select("case_id", "relevance_score"))
register("r4_sort_modes", _ASSEMBLED + "SELECT case_id, year FROM s ORDER BY year DESC NULLS LAST, case_id LIMIT 40")(lambda f: _assembled(f).orderBy(*rank.order("date_desc")).limit(40).select("case_id", "year"))
for _mode, _keys in (("date_asc", "year ASC NULLS LAST"), ("citations", "cited_by_count DESC NULLS LAST"), ("relevance", "relevance_score DESC NULLS LAST")):
    register(f"r4_{_mode}", _ASSEMBLED + f"SELECT case_id, year, cited_by_count FROM s ORDER BY {_keys}, case_id LIMIT 40")(
        lambda f, mode=_mode: _assembled(f).orderBy(*rank.order(mode)).limit(40).select("case_id", "year", "cited_by_count")
    )
register("k10_page", _ASSEMBLED + "SELECT case_id, relevance_score, (SELECT count(*) FROM s) AS total_rows, CAST(ceil((SELECT count(*) FROM s) / 10.0) AS BIGINT) AS total_pages FROM s ORDER BY relevance_score DESC, case_id LIMIT 10 OFFSET 10")(lambda f: search.page(_assembled(f).select("case_id", "relevance_score"), rank.order("relevance"), 2, 10))
register("boolean_search", _ASSEMBLED + "SELECT case_id, year, matched, cited_by_count, relevance_score FROM s ORDER BY relevance_score DESC, case_id LIMIT 25")(lambda f: _assembled(f).orderBy(*rank.order("relevance")).limit(25).select("case_id", "year", "matched", "cited_by_count", "relevance_score"))


@register(
    "k1_snippets",
    """h AS (SELECT case_id, para_no, len(regexp_extract_all(lower(text), 'rewh')) + len(regexp_extract_all(lower(text), 'thatin')) AS hits, substring(text, 1, 60) AS head FROM paras),
u AS (SELECT *, row_number() OVER (PARTITION BY case_id, head ORDER BY hits DESC, para_no) AS same FROM h WHERE hits > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, para_no) AS rank FROM u WHERE same = 1)
SELECT case_id, CAST(rank AS INT) AS rank, para_no, CAST(hits AS INT) AS hits FROM r WHERE rank <= 3""",
)
def snippets(f: Fixtures) -> DataFrame:
    return evidence.snippets(f.paras, f.cases, ["rewh", "thatin"]).select("case_id", F.inline("fragments")).select("case_id", "rank", "para_no", "hits")


_HITS = """h AS (SELECT case_id, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN 'case' ELSE 'paragraph' END AS result_type, year,
CASE WHEN CAST(case_id AS BIGINT) % 7 = 0 THEN NULL ELSE authority_score END AS relevance_score, case_name FROM cases)
"""


def _hits(f: Fixtures) -> DataFrame:
    n = F.col("case_id").cast("bigint")
    return f.cases.select("case_id", F.when(n % 3 == 0, "case").otherwise("paragraph").alias("result_type"), "year", F.when(n % 7 != 0, F.col("authority_score")).alias("relevance_score"), "case_name")


register("r2_rerank", _HITS + """, d AS (SELECT source_case_id AS case_id, least(count(*), 10) AS degree FROM cites GROUP BY 1)
SELECT case_id, round(0.6 * coalesce(relevance_score, 0.5) + 0.2 * CASE WHEN result_type = 'case' THEN coalesce(degree, 0) / 10.0 ELSE 0 END
 + 0.2 * coalesce(CASE WHEN year IS NOT NULL THEN least(1, greatest(0, (year - 2010) / 20.0)) END, 0), 6) AS rerank_score FROM h LEFT JOIN d USING (case_id)""")(lambda f: rank.rerank(_hits(f), f.cites).select("case_id", F.round("rerank_score", 6).alias("rerank_score")))
register("r3_name_boost", """SELECT case_id, CASE WHEN n >= 2 THEN n ELSE 0 END AS boost FROM (SELECT case_id, CAST(contains(lower(case_name), 'the') AS INT) + CAST(contains(lower(case_name), 'ing') AS INT) + CAST(contains(lower(case_name), 'and') AS INT) AS n FROM cases)""")(lambda f: f.cases.select("case_id", rank.name_hits(F.col("case_name"), F.lit("the ing of and the")).alias("boost")))
_KINDS = "CASE match_type WHEN 'view' THEN 'exact_phrase' WHEN 'click' THEN 'abbreviation' WHEN 'purchase' THEN 'section_match' ELSE 'other' END"
register("r5_match_score", f"SELECT query_id, round(CASE {_KINDS} WHEN 'exact_phrase' THEN 100 WHEN 'abbreviation' THEN 95 WHEN 'section_match' THEN 80 ELSE 50 END * (results_count % 10) / 10.0, 6) AS rank_score FROM query_log")(lambda f: f.log.select("query_id", F.round(rank.match_score(F.expr(_KINDS), (F.col("results_count") % 10) / 10.0), 6).alias("rank_score")))
register("r6_type_first", "SELECT paragraph_id, CASE WHEN para_type IN ('order', 'issues') THEN 0 ELSE 1 END AS place FROM paras")(lambda f: f.paras.select("paragraph_id", rank.type_first(F.col("para_type"), ["order", "issue"]).alias("place")))
