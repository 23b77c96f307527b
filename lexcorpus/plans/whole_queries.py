"""Registered queries that show what other queries of the same operators leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions import dictionaries as D
from lexcorpus.functions import text as X
from lexcorpus.functions import treatment as T
from lexcorpus.operators import citations, evidence, paging, query_tables, search
from lexcorpus.plans.corpus_queries import _ANY, _CLASSES, _COUNTED, _Q, _RULE, _TREATED, _asked
from lexcorpus.plans.fixtures import Fixtures, oracle
from lexcorpus.plans.search_queries import _ASSEMBLED, _COMPOSED, _assembled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = lambda spark, folder: make(Fixtures(spark, folder))
        if sql is not None:
            SQL[name] = oracle(sql)
        return make

    return add


# F8: every kind of field
_FIELDS = {
    "court": ("src1", "court = 'src1'"),
    "case_id": ("12", "starts_with(case_id, '12')"),
    "year": ("1984", "year = 1984"),
    "outcome": ("EN", "lower(outcome) = 'en'"),
    "section": ("URGENT", "case_id IN (SELECT case_id FROM acts WHERE contains(lower(act_name), 'urgent'))"),
}
for _kind, (_value, _where) in _FIELDS.items():
    register(f"f8_{_kind}", f"SELECT case_id, authority_score FROM cases WHERE {_where}")(
        lambda f, kind=_kind, value=_value: search.by_field(f.cases_with_lists, kind, value).select("case_id", "authority_score")
    )

# All terms of a query with the paragraphs that hold them, the phrase included
_TERMS = _COMPOSED.search_terms()


@register("b5_all_terms", " UNION ALL ".join(f"SELECT {i} AS place, '{t}' AS term, count(*) AS n FROM paras WHERE contains(lower(text), '{t}')" for i, t in enumerate(_TERMS)))
def all_terms(f: Fixtures) -> DataFrame:
    terms = _COMPOSED.search_terms()
    counts = f.paras.agg(*[F.count_if(F.contains(F.lower("text"), F.lit(t))).alias(f"n{i}") for i, t in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("term"), F.col(f"n{i}").alias("n")) for i, t in enumerate(terms)])
    return counts.select(F.inline(rows))


# R1 with its six parts
_LOG = "least(1, ln(1 + {}) / ln(10001))"
_PARTS = f"""round(CASE WHEN authority_score IS NULL THEN 0.3 ELSE greatest(0, least(1, authority_score)) END, 4) AS authority, round({_LOG.format("citation_count")}, 4) AS citation_count,
round({_LOG.format("cited_by_count")}, 4) AS cited_by, round(least(1, 5.0 * matched / total_paragraphs), 4) AS term_density,
round(CASE WHEN year IS NULL THEN 0.5 ELSE (greatest(1950, least(2025, year)) - 1950) / 75.0 END, 4) AS recency,
CAST(CASE court_type WHEN 'SC' THEN 1.0 WHEN 'HC' THEN 0.7 WHEN 'Tribunal' THEN 0.4 WHEN 'District' THEN 0.2 ELSE 0.3 END AS DOUBLE) AS court"""
register("r1_breakdown", _ASSEMBLED.replace("AS relevance_score FROM", f"AS relevance_score, {_PARTS} FROM") + "SELECT case_id, relevance_score, authority, citation_count, cited_by, term_density, recency, court FROM s")(
    lambda f: _assembled(f).select("case_id", "relevance_score", "score_breakdown.*")
)

# J6 with its lists
_LIST = "(SELECT {key} AS case_id, string_agg({what}, '|' ORDER BY k) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {rows}) WHERE k <= {n} GROUP BY 1)"
_LISTS = [
    _LIST.format(key="case_id", what="act_name || '#' || section", name="acts", order="confidence DESC, act_name, section", rows="acts", n=20),
    _LIST.format(key="source_case_id", what="target_citation", name="citations_out", order="confidence DESC, target_citation, created_at", rows="cites", n=20),
    _LIST.format(key="cited_case_id", what="source_case_id", name="citations_in", order="confidence DESC, source_case_id, created_at", rows="(SELECT * FROM cites WHERE cited_case_id IS NOT NULL)", n=20),
    _LIST.format(key="case_id", what="para_no || text", name="paragraphs", order="para_no", rows="paras", n=10),
]


@register("j6_case_lists", "SELECT case_id, acts, citations_out, citations_in, paragraphs FROM cases " + " ".join(f"LEFT JOIN {t} USING (case_id)" for t in _LISTS))
def case_lists(f: Fixtures) -> DataFrame:
    made = citations.case_details(f.cases, f.acts, f.cites, f.paras)
    joined = lambda c, x: F.array_join(F.transform(c, x), "|").alias(c)
    return made.select(
        "case_id",
        joined("acts", lambda a: F.concat_ws("#", a["act_name"], a["section"])),
        joined("citations_out", lambda c: c["target_citation"]),
        joined("citations_in", lambda c: c["source_case_id"]),
        joined("paragraphs", lambda p: F.concat(p["para_no"].cast("string"), p["text"])),
    )


# Act names; K10: a page far behind
_SHORT = "CASE CAST(case_id AS BIGINT) % 3 WHEN 0 THEN ' IPC' WHEN 1 THEN 'CrPC ' ELSE ' Some Act ' END"
register("j9_act_aliases", "SELECT case_id, CASE CAST(case_id AS BIGINT) % 3 WHEN 0 THEN 'Indian Penal Code' WHEN 1 THEN 'Code of Criminal Procedure' ELSE 'Some Act' END AS act FROM cases")(
    lambda f: f.cases.select("case_id", X.resolved(F.expr(_SHORT), D.ACT_ALIASES).alias("act"))
)
register("k10_deep_page", "SELECT paragraph_id, quality_score FROM paras ORDER BY quality_score DESC NULLS LAST, paragraph_id LIMIT 5 OFFSET 1000")(
    lambda f: paging.page_by_key(f.paras.select("paragraph_id", "quality_score"), [("quality_score", True), ("paragraph_id", False)], 201, 5)
)

# The real phrases
register("x3_treatment_phrases", f"j AS (SELECT case_id, lower({_TREATED}) AS near FROM cases) SELECT case_id, {_COUNTED} FROM j")(
    lambda f: f.cases.select("case_id", *[n.cast("long").alias(c) for c, n in T.counts(F.expr(_TREATED)).items()]).select("case_id", *_CLASSES)
)

# With case ids for every third query, and the paragraph types
_TYPES = "CASE " + " ".join(f"WHEN {_ANY(w)} THEN '{','.join(p)}'" for w, _i, p in D.INTENTS) + " END"
register(
    "x17_named_intents",
    _Q
    + f""", t AS (SELECT query_id, lower(trim(query)) AS v, query_id % 3 = 0 AS named FROM q),
u AS (SELECT *, {_ANY(D.TABLE_TRIGGERS)} AS listed, {_ANY(D.LAW_TRIGGERS)} AS law, {_ANY(D.QUESTIONS)} AS question, {_RULE} AS rule, {_TYPES} AS types FROM t),
o AS (SELECT *, CASE WHEN listed THEN 'table' WHEN law THEN 'law' WHEN named AND rule = 'citation_graph' THEN 'citation_graph' WHEN named AND question THEN 'case_answer'
 WHEN named AND rule = 'judgment_only' THEN 'judgment_only' WHEN named THEN 'full_case' ELSE coalesce(rule, 'hybrid') END AS output_type FROM u)
SELECT query_id, output_type, CASE WHEN listed THEN '' WHEN law THEN 'law,statute,legal' WHEN named AND rule = 'citation_graph' THEN 'citation' WHEN named AND question THEN 'judgment,order,facts,issues'
 WHEN named AND rule = 'judgment_only' THEN 'judgment,order' WHEN named THEN 'judgment,order,facts' WHEN rule IS NULL THEN 'judgment,order,facts,issues,citation,law' ELSE types END AS para_types,
CAST(round(CASE WHEN contains(v, 'what is') AND NOT (named AND NOT listed AND NOT law) THEN least(s, 0.5) ELSE s END, 2) AS DOUBLE) AS confidence
FROM (SELECT *, CASE WHEN named AND NOT listed AND NOT law THEN 0.4 ELSE 0 END + CASE WHEN output_type IN ('table', 'law') THEN 0 ELSE 0.3 END + CASE WHEN question THEN 0.3 ELSE 0 END AS s FROM o)""",
)(
    lambda f: query_tables.intents(_asked(f).withColumn("case_id", F.when(F.col("query_id") % 3 == 0, "c"))).select("query_id", "output_type", F.array_join("para_types", ",").alias("para_types"), "confidence")
)

# K1 with the text of its spans
_WINDOW = """CASE WHEN instr(lower(text), 'rewh') > 81 THEN '...' ELSE '' END || substring(text, greatest(1, instr(lower(text), 'rewh') - 80),
 least(length(text), instr(lower(text), 'rewh') + 83) - greatest(1, instr(lower(text), 'rewh') - 80) + 1) || CASE WHEN instr(lower(text), 'rewh') + 83 < length(text) THEN '...' ELSE '' END"""
register(
    "k1_fragments",
    f"""h AS (SELECT case_id, para_no, text, len(regexp_extract_all(lower(text), 'rewh')) AS hits, substring(text, 1, 60) AS head FROM paras),
u AS (SELECT *, row_number() OVER (PARTITION BY case_id, head ORDER BY hits DESC, para_no) AS same FROM h WHERE hits > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, para_no) AS rank FROM u WHERE same = 1),
w AS (SELECT *, {_WINDOW} AS window_text FROM r WHERE rank <= 3)
SELECT case_id, CAST(rank AS INT) AS rank, para_no, CAST(hits AS INT) AS hits, window_text, len(regexp_extract_all(lower(window_text), 'rewh')) AS highlighted FROM w""",
)(
    lambda f: evidence.snippets(f.paras, f.cases, ["rewh"])
    .select("case_id", F.inline("fragments"))
    .select("case_id", "rank", "para_no", "hits", F.array_join("spans.text", "").alias("window_text"), F.size(F.filter("spans", lambda s: s["highlighted"])).cast("long").alias("highlighted"))
)
