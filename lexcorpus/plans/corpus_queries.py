"""Registered queries: citations, evidence, facets, query tables, text functions, vectors, ingest and incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions import dictionaries as D
from lexcorpus.functions import prominence as P
from lexcorpus.functions import text as X
from lexcorpus.functions import treatment as T
from lexcorpus.operators import citations, evidence, facets, phrase_tables, postings, query_tables, search, vectors
from lexcorpus.plans.fixtures import Fixtures, oracle
from lexcorpus.sources import ingest, tables
from lexcorpus.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = lambda spark, folder: make(Fixtures(spark, folder))
        if sql is not None:
            SQL[name] = oracle(sql)
        return make

    return add


# Citation statistics, prominence and status
_COURT = "CASE " + " ".join(f"WHEN regexp_matches(target_citation, '{p}', 'i') THEN '{c}'" for p, c, _ in D.COURT_PATTERNS) + " ELSE 'Other' END"
_WEIGHT = "CASE " + " ".join(f"WHEN regexp_matches(target_citation, '{p}', 'i') THEN {w}" for p, _, w in D.COURT_PATTERNS) + " ELSE 2 END"
_MODIFIER = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.MODIFIERS.items()) + " ELSE 1.0 END"
_PROMINENCE = f"CAST(trunc(greatest(0, least(100, (least(total / 500.0 * 100, 100.0) + weight * 2.0 + {_MODIFIER.format('coalesce(most_common, chr(45))')} * 1.5 + CASE WHEN coalesce(avg_confidence, 0) = 0 THEN 0.25 ELSE avg_confidence * 0.5 END) / 122.45 * 100))) AS INT)"
_STATS = """k AS (SELECT target_citation, relationship, count(*) AS n FROM cites WHERE relationship IS NOT NULL GROUP BY ALL),
m AS (SELECT target_citation, relationship AS most_common FROM (SELECT *, row_number() OVER (PARTITION BY target_citation ORDER BY n DESC, relationship) AS r FROM k) WHERE r = 1),
t AS (SELECT target_citation, count(*) AS total, count(DISTINCT source_case_id) AS sources, coalesce(avg(confidence), 0.5) AS avg_confidence,
 count(*) FILTER (relationship = 'overruled') AS overruled_count, count(*) FILTER (relationship = 'approved') AS approved_count, count(*) FILTER (relationship = 'followed') AS followed_count FROM cites GROUP BY 1),
s AS (SELECT t.*, most_common FROM t LEFT JOIN m USING (target_citation)),
p AS (SELECT *, """ + _PROMINENCE + f""" AS prominence FROM (SELECT *, {_COURT} AS court, {_WEIGHT} AS weight FROM s))
"""
register("a7_citation_statistics", _STATS.replace(_PROMINENCE, "0") + "SELECT target_citation, total, sources, round(avg_confidence, 6) AS avg_confidence, CAST(overruled_count AS BIGINT) AS overruled_count, CAST(approved_count AS BIGINT) AS approved_count, CAST(followed_count AS BIGINT) AS followed_count, most_common FROM s")(lambda f: citations.statistics(f.cites).withColumn("avg_confidence", F.round("avg_confidence", 6)))
register("a8_prominence", _STATS + """SELECT target_citation, court, weight, prominence, CASE WHEN most_common = 'overruled' THEN 'overruled' WHEN prominence >= 80 THEN 'good_law' WHEN prominence >= 60 THEN 'active_authority'
WHEN prominence >= 40 THEN 'limited_precedent' WHEN prominence >= 20 THEN 'background' ELSE 'minimal_precedent' END AS status FROM p""")(lambda f: citations.scored(citations.statistics(f.cites)).select("target_citation", "court", "weight", "prominence", "status"))
_STATUS = _STATS + f""", g AS (SELECT source_case_id, target_citation, relationship, confidence, count(*) AS n FROM cites GROUP BY ALL),
e AS (SELECT source_case_id AS case_id, coalesce(nullif(relationship, ''), 'cited') AS kind, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.6 ELSE confidence END AS sure, n, prominence FROM g JOIN p USING (target_citation)),
z AS (SELECT case_id, sum(n) AS total, count(*) AS citing_count, sum(prominence * {_MODIFIER.format("kind")} * n) AS score, sum(sure * n) AS sure,
 sum(CASE kind WHEN 'overruled' THEN n ELSE 0 END) AS overruled, sum(CASE kind WHEN 'approved' THEN n ELSE 0 END) AS approved, sum(CASE kind WHEN 'followed' THEN n ELSE 0 END) AS followed FROM e GROUP BY 1),
y AS (SELECT *, CAST(trunc(least(100, round(score / total + sure / total * 25, 9))) AS INT) AS base FROM z),
x AS (SELECT c.case_id, citing_count, CASE WHEN total IS NULL THEN 'unknown' WHEN overruled > total * 0.5 THEN 'dubious' WHEN approved > total * 0.3 OR followed > total * 0.3 THEN 'reliable'
 WHEN base >= 75 THEN 'active_authority' WHEN base >= 50 THEN 'cited' ELSE 'limited' END AS status, base FROM cases c LEFT JOIN y USING (case_id)),
v AS (SELECT case_id, status, CASE status WHEN 'unknown' THEN 50 WHEN 'dubious' THEN greatest(20, base - 30) WHEN 'reliable' THEN least(90, base + 10) ELSE base END AS strength, coalesce(citing_count, 0) AS citing_count FROM x)
"""
_LABEL = "CASE WHEN status = 'unknown' THEN 'unknown' ELSE '(' || status || ') citing ' || citing_count || ' unique authorities' END"
register("a9_precedent_status", _STATUS + f"SELECT case_id, status, strength, {_LABEL} AS label, citing_count FROM v")(lambda f: citations.precedent_status(f.cases, f.cites).select("case_id", "status", "strength", "label", "citing_count"))
register("j5_status_lookup", _STATUS + "SELECT case_id, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN status ELSE 'unknown' END AS status, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN strength ELSE 50 END AS strength FROM v")(lambda f: citations.with_status(f.cases, citations.precedent_status(f.cases, f.cites).where(F.col("case_id").cast("bigint") % 3 == 0)).select("case_id", "status", "strength"))
_VALID = """u AS (SELECT cited_case_id AS case_id, count(*) AS cited_by, min(CASE WHEN relationship = 'overruled' THEN source_case_id END) AS overruled_by FROM cites GROUP BY 1)
SELECT case_id, CASE WHEN overruled_by IS NOT NULL THEN 'overruled' WHEN cited_by > 50 THEN 'highly_cited' ELSE 'valid' END AS validity, overruled_by, coalesce(cited_by, 0) AS cited_by FROM cases LEFT JOIN u USING (case_id)"""
register("a11_validity", _VALID)(lambda f: citations.validity(f.cases, f.cites))
register("j2_cited_by", """j AS (SELECT cited_case_id, source_case_id, confidence, CAST(row_number() OVER (PARTITION BY cited_case_id ORDER BY authority_score DESC NULLS LAST, confidence DESC NULLS LAST, source_case_id, target_citation, relationship NULLS LAST, created_at) AS INT) AS rank
FROM cites JOIN cases ON source_case_id = case_id WHERE cited_case_id IS NOT NULL) SELECT cited_case_id, rank, source_case_id, round(confidence, 6) AS confidence FROM j WHERE rank <= 10""")(lambda f: citations.cited_by(f.cites, f.cases).withColumn("confidence", F.round("confidence", 6)))
register("j3_relied_on", """j AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_case_id ORDER BY confidence DESC NULLS LAST, target_citation, relationship, created_at, cited_case_id NULLS LAST) AS INT) AS rank FROM cites WHERE relationship IN ('relied_on', 'followed', 'applied', 'cited'))
SELECT source_case_id, rank, target_citation, relationship, cited_case_id, case_name AS cited_name FROM j LEFT JOIN cases ON cited_case_id = case_id WHERE rank <= 10""")(lambda f: citations.relied_on(f.cites, f.cases).drop("confidence"))
_TREE = """e AS (SELECT source_case_id AS at, cited_case_id AS case_id, max(confidence) AS confidence, min(relationship) AS relationship FROM cites WHERE cited_case_id IS NOT NULL GROUP BY ALL),
a AS (SELECT e.at AS root, case_id, 1 AS depth, relationship, confidence, [e.at, case_id] AS path FROM e WHERE e.at IN ('1', '7', '8') AND e.at <> case_id),
b AS (SELECT root, e.case_id, 2 AS depth, e.relationship, e.confidence, list_append(path, e.case_id) AS path FROM a JOIN e ON e.at = a.case_id WHERE NOT list_contains(path, e.case_id))
SELECT root, case_id, depth, relationship, round(confidence, 6) AS confidence, array_to_string(path, '/') AS path FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
register("j4_citation_tree", _TREE)(lambda f: citations.citation_tree(f.cites, f.spark.createDataFrame([("1",), ("7",), ("8",)], "case_id string")).withColumns({"path": F.array_join("path", "/"), "confidence": F.round("confidence", 6)}))
# j4_citation_tree keeps its three roots, as its SQL does; this is the whole job.
register("j4_citation_tree_all", _TREE.replace("e.at IN ('1', '7', '8')", "CAST(e.at AS BIGINT) % 20 = 0"))(lambda f: citations.citation_tree(f.cites, f.cases.where(F.col("case_id").cast("bigint") % 20 == 0).select("case_id")).withColumns({"path": F.array_join("path", "/"), "confidence": F.round("confidence", 6)}))
register("j6_case_details", """n AS (SELECT cited_case_id AS case_id, count(*) AS c FROM cites GROUP BY 1), a AS (SELECT case_id, count(*) AS c FROM acts GROUP BY 1),
o AS (SELECT source_case_id AS case_id, count(*) AS c, FROM cites GROUP BY 1), p AS (SELECT case_id, count(*) AS c FROM paras GROUP BY 1)
SELECT case_id, case_name, coalesce(n.c, 0) AS cited_by_count, CAST(least(20, coalesce(a.c, 0)) AS INT) AS n_acts, CAST(least(20, coalesce(o.c, 0)) AS INT) AS n_out, CAST(least(20, coalesce(n.c, 0)) AS INT) AS n_in, CAST(least(10, coalesce(p.c, 0)) AS INT) AS n_paragraphs
FROM cases LEFT JOIN n USING (case_id) LEFT JOIN a USING (case_id) LEFT JOIN o USING (case_id) LEFT JOIN p USING (case_id)""")(
    lambda f: citations.case_details(f.cases, f.acts, f.cites, f.paras).select("case_id", "case_name", "cited_by_count", *[F.coalesce(F.size(c), F.lit(0)).alias(n) for c, n in (("acts", "n_acts"), ("citations_out", "n_out"), ("citations_in", "n_in"), ("paragraphs", "n_paragraphs"))])
)
_PHRASES = {"overruled": ("rewh",), "distinguished": ("thatin", "that"), "followed": ("the",), "affirmed": ("with",), "doubted": ("of",)}
_COUNT = lambda words, t: " + ".join(f"len(regexp_extract_all(lower({t}), '{w}'))" for w in words)
_NEAR = "CASE WHEN instr(lower(judgment), lower(cited_name)) > 0 THEN regexp_replace(trim(substring(judgment, greatest(1, instr(lower(judgment), lower(cited_name)) - 1000), instr(lower(judgment), lower(cited_name)) + length(cited_name) + 1000 - greatest(1, instr(lower(judgment), lower(cited_name)) - 1000))), '\\s+', ' ', 'g') ELSE substring(judgment, 1, 3000) END"
register("a10_treatment_status", f"""w AS (SELECT cited_case_id AS case_id, {_NEAR} AS near FROM cites JOIN (SELECT case_id AS cited_case_id, case_name AS cited_name FROM cases) USING (cited_case_id) JOIN (SELECT case_id AS source_case_id, judgment FROM cases WHERE length(judgment) > 0) USING (source_case_id)),
c AS (SELECT case_id, count(*) AS scanned, {", ".join(f"CAST(sum({_COUNT(v, 'near')}) AS BIGINT) AS {k}" for k, v in _PHRASES.items())} FROM w GROUP BY 1)
SELECT case_id, CASE WHEN overruled > 0 THEN 'overruled' WHEN followed + affirmed > 0 THEN 'good_law' WHEN distinguished > 0 THEN 'distinguished' WHEN doubted > 0 THEN 'doubted' ELSE 'unknown' END AS status,
CASE WHEN overruled > 0 THEN 0 WHEN followed + affirmed + distinguished + doubted = 0 THEN 50 ELSE CAST(trunc(least(100, 100.0 * (followed + affirmed) / (followed + affirmed + 1.5 * (distinguished + doubted)))) AS INT) END AS strength, scanned, {", ".join(_PHRASES)} FROM c""")(lambda f: citations.treatment_status(f.cites, f.cases, _PHRASES).drop("label", "top_citing"))


# The same with the real phrases, which the judgments get in place of common words, and with label and listed cases.
_EVERY_PHRASE = [p for some in D.TREATMENTS.values() for p in some]
_GIVEN = "CASE CAST(case_id AS BIGINT) % 50 " + " ".join(f"WHEN {i} THEN ' {p} '" for i, p in enumerate(_EVERY_PHRASE)) + " ELSE ' and ' END"
_TREATED = f"replace(replace(replace(judgment, ' and ', {_GIVEN}), ' und ', {_GIVEN}), ' de ', {_GIVEN})"
_CLASSES = tuple(D.TREATMENTS)
_LATER = "{0} || ' later case' || CASE WHEN {0} > 1 THEN 's' ELSE '' END"
_COUNTED = ", ".join("CAST(" + " + ".join(f"(length(near) - length(replace(near, '{p}', ''))) / {len(p)}" for p in some) + f" AS BIGINT) AS {c}" for c, some in D.TREATMENTS.items())
register(
    "a10_treatment_labels",
    f"""j AS (SELECT case_id, case_name, {_TREATED} AS judgment FROM cases),
w AS (SELECT cited_case_id, source_case_id, lower({_NEAR}) AS near FROM cites JOIN (SELECT case_id AS cited_case_id, case_name AS cited_name FROM j) USING (cited_case_id)
 JOIN (SELECT case_id AS source_case_id, judgment FROM j WHERE length(judgment) > 0) USING (source_case_id)),
c AS (SELECT cited_case_id, source_case_id, {_COUNTED} FROM w),
t AS (SELECT cited_case_id AS case_id, count(*) AS scanned, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _CLASSES)} FROM c GROUP BY 1),
d AS (SELECT DISTINCT cited_case_id AS case_id, source_case_id, CASE greatest({", ".join(_CLASSES)}) {" ".join(f"WHEN {c} THEN '{c}'" for c in _CLASSES)} END AS treatment FROM c WHERE {" + ".join(_CLASSES)} > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source_case_id) AS k FROM d),
l AS (SELECT case_id, string_agg(source_case_id || ':' || treatment, ',' ORDER BY k) AS top_citing FROM r WHERE k <= 10 GROUP BY 1)
SELECT case_id, scanned, top_citing, CASE WHEN overruled > 0 THEN 'Overruled in ' || {_LATER.format("overruled")}
 WHEN followed + affirmed > 0 AND distinguished + doubted = 0 THEN 'Good law — followed in ' || {_LATER.format("(followed + affirmed)")}
 WHEN followed + affirmed > 0 THEN 'Generally followed (' || (followed + affirmed) || '×) but distinguished in some cases (' || distinguished || '×)'
 WHEN distinguished > 0 THEN 'Distinguished in ' || {_LATER.format("distinguished")} || ' — verify applicability'
 WHEN doubted > 0 THEN 'Doubted in ' || {_LATER.format("doubted")} || ' — treat with caution' ELSE 'No later treatment found — status unknown' END AS label FROM t LEFT JOIN l USING (case_id)""",
)(
    lambda f: citations.treatment_status(f.cites, f.cases.withColumn("judgment", F.expr(_TREATED))).select(
        "case_id", "scanned", F.array_join(F.transform("top_citing", lambda x: F.concat_ws(":", x["source_case_id"], x["treatment"])), ",").alias("top_citing"), "label"
    )
)


@register("j10_citation_contexts", """e AS (SELECT source_case_id, target_citation, cited_case_id, relationship, confidence, created_at, CASE WHEN CAST(source_case_id AS BIGINT) % 2 = 0 THEN 'as held in ' || target_citation || ', the claim is upheld by this court. More.' END AS context_sentence,
 source_case_id || '_' || (length(target_citation) % 5) AS paragraph_id FROM cites),
r AS (SELECT e.*, para_no, CAST(row_number() OVER (PARTITION BY source_case_id ORDER BY para_no NULLS LAST, target_citation, created_at, cited_case_id NULLS LAST, relationship, confidence) AS INT) AS rank FROM e LEFT JOIN paras USING (paragraph_id))
SELECT source_case_id, rank, target_citation, cited_case_id, case_name AS cited_name, para_no, coalesce(context_sentence, '') AS context,
CASE WHEN context_sentence IS NULL THEN 'cited' ELSE 'affirmed' END AS treatment, CASE WHEN context_sentence IS NULL THEN '' ELSE 'the claim is upheld by this court.' END AS cited_for FROM r LEFT JOIN cases ON cited_case_id = case_id WHERE rank <= 20""")
def contexts(f: Fixtures, n: int = 20) -> DataFrame:
    sentence = F.concat(F.lit("as held in "), "target_citation", F.lit(", the claim is upheld by this court. More."))
    edges = f.cites.withColumns({"context_sentence": F.when(F.col("source_case_id").cast("bigint") % 2 == 0, sentence), "paragraph_id": F.concat_ws("_", "source_case_id", F.length("target_citation") % 5)})
    return citations.citation_contexts(edges, f.cases, f.paras, n).drop("cited_year")


@register("j10_citation_contexts_all")
def contexts_all(f: Fixtures) -> DataFrame:
    """The whole job, up to the operator's 100 contexts a case; j10_citation_contexts keeps 20, as its SQL does."""
    return contexts(f, n=100)


SQL["j10_citation_contexts_all"] = SQL["j10_citation_contexts"].replace("rank <= 20", "rank <= 100")


# Facets and lists
register("a1_act_lists", "SELECT case_id, string_agg(DISTINCT act_name, ' | ' ORDER BY act_name) AS act_names, string_agg(DISTINCT section, ', ' ORDER BY section) AS sections FROM acts GROUP BY case_id")(lambda f: facets.act_lists(f.acts))
register("a2_cited_by_counts", "SELECT cited_case_id, count(*) AS cited_by_count FROM cites WHERE cited_case_id IS NOT NULL GROUP BY 1")(lambda f: facets.cited_by_counts(f.cites))
register("a4_facets", """v AS (SELECT 'court' AS facet, court AS value, 15 AS most FROM cases UNION ALL SELECT 'year', CAST(year AS VARCHAR), 1000000 FROM cases UNION ALL SELECT 'outcome', outcome, 10 FROM cases UNION ALL SELECT 'court_type', court_type, 10 FROM cases),
g AS (SELECT facet, value, most, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY facet, value, most), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM g) SELECT facet, value, n FROM r WHERE r <= most""")(lambda f: facets.facets(f.cases))
register("a5_top_values", "SELECT value, count(*) AS n FROM (SELECT unnest([outcome, court]) AS value FROM cases) WHERE value <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 50")(lambda f: facets.top_values(f.cases_with_lists, "subject_tags"))
register("a6_filter_options", "SELECT string_agg(DISTINCT court, ',' ORDER BY court) AS courts, string_agg(DISTINCT court_type, ',' ORDER BY court_type) AS court_types, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, min(year) AS year_min, max(year) AS year_max, count(*) AS n_cases FROM cases")(lambda f: facets.filter_options(f.cases))
_ALL_KINDS = ", ".join(f"'{k}'" for k in facets.KINDS)
register("j11_coverage", f"""k AS (SELECT DISTINCT case_id, [{_ALL_KINDS}][CAST(length(target_citation) * 7 + CAST(case_id AS BIGINT) AS INT) % 6 + 1] AS kind FROM (SELECT source_case_id AS case_id, target_citation FROM cites))
SELECT case_id, {", ".join(f"coalesce(bool_or(kind = '{k}'), false) AS has_{k}" for k in facets.KINDS)},
array_to_string(list_filter([{_ALL_KINDS}], lambda x: NOT list_contains(coalesce(list(kind), []), x)), ',') AS pending, count(DISTINCT kind) = 6 AS all_cached FROM cases LEFT JOIN k USING (case_id) GROUP BY case_id""")(
    lambda f: facets.analysis_coverage(f.cases, f.cites.select(F.concat_ws(":", "source_case_id", F.element_at(F.array(*map(F.lit, facets.KINDS)), ((F.length("target_citation") * 7 + F.col("source_case_id").cast("bigint")) % 6 + 1).cast("int"))).alias("cache_key")))
)

# Evidence (K2-K8)
_TOP = "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY {}) AS INT) AS rank FROM paras WHERE {}) SELECT case_id, rank, paragraph_id FROM r WHERE rank <= {}"
register("k2_judgment_paragraphs", _TOP.format("CASE para_type WHEN 'judgment' THEN 0 ELSE 1 END, coalesce(quality_score, 0.5) DESC, paragraph_id", "para_type IN ('judgment', 'order') AND coalesce(quality_score, 1) > 0.1 AND word_count > 30", 30))(lambda f: evidence.judgment_paragraphs(f.paras).select("case_id", "rank", "paragraph_id"))
_PLACE = "CASE para_type WHEN 'judgment' THEN 0 WHEN 'order' THEN 1 WHEN 'issues' THEN 2 WHEN 'facts' THEN 3 ELSE 4 END"
register("k3_all_paragraphs", _TOP.format(f"{_PLACE}, coalesce(quality_score, 0.5) DESC, paragraph_id", "coalesce(quality_score, 1) > 0.05 AND word_count > 40", 20))(lambda f: evidence.all_paragraphs(f.paras).select("case_id", "rank", "paragraph_id"))
register("k4_best_paragraphs", "SELECT paragraph_id, quality_score FROM paras WHERE quality_score > 0.3 AND word_count > 30 ORDER BY CASE para_type WHEN 'judgment' THEN 0 WHEN 'order' THEN 1 ELSE 2 END, quality_score DESC, paragraph_id LIMIT 15")(lambda f: evidence.best_paragraphs(f.paras).select("paragraph_id", "quality_score"))
register("k5_decisive_paragraph", "r AS (SELECT *, para_type IN ('judgment', 'order') AS typed FROM paras), s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN typed THEN 0 ELSE 1 END, CASE WHEN typed THEN 0 ELSE -length(text) END, para_no) AS k FROM r) SELECT case_id, paragraph_id, CAST(CASE WHEN typed THEN 0.9 WHEN length(text) > 200 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM s WHERE k = 1")(lambda f: evidence.decisive_paragraph(f.paras).select("case_id", "paragraph_id", "confidence"))
register("k6_evidence_context", """r AS (SELECT *, trim(text) AS body, row_number() OVER (PARTITION BY case_id, para_type ORDER BY para_no) AS k FROM paras WHERE length(trim(text)) > 0),
l AS (SELECT case_id, para_type, '[Para ' || para_no || '] ' || substring(body, 1, 600) || CASE WHEN length(body) > 600 THEN '...' ELSE '' END AS line, k FROM r WHERE k <= 4),
g AS (SELECT case_id, CASE para_type WHEN 'facts' THEN 0 WHEN 'issues' THEN 1 WHEN 'judgment' THEN 2 WHEN 'order' THEN 3 ELSE 4 END AS place,
 '=== ' || CASE para_type WHEN 'facts' THEN 'FACTS OF THE CASE' WHEN 'issues' THEN 'ISSUES / QUESTIONS OF LAW' WHEN 'judgment' THEN 'JUDGMENT / RATIO' WHEN 'order' THEN 'FINAL ORDER' ELSE 'OTHER PARAGRAPHS' END || ' ===' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY k) AS block FROM l GROUP BY case_id, para_type)
SELECT case_id, string_agg(block, chr(10) || chr(10) ORDER BY place) AS context FROM g GROUP BY case_id""")(lambda f: evidence.evidence_context(f.paras))
_QHITS = "h AS (SELECT CAST(CAST(case_id AS BIGINT) % 20 AS INT) AS query_id, case_id, case_name, court, year, judgment AS text, CAST(floor(authority_score * 10) AS INT) AS relevance_score FROM cases)"
_qhits = lambda f: f.cases.select((F.col("case_id").cast("bigint") % 20).cast("int").alias("query_id"), "case_id", "case_name", "court", "year", F.col("judgment").alias("text"), F.floor(F.col("authority_score") * 10).cast("int").alias("relevance_score"))
register("k7_evidence_string", _QHITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC NULLS LAST, case_id) AS k FROM h)
SELECT query_id, string_agg('[' || k || '] Case: ' || case_name || ' (' || coalesce(court, '') || ' ' || coalesce(CAST(year AS VARCHAR), '') || ') | Relevance: ' || relevance_score || chr(10) || substring(text, 1, 800), chr(10) || chr(10) ORDER BY k) AS evidence FROM r WHERE k <= 10 GROUP BY 1""")(lambda f: evidence.evidence_string(_qhits(f)))
register("k8_best_hits", """h AS (SELECT CAST(para_no % 3 AS INT) AS query_id, case_id, paragraph_id, quality_score AS relevance_score FROM paras), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY coalesce(relevance_score, 0) DESC, paragraph_id) AS k FROM h)
SELECT query_id, case_id, paragraph_id, relevance_score FROM r WHERE k = 1""")(lambda f: evidence.best_hits(f.paras.select((F.col("para_no") % 3).alias("query_id"), "case_id", "paragraph_id", F.col("quality_score").alias("relevance_score"))))

# Vectors (K9, X20, R7)
_NEAREST = """n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM n),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.v, d.v) / q.l / d.l, 9) AS score FROM u q, u d WHERE q.vec_id < 10),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s)"""


def nearest(f: Fixtures, k: int = 20, asked: str = "id < 10") -> DataFrame:
    rows = f.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.vector_topk(rows.where(asked).withColumnRenamed("id", "query_id"), rows, k)


register("k9_vector_topk", "WITH " + _NEAREST + " SELECT query_id, rank, id, round(score, 6) AS score FROM t WHERE rank <= 20")(lambda f: nearest(f).withColumn("score", F.round("score", 6)))


# k9_vector_topk keeps its ten queries, as its SQL does; this is the whole job.
EVERY = "id % 20 = 0"
register("k9_vector_topk_all", "WITH " + _NEAREST.replace("q.vec_id < 10", "q.vec_id % 20 = 0") + " SELECT query_id, rank, id, round(score, 6) AS score FROM t WHERE rank <= 20")(lambda f: nearest(f, asked=EVERY).withColumn("score", F.round("score", 6)))


@register("x20_embed")
def embedded(f: Fixtures) -> DataFrame:
    import numpy as np

    def letters(texts):  # counts of the first letters of the alphabet stand in for an encoder
        return np.array([[t.lower().count(c) for c in "abcdefgh"] for t in texts], dtype=float)

    return vectors.embed(f.cases.select("case_id", "judgment"), letters, "judgment").select("case_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


SQL["x20_embed"] = oracle(
    "c AS (SELECT case_id, list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda l: CAST(len(judgment) - len(replace(lower(judgment), l, '')) AS DOUBLE)) AS v FROM cases), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM c) SELECT case_id, list_transform(v, lambda x: CASE WHEN l > 0 THEN round(x / l, 6) ELSE x END) AS embedding FROM n"
)


@register(
    "r7_hybrid",
    _NEAREST.split(",\ns AS")[0].replace("n AS (", "n AS (", 1)
    + """, c AS (SELECT count(*) AS n FROM documents), sv AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.v, d.v) / q.l / d.l, 9) AS score FROM u q, u d WHERE q.vec_id < 10),
tv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sv),
lex AS (SELECT CAST(CAST(case_id AS BIGINT) % 10 AS BIGINT) AS query_id, case_id, paragraph_id, quality_score AS relevance_score, 'paragraph' AS result_type FROM paras WHERE contains(lower(text), 'rewh')),
nam AS (SELECT CAST(CAST(case_id AS BIGINT) % 10 AS BIGINT) AS query_id, case_id, NULL AS paragraph_id, 0.95 AS relevance_score, 'case' AS result_type FROM cases WHERE CAST(case_id AS BIGINT) % 37 = 0),
vec AS (SELECT query_id, CAST(id % c.n AS VARCHAR) AS case_id, 'v' || id AS paragraph_id, score AS relevance_score, 'paragraph' AS result_type FROM tv, c WHERE rank <= 20),
al AS (SELECT * FROM lex UNION ALL SELECT * FROM nam UNION ALL SELECT * FROM vec),
bh AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY coalesce(relevance_score, 0) DESC, paragraph_id NULLS FIRST) AS k FROM al),
d AS (SELECT source_case_id AS case_id, least(count(*), 10) AS degree FROM cites GROUP BY 1),
z AS (SELECT query_id, case_id, 0.6 * coalesce(relevance_score, 0.5) + 0.2 * CASE WHEN result_type = 'case' THEN coalesce(degree, 0) / 10.0 ELSE 0 END + 0.2 * coalesce(CASE WHEN year IS NOT NULL THEN least(1, greatest(0, (year - 2010) / 20.0)) END, 0) AS rerank_score,
 CAST(contains(lower(case_name), 'the') AS INT) + CAST(contains(lower(case_name), 'ing') AS INT) AS m FROM bh JOIN cases USING (case_id) LEFT JOIN d USING (case_id) WHERE k = 1 AND (year IS NULL OR year >= 1960)),
y AS (SELECT query_id, case_id, rerank_score, CASE WHEN m >= 2 THEN m ELSE 0 END AS boost FROM z),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, rerank_score DESC, case_id) AS INT) AS rank FROM y)
SELECT query_id, rank, case_id, round(rerank_score, 6) AS rerank_score, boost FROM x WHERE rank <= 10""",
)
def hybrid(f: Fixtures) -> DataFrame:
    asked = f.spark.range(10).select(F.col("id").alias("query_id"), F.lit("the ing").alias("query"))
    n = F.col("case_id").cast("bigint")
    lexical = f.paras.where(F.contains(F.lower("text"), F.lit("rewh"))).select((n % 10).alias("query_id"), "case_id", "paragraph_id", F.col("quality_score").alias("relevance_score"), F.lit("paragraph").alias("result_type"))
    named = f.cases.where(n % 37 == 0).select((n % 10).alias("query_id"), "case_id", F.lit(None).cast("string").alias("paragraph_id"))
    count = f.raw("documents").agg(F.count("*").alias("n"))
    near = nearest(f).join(F.broadcast(count)).select("query_id", (F.col("id") % F.col("n")).cast("string").alias("case_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("paragraph_id"), F.col("score").alias("relevance_score"), F.lit("paragraph").alias("result_type"))
    return vectors.hybrid(asked, lexical, named, near, f.cases_with_lists, f.cites, year_from=1960).withColumn("rerank_score", F.round("rerank_score", 6))


def asked_all(f: Fixtures) -> DataFrame:
    """query_id, query: for every vector of `EVERY` the first two longer words of the name of the case it falls on."""
    count = f.raw("documents").agg(F.count("*").alias("n"))
    ids = f.raw("embeddings").select(F.col("vec_id").alias("id")).where(EVERY).join(F.broadcast(count)).select(F.col("id").alias("query_id"), (F.col("id") % F.col("n")).cast("string").alias("case_id"))
    words = F.slice(F.filter(F.array_distinct(X.tokens(F.col("case_name"))), lambda w: F.length(w) > 2), 1, 2)
    return ids.join(f.cases, "case_id").select("query_id", F.array_join(words, " ").alias("query")).where("query <> ''")


@register("r7_hybrid_all")
def hybrid_all(f: Fixtures) -> DataFrame:
    """The whole job of r7: every query of `EVERY` by its own words in paragraphs, in names and by its vector.

    No SQL: a test compares it with plain code. r7_hybrid keeps its ten queries, as its SQL does.
    """
    asked = asked_all(f).withColumn("terms", F.split("query", " "))
    paras = f.paras.select("case_id", "paragraph_id", "text", F.col("quality_score").alias("relevance_score"))
    lexical = vectors.word_hits(asked, paras, f.cases, year_from=1960).withColumn("result_type", F.lit("paragraph"))
    named = postings.search_texts(asked, f.cases, "case_id", "case_name").withColumn("paragraph_id", F.lit(None).cast("string"))
    count = f.raw("documents").agg(F.count("*").alias("n"))
    near = nearest(f, asked=EVERY).join(F.broadcast(count)).select("query_id", (F.col("id") % F.col("n")).cast("string").alias("case_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("paragraph_id"), F.col("score").alias("relevance_score"), F.lit("paragraph").alias("result_type"))
    return vectors.hybrid(asked, lexical, named, near, f.cases_with_lists, f.cites, year_from=1960).withColumn("rerank_score", F.round("rerank_score", 6))


# Text functions
register("x1_highlight", r"""SELECT case_id, para_no, instr(lower(text), 'rewh') > 0 AS found, CASE WHEN instr(lower(text), 'rewh') = 0 THEN substring(text, 1, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END
ELSE CASE WHEN instr(lower(text), 'rewh') > 81 THEN '...' ELSE '' END || substring(text, greatest(1, instr(lower(text), 'rewh') - 80), least(length(text), instr(lower(text), 'rewh') + 83) - greatest(1, instr(lower(text), 'rewh') - 80) + 1) || CASE WHEN instr(lower(text), 'rewh') + 83 < length(text) THEN '...' ELSE '' END END AS window_text FROM paras""")(
    lambda f: f.paras.select("case_id", "para_no", X.highlighted(F.col("text"), ["rewh"]).alias("s")).select("case_id", "para_no", F.exists("s", lambda x: x["highlighted"]).alias("found"), F.array_join("s.text", "").alias("window_text"))
)
register("x2_context_window", r"SELECT case_id, CASE WHEN instr(lower(judgment), 'thatin') > 0 THEN regexp_replace(trim(substring(judgment, greatest(1, instr(lower(judgment), 'thatin') - 40), instr(lower(judgment), 'thatin') + 46 - greatest(1, instr(lower(judgment), 'thatin') - 40))), '\s+', ' ', 'g') END AS near FROM cases")(lambda f: f.cases.select("case_id", X.context_window(F.col("judgment"), F.lit("ThatIn"), 40).alias("near")))
register("x3_treatment_counts", f"SELECT case_id, {', '.join(f'CAST({_COUNT(v, chr(106) + chr(117) + chr(100) + chr(103) + chr(109) + chr(101) + chr(110) + chr(116))} AS INT) AS {k}' for k, v in _PHRASES.items())} FROM cases")(lambda f: f.cases.select("case_id", *[n.alias(c) for c, n in T.counts(F.col("judgment"), _PHRASES).items()]))
register("x4_proposition", r"""q AS (SELECT case_id, CASE WHEN instr(lower(judgment), 'that') > 0 THEN trim(string_split_regex(regexp_replace(trim(substring(judgment, instr(lower(judgment), 'that') + 4)), '([.!?])\s+', '\1' || chr(1)), chr(1))[1]) END AS s FROM cases),
r AS (SELECT case_id, trim(regexp_replace(s, '^[,;:–—-]+\s*', '')) AS s FROM q) SELECT case_id, CASE WHEN length(s) > 10 THEN substring(s, 1, 200) ELSE '' END AS cited_for FROM r""")(lambda f: f.cases.select("case_id", T.proposition(F.col("judgment"), F.lit("that")).alias("cited_for")))
_FOUR = "SELECT case_id, CAST(citation_count % 3 AS INT) AS fo, CAST(citation_count % 4 AS INT) AS di, CAST(citation_count % 2 AS INT) AS du, CAST(CASE WHEN citation_count % 7 = 0 THEN 2 ELSE 0 END AS INT) AS ov FROM cases"
register("x5_strength_status", f"w AS ({_FOUR}) SELECT case_id, CASE WHEN ov > 0 THEN 'overruled' WHEN fo > 0 THEN 'good_law' WHEN di > 0 THEN 'distinguished' WHEN du > 0 THEN 'doubted' ELSE 'unknown' END AS status, CASE WHEN ov > 0 THEN 0 WHEN fo + di + du = 0 THEN 50 ELSE CAST(trunc(least(100, 100.0 * fo / (fo + 1.5 * (di + du)))) AS INT) END AS strength FROM w")(
    lambda f: f.cases.select("case_id", *[(F.col("citation_count") % m).cast("int").alias(c) for c, m in (("fo", 3), ("di", 4), ("du", 2))], F.when(F.col("citation_count") % 7 == 0, 2).otherwise(0).alias("ov")).select("case_id", T.status(*map(F.col, ("fo", "di", "du", "ov"))).alias("status"), T.strength(*map(F.col, ("fo", "di", "du", "ov"))).alias("strength"))
)
register("x6_court_from_citation", f"SELECT DISTINCT target_citation, {_COURT} AS court, {_WEIGHT} AS weight FROM cites")(lambda f: f.cites.select("target_citation").distinct().select("target_citation", P.court(F.col("target_citation")).alias("court"), P.court_weight(F.col("target_citation")).alias("weight")))
_EDGE = "SELECT source_case_id, target_citation, created_at, relationship AS most_common, confidence AS avg_confidence, length(target_citation) * 20 AS total, 6 AS weight FROM cites"
register("x7_prominence_score", f"w AS ({_EDGE}) SELECT source_case_id, target_citation, created_at, {_PROMINENCE} AS prominence FROM w")(lambda f: f.cites.select("source_case_id", "target_citation", "created_at", P.prominence(F.length("target_citation") * 20, F.lit(6), F.col("relationship"), F.col("confidence")).alias("prominence")))
register("x8_score_status", "SELECT case_id, CASE WHEN court_type = 'SC' THEN 'overruled' WHEN s >= 80 THEN 'good_law' WHEN s >= 60 THEN 'active_authority' WHEN s >= 40 THEN 'limited_precedent' WHEN s >= 20 THEN 'background' ELSE 'minimal_precedent' END AS status FROM (SELECT case_id, court_type, citation_count % 101 AS s FROM cases)")(lambda f: f.cases.select("case_id", P.score_status(F.col("citation_count") % 101, F.when(F.col("court_type") == "SC", "Overruled")).alias("status")))
register("x9_simple_status", "SELECT source_case_id, target_citation, created_at, coalesce(relationship, 'unknown') AS status, CAST(trunc(greatest(0, least(100, confidence * 100))) AS INT) AS strength FROM cites")(lambda f: f.cites.select("source_case_id", "target_citation", "created_at", P.simple_status(F.col("relationship")).alias("status"), P.simple_strength(F.col("confidence")).alias("strength")))
_QUERY = "(CASE query_id % 6 WHEN 0 THEN 'section ' || (300 + query_id % 200) || ' of the penal code' WHEN 1 THEN 'SC on article ' || (query_id % 300) WHEN 2 THEN 'what is reguler bail in a high court' WHEN 3 THEN 'judgments on contrcat dispute ' || query_id WHEN 4 THEN 'notes on s. 498A and supeme court' ELSE 'murdar appeal ' || (query_id % 50) || ' facts' END)"
_asked = lambda f: f.log.select("query_id", F.expr(_QUERY).alias("query"))
_Q = f"q AS (SELECT query_id, {_QUERY} AS query FROM query_log)"
register("x10_section_references", _Q + r""", r AS (SELECT query_id, regexp_extract_all(query, '(?i)\bsection\s+(\d{1,4}[a-zA-Z]?)\b', 1) || regexp_extract_all(query, '(?i)\bs\.?\s+(\d{1,4}[a-zA-Z]?)\b', 1) || regexp_extract_all(query, '(?i)\barticle\s+(\d{1,3})\b', 1) || regexp_extract_all(query, '(?i)\bart\.?\s+(\d{1,3})\b', 1) AS s FROM q)
SELECT query_id, array_to_string(s, ',') AS sections FROM r""")(lambda f: _asked(f).select("query_id", F.array_join(X.section_references(F.col("query")), ",").alias("sections")))


def _with_phrases(f: Fixtures) -> DataFrame:
    """The canonical names of each query's phrases, which come from a table."""
    table = f.spark.createDataFrame([(p, c) for p, (c, *_) in D.PHRASES.items()], "phrase string, canonical string")
    found = phrase_tables.phrases_in(_asked(f), table, "query_id", "query")
    return _asked(f).select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce(F.array_join("found.canonical", ","), F.lit("")).alias("phrases"))


def _with_synonyms(f: Fixtures) -> DataFrame:
    """The sorted synonyms of the keys that each query holds, which come from a table."""
    table = f.spark.createDataFrame([(k, list(v)) for k, v in D.SYNONYMS.items()], "entry string, synonyms array<string>")
    found = phrase_tables.keys_within(_asked(f), table, "query_id").groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))).alias("s"))
    return _asked(f).select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce(F.array_join("s", ","), F.lit("")).alias("synonyms"))


_LONGEST = sorted(D.PHRASES, key=lambda p: (-len(p), p))
_CANON = "CASE p " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, (c, *_x) in D.PHRASES.items()) + " END"
register("x11_legal_phrases", _Q + rf", r AS (SELECT query_id, regexp_extract_all(lower(query), '\b({'|'.join(_LONGEST)})\b', 1) AS s FROM q) SELECT query_id, array_to_string(list_transform(s, lambda p: {_CANON}), ',') AS phrases FROM r")(lambda f: _with_phrases(f))
_EXPANDED = "lower(query)"
for _a, _full in D.ABBREVIATIONS.items():
    _EXPANDED = rf"regexp_replace({_EXPANDED}, '\b{_a}\b', '{_full}', 'g')"
register("x12_abbreviations", _Q + f" SELECT query_id, {_EXPANDED} AS expanded FROM q")(
    lambda f: phrase_tables.replaced_words(_asked(f), f.spark.createDataFrame(list(D.ABBREVIATIONS.items()), "word string, replacement string"), "query_id", "query").withColumnRenamed("replaced", "expanded")
)
register("x13_spelling")(lambda f: query_tables.correct_queries(_asked(f)).select("query_id", "corrected_query", "n_corrections"))
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\pL\\pM\\pN_]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"
register("x14_similarity", f"n AS (SELECT DISTINCT p_name FROM part), m AS (SELECT p_name, {_GRAMS.format('p_name')} AS g FROM n) SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE), 6) AS similarity FROM m a JOIN m b ON string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1]")(
    lambda f: (lambda n: n.select(F.col("p_name").alias("a"), F.split("p_name", " ")[0].alias("k")).join(n.select(F.col("p_name").alias("b"), F.split("p_name", " ")[0].alias("k")), "k"))(f.raw("part").select("p_name").distinct()).select("a", "b", F.round(X.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))
)
_WORDS = [("thatinn",), ("rewhh",), ("oof",), ("wiht",), ("zzzzzz",), ("the",)]
register("x15_did_you_mean", f"""v AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\\pL\\pM\\pN_]+')) AS token FROM paras) WHERE length(token) >= 3 GROUP BY 1),
w AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x, in _WORDS)}) x(word)), r AS (SELECT word, token AS suggestion, CAST(levenshtein(word, token) AS INT) AS edits, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, token), n DESC, token) AS k
FROM w JOIN v ON substring(word, 1, 2) = substring(token, 1, 2) WHERE levenshtein(word, token) <= 2 AND word NOT IN (SELECT token FROM v)) SELECT word, suggestion, edits FROM r WHERE k = 1""")(lambda f: query_tables.did_you_mean(f.spark.createDataFrame(_WORDS, "word string"), X.token_table(f.paras).groupBy("token").agg(F.count("*").alias("n"))))
register("x16_year", "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INT) AS year FROM orders")(lambda f: f.raw("orders").select("o_orderkey", X.year_of(F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy') WHEN 1 THEN date_format(o_orderdate, 'd/M/yyyy') ELSE date_format(o_orderdate, 'yyyy-M-d') END")).alias("year")))
_ANY = lambda words: "(" + " OR ".join(f"contains(v, '{w}')" for w in words) + ")"
_RULE = "CASE " + " ".join(f"WHEN {_ANY(w)} THEN '{i}'" for w, i, _x in D.INTENTS) + " END"
_STUDY = "CASE " + " ".join(f"WHEN {_ANY(w)} THEN '{i}'" for w, i in D.STUDY_INTENTS) + " ELSE 'concept_explanation' END"
register("x17_intents", _Q + f""", t AS (SELECT query_id, lower(trim(query)) AS v FROM q), o AS (SELECT *, CASE WHEN {_ANY(D.TABLE_TRIGGERS)} THEN 'table' WHEN {_ANY(D.LAW_TRIGGERS)} THEN 'law' ELSE coalesce({_RULE}, 'hybrid') END AS output_type FROM t),
c AS (SELECT *, CASE WHEN output_type IN ('table', 'law') THEN 0 ELSE 0.3 END + CASE WHEN {_ANY(D.QUESTIONS)} THEN 0.3 ELSE 0 END AS s FROM o)
SELECT query_id, output_type, CAST(round(CASE WHEN contains(v, 'what is') THEN least(s, 0.5) ELSE s END, 2) AS DOUBLE) AS confidence, {_STUDY} AS study_type FROM c""")(lambda f: query_tables.intents(_asked(f)).select("query_id", "output_type", "confidence", "study_type"))
register("x18_enrichment")(lambda f: query_tables.enrich(_asked(f)).select("query_id", "corrected_query", "match_type", "rank_score", F.array_join("synonyms", ",").alias("synonyms"), F.size("sections").alias("n_sections")))
register("x19_chunks")(lambda f: ingest.chunk_documents(f.cases.select(F.col("case_id").alias("document_id"), F.col("judgment").alias("text")), separator="\n"))
register("x21_tokens", "SELECT case_id, token, count(*) AS n FROM (SELECT case_id, unnest(string_split_regex(lower(text), '[^\\pL\\pM\\pN_]+')) AS token FROM paras) WHERE token <> '' GROUP BY ALL")(lambda f: X.token_table(f.paras, "case_id").groupBy("case_id", "token").agg(F.count("*").alias("n")))

# Query tables
_MENTIONS = [(1, "small rng"), (2, "red widget"), (3, "blue"), (4, "what was held in the large ring"), (5, "court order"), (6, "widget")]


@register("j7_resolve_names")
def resolve(f: Fixtures) -> DataFrame:
    names = f.raw("part").select(F.col("p_partkey").cast("string").alias("case_id"), F.col("p_name").alias("case_name"))
    return query_tables.resolve_names(f.spark.createDataFrame(_MENTIONS, "mention_id int, mention string"), names)


register("j8_expansion", _Q + ", s AS (SELECT query_id, " + " || ".join(f"CASE WHEN contains(lower(query), '{k}') THEN [{', '.join(chr(39) + x + chr(39) for x in v)}] ELSE [] END" for k, v in D.SYNONYMS.items()) + " AS s FROM q) SELECT query_id, array_to_string(list_sort(list_distinct(s)), ',') AS synonyms FROM s")(lambda f: _with_synonyms(f))
_SHORT = "CASE CAST(case_id AS BIGINT) % 4 WHEN 0 THEN ' SC ' WHEN 1 THEN 'delhi hc' WHEN 2 THEN 'NGT' ELSE ' Other Court ' END"
register("j9_aliases", "SELECT case_id, CASE CAST(case_id AS BIGINT) % 4 WHEN 0 THEN 'Supreme Court of India' WHEN 1 THEN 'High Court of Delhi' WHEN 2 THEN 'National Green Tribunal' ELSE 'Other Court' END AS court FROM cases")(lambda f: f.cases.select("case_id", X.resolved(F.expr(_SHORT), D.COURT_ALIASES).alias("court")))
register("a12_log_statistics", "SELECT count(*) AS total, CAST(count_if(success) AS BIGINT) AS successes, round(count_if(success) / CAST(count(*) AS DOUBLE), 6) AS success_rate FROM query_log")(lambda f: query_tables.log_statistics(f.log).withColumn("success_rate", F.round("success_rate", 6)))
register("a12_log_patterns", "g AS (SELECT success, match_type, count(*) AS n FROM query_log GROUP BY success, match_type), r AS (SELECT *, row_number() OVER (PARTITION BY success ORDER BY n DESC, match_type) AS r FROM g) SELECT success, match_type, n FROM r WHERE NOT success OR r <= 5")(lambda f: query_tables.log_patterns(f.log))

# Queries about native terms, with a wording that depends on the row.
_NATIVE = """CASE query_id % 5 WHEN 0 THEN 'Election to the Gram Panchayath' WHEN 1 THEN 'TALUKA and Tehsil office' WHEN 2 THEN 'begari of a zamindar'
WHEN 3 THEN match_type ELSE 'mauza in the taluka' END"""


def _native(f: Fixtures) -> DataFrame:
    return f.log.select("query_id", F.expr(_NATIVE).alias("query"))


_TERM_CASES = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(v, {chr(39)}{w}{chr(39)})' for w in wordings)} THEN '{t}:{boost}' END" for t, (boost, wordings) in sorted(D.NATIVE_TERMS.items())
)
register(
    "j8_native_terms",
    f"""n AS (SELECT query_id, lower({_NATIVE}) AS v FROM query_log)
SELECT query_id, array_to_string(list_filter([{_TERM_CASES}], lambda x: x IS NOT NULL), ',') AS terms FROM n""",
)(
    lambda f: query_tables.boosted_terms(_native(f)).select(
        "query_id",
        F.array_join(F.transform("native_terms", lambda t: F.concat_ws(":", t["term"], t["boost"].cast("string"))), ",").alias("terms"),
    )
)
_REWRITES = ", ".join(f"CASE WHEN contains(lower(q), '{k}') THEN replace(lower(q), '{k}', '{v}') END" for k, vs in D.TRANSLITERATIONS.items() for v in vs)
register(
    "j8_spellings",
    f"""n AS (SELECT query_id, {_NATIVE} AS q FROM query_log), u AS (SELECT DISTINCT query_id, unnest([q, {_REWRITES}]) AS spelling FROM n)
SELECT query_id, spelling FROM u WHERE spelling IS NOT NULL""",
)(lambda f: query_tables.spellings(_native(f)).select("query_id", F.explode("spellings").alias("spelling")))
_SUGGESTED = "SELECT match_type || CAST(user_id % 50 AS VARCHAR) AS misspelling, match_type AS correction, CAST(results_count % 10 AS DOUBLE) / 10 AS confidence, query_id AS seen FROM query_log"
register(
    "a12_corrections",
    f"""g AS ({_SUGGESTED}), r AS (SELECT *, row_number() OVER (PARTITION BY misspelling ORDER BY seen DESC) AS k, count(*) OVER (PARTITION BY misspelling) AS n FROM g)
SELECT misspelling, correction, confidence, n FROM r WHERE k = 1""",
)(
    lambda f: query_tables.learned_corrections(
        f.log.select(
            F.concat("match_type", (F.col("user_id") % 50).cast("string")).alias("misspelling"),
            F.col("match_type").alias("correction"),
            ((F.col("results_count") % 10).cast("double") / 10).alias("confidence"),
            F.col("query_id").alias("at"),
        )
    )
)
register("a6_corpus_counts", "SELECT (SELECT count(*) FROM cases) AS n_cases, (SELECT count(*) FROM paras) AS n_paragraphs, (SELECT count(*) FROM acts) AS n_acts")(
    lambda f: facets.corpus_counts(f.cases, f.paras, f.acts)
)

# Sources and incremental jobs
register("s3_upsert", "SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")(
    lambda f: (lambda rows: tables.upsert(rows.where("v <= 3"), rows.where("v > 3"), "k", F.col("v")))(f.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v")))
)
register("s4_insert_new", "SELECT DISTINCT paragraph_id FROM paras")(lambda f: (lambda p: tables.insert_new(p.where("para_no % 2 = 0"), p.union(p), "paragraph_id"))(f.paras.select("paragraph_id", "para_no")).select("paragraph_id"))
register("s5_json_map", _STATUS.split("z AS (")[0] + "k2 AS (SELECT case_id, kind, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL) SELECT case_id, kind, n FROM k2")(lambda f: citations.precedent_status(f.cases, f.cites).select("case_id", F.explode(tables.map_from_json(tables.map_to_json(F.col("treatment_counts")))).alias("kind", "n")))


@register("i1_incremental_status", _STATUS + f"SELECT case_id, status, strength, {_LABEL} AS label FROM v")
def incremental_status(f: Fixtures) -> DataFrame:
    """The table made of the edges before a time, refreshed for those since, equals the table computed anew.

    Cases that cite a target of a new edge are refreshed as well as the new edges' sources.
    """
    since = F.lit("1997-01-01").cast("timestamp_ntz")
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    edges = f.cites
    before = citations.precedent_status(f.cases, edges.where(F.col("created_at") < since)).withColumn("updated_at", F.lit("1997-01-01").cast("timestamp_ntz"))
    return incremental.refresh_since(before, f.cases, edges, since, now).select("case_id", "status", "strength", "label")
