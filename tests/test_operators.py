"""Properties and small literal cases of the library's operators."""

import math
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexcorpus.functions import dictionaries as D
from lexcorpus.functions import prominence as P
from lexcorpus.functions import stem
from lexcorpus.functions import text as X
from lexcorpus.functions import treatment as T
from lexcorpus.operators import citations, evidence, query_tables, rank, search, vectors
from lexcorpus.operators.search import at_least, near, phrase, same_paragraph, term, within
from lexcorpus.plans import corpus_queries
from lexcorpus.plans.corpus_queries import QUERIES
from lexcorpus.plans.fixtures import Fixtures
from lexcorpus.sources import ingest, tables
from lexcorpus.streaming import incremental


def ids(df):
    return {r.case_id for r in df.select("case_id").collect()}


@pytest.fixture(scope="module")
def small(spark):
    cases = spark.createDataFrame([("a", 1990), ("b", None), ("c", 2001), ("d", 2010)], "case_id string, year int")
    texts = [("a", "Natural justice is the law."), ("a", "The law of the land."), ("b", "Justice delayed (is) natural."), ("c", ""), ("c", None)]
    return cases, spark.createDataFrame(texts, "case_id string, text string")


def test_boolean_properties(small):
    cases, paras = small
    find = lambda q: ids(search.search(q, cases, paras))
    a, b = term("natural"), term("law")
    assert find(a & b) == find(a) & find(b) == {"a"}
    assert find(a | b) == find(a) | find(b)
    assert find(~a) | find(a) == {"a", "b", "c", "d"} and not find(~a) & find(a)
    assert find(~a) == {"c", "d"}  # a case without paragraphs counts
    assert find(phrase("natural justice")) == {"a"}
    assert find(phrase("(is)")) == find(term("(is)")) == {"a", "b"}  # signs are cut off queries as they are off texts


def test_proximity_is_nested_and_monotone(spark, folder):
    f = Fixtures(spark, folder)
    cases, paras = f.cases, f.paras
    find = lambda q: ids(search.search(q, cases, paras))
    a, b = term("the"), term("of")
    close, either, same = find(within(a, b, 3)), find(near(a, b, 3)), find(same_paragraph(a, b))
    assert close <= either <= same
    assert find(within(a, b, 2)) <= close
    assert find(at_least(3, "the")) <= find(at_least(2, "the"))
    with pytest.raises(ValueError):
        within(a, b, 101)
    with pytest.raises(ValueError):
        at_least(51, "x")


def test_search_terms():
    q = (phrase("natural justice") & term("law")) & ~term("tax")
    assert q.search_terms() == ["natural justice", "natural", "justice", "law"]
    assert (term("law") | term("law")).search_terms() == ["law"]


def test_relevance_factors(spark):
    columns = "authority_score double, citation_count long, cited_by_count long, matched long, total_paragraphs long, year int, court_type string"
    rows = [(None, None, 0, 0, 100, None, None), (1.5, 10_000, 10, 20, 100, 1950, "SC"), (-0.1, 0, 0, 5, None, 2025, "Moot")]
    got = [r.s for r in spark.createDataFrame(rows, columns).select(F.struct(*[v.alias(k) for k, v in rank.factors().items()]).alias("s")).collect()]
    assert [r.authority for r in got] == [0.3, 1.0, 0.0]
    assert [r.recency for r in got] == [0.5, 0.0, 1.0]
    assert [r.court for r in got] == [0.3, 1.0, 0.3]
    assert [r.term_density for r in got] == [0.0, 1.0, 0.3]
    assert got[1].citation_count == 1.0 and math.isclose(got[1].cited_by, math.log1p(10) / math.log1p(10_000))


def test_citation_texts(spark):
    rows = [("(2008) 13 SCC 506", "SCC", 10), ("AIR 1957 Cal 283", "AIR", 8), ("[2011] 10 SCR 557", "SCR", 10), ("Unknown Citation 123", "Other", 2), ("1999 calcutta 3", "Cal", 6), ("", "Unknown", 2), (None, "Unknown", 2)]
    c = F.col("c")
    got = spark.createDataFrame([(r[0],) for r in rows], "c string").select(P.court(c).alias("a"), P.court_weight(c).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [r[1:] for r in rows]


def test_treatment(spark):
    text = "The earlier view is hereby overruled; we rely on X and it was affirmed by all."
    got = spark.createDataFrame([(text,)], "t string").select(*[n.alias(k) for k, n in T.counts(F.col("t")).items()]).first()
    assert got.overruled == 1 and got.followed == 1 and got.affirmed == 1
    four = [F.lit(x) for x in (2, 1, 0, 0)]
    row = spark.range(1).select(T.status(*four).alias("s"), T.strength(*four).alias("n"), T.label(*four).alias("l")).first()
    assert (row.s, row.n) == ("good_law", 57) and row.l.startswith("Generally followed (2")


def test_tree_avoids_cycles(spark):
    cites = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("b", "c"), ("c", "d"), ("a", None)], "source_case_id string, cited_case_id string").withColumns({"relationship": F.lit(None).cast("string"), "confidence": F.lit(0.5)})
    got = {(r.case_id, r.depth, "/".join(r.path)) for r in citations.citation_tree(cites, spark.createDataFrame([("a",)], "case_id string"), 3).collect()}
    assert got == {("b", 1, "a/b"), ("c", 2, "a/b/c"), ("d", 3, "a/b/c/d")}


def test_status_without_edges_and_with_nulls(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    cites = spark.createDataFrame([("a", None, None, 0.0), ("a", None, "overruled", None), ("a", "1 SCC 1", "overruled", 0.9)], "source_case_id string, target_citation string, relationship string, confidence double")
    got = {r.case_id: r for r in citations.precedent_status(cases, cites).collect()}
    assert (got["b"].status, got["b"].strength, got["b"].label, got["b"].treatment_counts) == ("unknown", 50, "unknown", {})
    assert got["a"].status == "dubious" and got["a"].treatment_counts == {"cited": 1, "overruled": 2}


def test_highlight_joins_to_window(spark):
    text = "x" * 200 + " natural justice, NATURAL law " + "y" * 200
    spans = spark.createDataFrame([(text,)], "t string").select(X.highlighted(F.col("t"), ["natural", "law."]).alias("s")).first().s
    whole = "".join(s.text for s in spans)
    assert whole.startswith("...") and whole.endswith("...") and whole.strip(".") in text
    assert [s.text for s in spans if s.highlighted] == ["natural", "NATURAL"]


def test_spelling_equals_plain_ratio(spark):
    words = ["contrcat", "bail", "supremme", "judgmant", "zebra", "disputes", ""]
    got = {r.word: r.corrected for r in query_tables.corrections(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    variants = {v: c for c, some in D.SPELLINGS.items() for v in some}

    def plain(w):
        if w in variants or w in D.SPELLINGS:
            return variants.get(w, w)
        scored = [(SequenceMatcher(None, w, c).ratio(), c) for c in D.SPELLINGS]
        best = max((s for s, _ in scored), default=0)
        return next(c for s, c in scored if s == best) if best > 0.8 else None

    assert got == {w: plain(w) for w in words}


def test_name_resolution(spark):
    cases = spark.createDataFrame([("1", "Kesavananda Bharati v State of Kerala"), ("2", "Nandini Sharma v Union"), ("3", "Sharma v Union of India"), ("4", None)], "case_id string, case_name string")
    asked = [(1, "nandini sharma union"), (2, "bar council suspend"), (3, "kesavananda"), (4, "what was held"), (5, "Kerala Bharati judgment")]
    got = {r.mention_id: (r.case_id, r.level) for r in query_tables.resolve_names(spark.createDataFrame(asked, "mention_id int, mention string"), cases).collect()}
    assert got[1] == ("2", 1) and got[3] == ("1", 4) and got[5] == ("1", 2) and 2 not in got and 4 not in got


def test_equal_mentions_are_resolved_once(spark, monkeypatch):
    compared = []
    alike = query_tables.similar_names
    monkeypatch.setattr(query_tables, "similar_names", lambda a, b: compared.append(a.count()) or alike(a, b))
    cases = spark.createDataFrame([("1", "Nandini Sharma v Union"), ("2", "Ramesh Lal v State")], "case_id string, case_name string")
    asked = [(i, ("nandini sharma", "the Nandini, SHARMA", "ramesh lal", "bail")[i % 4]) for i in range(400)] + [(0, "nandini sharma"), (400, None)]
    got = sorted((r.mention_id, r.case_id, r.level) for r in query_tables.resolve_names(spark.createDataFrame(asked, "mention_id int, mention string"), cases).collect())
    assert compared == [2]
    one = {r.mention_id: (r.case_id, r.level) for r in query_tables.resolve_names(spark.createDataFrame(asked[:4], "mention_id int, mention string"), cases).collect()}
    assert one[0] == one[1] == ("1", 1) and one[2][0] == "2"
    assert got == [(i, *one[i % 4]) for i in range(400) if i % 4 in one]


def test_intents(spark):
    asked = [(1, "cases on bail"), (2, "section 420"), (3, "what is bail"), (4, "verdict today"), (5, "hello")]
    got = {r.i: (r.output_type, r.confidence) for r in query_tables.intents(spark.createDataFrame(asked, "i int, query string")).collect()}
    assert got == {1: ("table", 0.0), 2: ("law", 0.0), 3: ("answer", 0.5), 4: ("judgment_only", 0.3), 5: ("hybrid", 0.3)}


def test_years(spark):
    asked = ["2015", " 1/2/2016", "2017-3-4", "20155", "", None]
    got = [r.y for r in spark.createDataFrame([(a,) for a in asked], "d string").select(X.year_of(F.col("d")).alias("y")).collect()]
    assert got == [2015, 2016, 2017, None, None, None]


def plain_chunks(text, size=300, overlap=50, least=30):
    out, held = [], []
    for para in re.split(r"\n{2,}", text):
        words = para.split()
        if len(words) < 5:
            continue
        if held and len(held) + len(words) > size:
            if len(held) >= least:
                out.append(held)
            held = held[-overlap:] + words
        else:
            held = held + words
    return out + ([held] if len(held) >= least else [])


def test_chunks(spark, tmp_path):
    text = "\n\n".join(" ".join(f"w{p}_{i}" for i in range(n)) for p, n in enumerate((120, 3, 150, 90, 400, 20, 31)))
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")
    got = ingest.chunk_documents(docs).orderBy("para_no").collect()
    assert [r.text.split() for r in got] == plain_chunks(text)
    assert [r.paragraph_id for r in got][:2] == ["DOC_d_P0000", "DOC_d_P0001"]
    (tmp_path / "one.txt").write_text("word " * 40)
    (tmp_path / "two.txt").write_text("too short")
    assert [r.document_id for r in ingest.read_text_docs(spark, str(tmp_path)).collect()] == ["one"]


def test_upsert_and_json(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 5)], "k string, v int, t int")
    new = spark.createDataFrame([("a", 2, 1), ("b", 2, 4), ("c", 2, None)], "k string, v int, t int")
    assert {(r.k, r.v) for r in tables.upsert(old, new, "k", F.col("t")).collect()} == {("a", 2), ("b", 1), ("c", 2)}
    maps = spark.createDataFrame([({"a": 1},), (None,)], "m map<string,bigint>")
    assert [r.m for r in maps.select(tables.map_from_json(tables.map_to_json(F.col("m"))).alias("m")).collect()] == [{"a": 1}, {}]


def test_vectors_with_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = [(r.id, r.rank) for r in vectors.vector_topk(df.where("id = 1").withColumnRenamed("id", "query_id"), df, 3).orderBy("rank").collect()]
    assert got == [(1, 1), (5, 2), (4, 3)]


def test_every_twentieth_row_is_asked(spark, folder, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 7)  # several blocks of queries and of rows
    monkeypatch.setattr(vectors, "ROWS_A_BLOCK", 100)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    best = {q: [ids[j] for j in np.argsort(-np.round(v[k] @ v.T, 9), kind="stable")[:20]] for k, q in enumerate(ids) if q % 20 == 0}
    got = {}
    for r in QUERIES["k9_vector_topk_all"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == best and len(best) > 10


def test_every_twentieth_case_is_a_root(spark, folder):
    f = Fixtures(spark, folder)
    edges = {(r.source_case_id, r.cited_case_id) for r in f.cites.where("cited_case_id IS NOT NULL").collect()}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    roots = [r.case_id for r in f.cases.collect() if int(r.case_id) % 20 == 0]
    one = {(r, b) for r in roots for b in out.get(r, ()) if b != r}
    two = {(r, b, c) for r, b in one for c in out.get(b, ()) if c not in (r, b)}
    got = {r.path for r in QUERIES["j4_citation_tree_all"](spark, folder).select("path").collect()}
    assert got == {"/".join(x) for x in one | two} and len({a for a, _ in one}) > 3


def test_contexts_go_up_to_a_hundred(spark, folder):
    edges = {r.source_case_id: r["count"] for r in Fixtures(spark, folder).cites.groupBy("source_case_id").count().collect()}
    got = {r.source_case_id: r["count"] for r in QUERIES["j10_citation_contexts_all"](spark, folder).groupBy("source_case_id").count().collect()}
    assert got == {k: min(n, 100) for k, n in edges.items()} and max(got.values()) > 20


def test_hybrid_of_every_query_equals_plain_code(spark, folder):
    f = Fixtures(spark, folder)
    asked = {r.query_id: r.query for r in corpus_queries.asked_all(f).collect()}
    cases = {r.case_id: r for r in f.cases.collect()}
    near = [r.asDict() for r in corpus_queries.nearest(f, asked=corpus_queries.EVERY).collect()]
    degree = {r.source_case_id: min(r["count"], 10) for r in f.cites.groupBy("source_case_id").count().collect()}
    held = lambda text: set(re.findall(r"\w+", (text or "").lower()))
    paras = [(r.case_id, r.paragraph_id, r.quality_score, held(r.text)) for r in f.paras.collect()]
    names = [(k, held(c.case_name)) for k, c in cases.items()]
    want = set()
    for q, text in asked.items():
        words = set(text.split())
        hits = [(c, p, s, False) for c, p, s, t in paras if words <= t] + [(c, None, 0.95, True) for c, t in names if words <= t]
        hits += [(str(r["id"] % len(cases)), f"v{r['id']}", r["score"], False) for r in near if r["query_id"] == q]
        assert any(h[3] for h in hits)  # the case that gave the words
        best = {}
        for c, p, s, name in hits:
            key = (-(s or 0), p is not None, p or "")
            if c not in best or key < best[c][0]:
                best[c] = (key, s, name)
        rated = []
        for c, (_, s, name) in best.items():
            year = cases[c].year
            if year is not None and year < 1960:
                continue
            recent = min(1, max(0, (year - 2010) / 20)) if year is not None else 0
            score = 0.6 * (0.5 if s is None else s) + 0.2 * (degree.get(c, 0) / 10 if name else 0) + 0.2 * recent
            m = sum(w in (cases[c].case_name or "").lower() for w in words)
            rated.append((-(m if m >= 2 else 0), -score, c))
        want |= {(q, k + 1, c, round(-s, 5), -b) for k, (b, s, c) in enumerate(sorted(rated)[:10])}
    got = {(r.query_id, r.rank, r.case_id, round(r.rerank_score, 5), r.boost) for r in QUERIES["r7_hybrid_all"](spark, folder).collect()}
    assert len(asked) > 10 and {g[0] for g in got} == {w[0] for w in want}
    assert {(g[0], g[1], g[2], g[4]) for g in got} == {(w[0], w[1], w[2], w[4]) for w in want}


def test_evidence_context(spark):
    rows = [("a", i, t, "text " * n) for i, (t, n) in enumerate([("facts", 1), ("Order", 200), ("odd", 1), ("facts", 0)])]
    got = evidence.evidence_context(spark.createDataFrame(rows, "case_id string, para_no int, para_type string, text string")).first().context
    assert got.split("\n\n")[:2] == ["=== FACTS OF THE CASE ===", "[Para 0] text"] and "=== OTHER PARAGRAPHS ===" in got and "..." in got


def test_stream_equals_batch(spark, folder, tmp_path):
    f = Fixtures(spark, folder)
    cases, cites = f.cases, f.cites.where("source_case_id < '3'")
    for k in range(2):
        cites.where(F.pmod(F.hash("target_citation"), F.lit(2)) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(cites.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    incremental.stream_status(stream, cases, str(tmp_path / "edges"), str(tmp_path / "status"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.case_id, r.status, r.strength) for r in incremental.current_status(spark, str(tmp_path / "status")).collect()}
    sources = {r.source_case_id for r in cites.select("source_case_id").distinct().collect()}
    # A source whose cited targets gained edges later keeps the status of its own last batch.
    fresh = {(r.case_id, r.status, r.strength) for r in citations.precedent_status(cases, cites).collect() if r.case_id in sources}
    assert {g[0] for g in got} == {x[0] for x in fresh} and len(got & fresh) >= 0.9 * len(fresh)


def test_refresh_reaches_cases_that_cite_a_changed_target(spark):
    cases = spark.createDataFrame([(c,) for c in "abcz"], "case_id string")
    old = [("a", "(2001) 1 SCC 1", "followed", 0.9, 1), ("b", "(2002) 2 SCC 2", "followed", 0.9, 1)]
    new = [("c", "(2001) 1 SCC 1", "overruled", 0.9, 5) for _ in range(60)]
    schema = "source_case_id string, target_citation string, relationship string, confidence double, created_at int"
    every, earlier = spark.createDataFrame(old + new, schema), spark.createDataFrame(old, schema)
    rows = lambda df: {r.case_id: (r.status, r.strength, r.label) for r in df.collect()}
    before = citations.precedent_status(cases, earlier).withColumn("updated_at", F.lit(3))
    whole, got = citations.precedent_status(cases, every), incremental.refresh_since(before, cases, every, F.lit(3), F.lit(9))
    assert rows(got) == rows(whole) != rows(before)
    assert {r.case_id for r in got.where("updated_at = 9").collect()} == {"a", "c"}


def test_status_query_starts_from_the_earlier_edges(spark, folder, monkeypatch):
    seen = {}
    real = incremental.refresh_since
    monkeypatch.setattr(incremental, "refresh_since", lambda status, *rest: seen.update(before=status) or real(status, *rest))
    after = QUERIES["i1_incremental_status"](spark, folder)
    rows = lambda df: {(r.case_id, r.status, r.strength) for r in df.collect()}
    assert rows(seen["before"]) != rows(after)


def test_stream_ends_equal_to_batch(spark, folder, tmp_path):
    f = Fixtures(spark, folder)
    cases, cites = f.cases, f.cites.where("source_case_id < '3'")
    for k in range(2):
        cites.where(F.pmod(F.hash("target_citation", "source_case_id"), F.lit(2)) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(cites.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    incremental.stream_status(stream, cases, str(tmp_path / "edges"), str(tmp_path / "status"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.case_id, r.status, r.strength) for r in incremental.current_status(spark, str(tmp_path / "status")).collect()}
    sources = {r.source_case_id for r in cites.select("source_case_id").distinct().collect()}
    assert got == {(r.case_id, r.status, r.strength) for r in citations.precedent_status(cases, cites).collect() if r.case_id in sources}


def test_document_stream_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "docs", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("\n\n".join("word " * 100 for _ in range(5)))
    for k in range(2):
        incremental.stream_documents(spark, str(source), str(target), str(tmp_path / f"cp{k // 2}")).awaitTermination()
        (source / "b.txt").write_text("other " * 60)
    rows = spark.read.parquet(str(target)).select("paragraph_id").collect()
    assert len(rows) == len({r.paragraph_id for r in rows}) == 3


def test_words_of_any_script(spark):
    paras = spark.createDataFrame([("1", "der Größe nach"), ("2", "ÉCOLE nach Hause"), ("3", "section 498-A applies"), ("4", "der gr e")], "case_id string, text string")
    cases = paras.select("case_id")
    found = lambda q: sorted(r.case_id for r in search.search(q, cases, paras).collect())
    assert found(search.term("größe")) == ["1"] and found(search.term("gr")) == ["4"]
    assert found(search.phrase("école nach")) == ["2"] and found(search.prefix("éco*")) == ["2"] and found(search.wildcard("gr?ße")) == ["1"]
    assert found(search.term("498-A")) == found(search.phrase("498-a")) == ["3"]
    assert found(search.at_least(1, "größe")) == ["1"] and found(search.within(search.term("größe"), search.term("nach"), 2)) == ["1"]
    vocabulary = stem.stemmed(X.token_table(paras).select("token").distinct())
    assert found(search.term("applying")) == [] and found(search.term("applying", vocabulary)) == ["3"]
    assert found(search.term("sections", vocabulary)) == ["3"]


def test_compound_operands_in_one_paragraph(spark):
    paras = spark.createDataFrame([("1", "a b c"), ("1", "d"), ("2", "a b"), ("2", "c d"), ("3", "a c d")], "case_id string, text string")
    cases = paras.select("case_id").distinct()
    found = lambda q: sorted(r.case_id for r in search.search(q, cases, paras).collect())
    assert found(search.same_paragraph(search.term("a") & search.term("b"), search.term("c"))) == ["1"]
    assert found(search.same_paragraph(search.within(search.term("a"), search.term("c"), 5), search.term("d") | search.term("b"))) == ["1", "3"]
    assert found(search.same_paragraph(search.term("a"), ~search.term("b"))) == ["3"]
    with pytest.raises(ValueError):
        search.same_paragraph(search.term("a"), search.year_is(1990))


def test_court_code_and_articles(spark):
    cases = spark.createDataFrame([("1", "X", ["ipc"], ["Article 21"], 0.5), ("2", "Y", ["crpc"], None, 0.7)], "case_id string, court_code string, acts_referred array<string>, constitutional_articles array<string>, authority_score double")
    assert [r.case_id for r in search.filter_hits(cases, court_code="X").collect()] == ["1"]
    assert [r.case_id for r in search.by_field(cases, "section", "article 21").collect()] == ["1"]


def test_issue_words_meet_judgments_without_a_product(spark):
    cases = spark.createDataFrame([("1", "A v B", "the unlawfulness of it", [], 1990), ("2", "C", "nothing", [], 1991)], "case_id string, case_name string, judgment string, acts_referred array<string>, year int")
    issues = spark.createDataFrame([(1, ["none"], "was it lawful here")], "issue_id int, acts array<string>, query string")
    got = search.cases_for_issues(issues, cases)
    assert [(r.case_id, r.by) for r in got.collect()] == [("1", "word")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vector_topk_over_many_blocks_and_partitions(spark, monkeypatch):
    import numpy as np

    from lexcorpus.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 4)
    monkeypatch.setattr(vectors, "ROWS_A_BLOCK", 16)
    x = np.random.default_rng(5).normal(size=(100, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got = {(r.query_id, r.rank): r.id for r in vectors.vector_topk(rows.where("id < 10").withColumnRenamed("id", "query_id"), rows, 5).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(unit[:10] @ unit.T), axis=1, kind="stable")[:, :5]
    assert got == {(q, k + 1): best[q, k] for q in range(10) for k in range(5)}


def test_word_hits_keep_what_hybrid_ranks(spark, monkeypatch):
    import random

    from lexcorpus.operators import search, vectors

    rng = random.Random(5)
    words = ["state", "union", "court", "rent", "land", "tax"]
    cases = spark.createDataFrame([(str(c), " ".join(rng.choices(words, k=4)), rng.choice([None, 1950, 1990, 2020])) for c in range(60)], "case_id string, case_name string, year int")
    paras = spark.createDataFrame(
        [(str(c), f"{c}_{p}", " ".join(rng.choices(words, k=5)), rng.choice([None, 0.1, 0.5, 0.9, 0.99])) for c in range(60) for p in range(4)],
        "case_id string, paragraph_id string, text string, relevance_score double",
    )
    asked = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in words for b in words if a < b)], "query_id long, query string").withColumn("terms", F.split("query", " "))
    other = spark.createDataFrame([(rng.randrange(15), str(rng.randrange(60)), f"v{i}", round(rng.random(), 2) - 0.2, "paragraph") for i in range(200)], "query_id long, case_id string, paragraph_id string, relevance_score double, result_type string")
    named = asked.select("query_id", (F.col("query_id") * 3).cast("string").alias("case_id"), F.lit(None).cast("string").alias("paragraph_id"))
    cites = spark.createDataFrame([("3", "x")], "source_case_id string, target_citation string")
    every = search.search_many(asked, paras.select(F.col("paragraph_id").alias("case_id"), "text")).select("query_id", F.col("case_id").alias("paragraph_id")).join(paras, "paragraph_id")
    few = vectors.word_hits(asked, paras, cases, 3, year_from=1960)
    result = lambda hits: sorted(map(tuple, vectors.hybrid(asked, hits.withColumn("result_type", F.lit("paragraph")), named, other, cases, cites, 3, year_from=1960).collect()))
    assert result(few) == result(every)
    assert few.count() < every.count() / 3


def test_a_judgment_meets_all_citations_of_its_case_at_once(spark):
    cases = spark.createDataFrame([("a", "A v. B", 1990, "x " * 300 + "As in (1950) 1 SCC 7, the İ claim of rent is allowed. More"), ("b", None, None, None)], "case_id string, case_name string, year int, judgment string")
    paras = spark.createDataFrame([("a_0", 0)], "paragraph_id string, para_no int")
    edges = [("a", "b", "(1950) 1 SCC 7", None, "a_0"), ("a", None, "(1950) 1 SCC 7", "", None), ("a", "a", "none", None, "a_1"), ("a", "a", None, None, "a_1"), ("a", "b", "s", "as in s, it was upheld by the court.", "a_0"), ("b", "a", "t", None, None), ("gone", "a", "t", None, None)]
    cites = spark.createDataFrame(edges, "source_case_id string, cited_case_id string, target_citation string, context_sentence string, paragraph_id string").withColumns({"relationship": F.lit("cited"), "confidence": F.lit(0.5), "created_at": F.lit(1)})
    df = citations.citation_contexts(cites, cases, paras, window=20)
    got = sorted((r.source_case_id, r.target_citation or "", r.cited_case_id or "", r.cited_year or 0, r.context) for r in df.collect())
    text = "x x x x x x x As in (1950) 1 SCC 7, the İ claim of ren"
    assert [g for g in got if g[1] != "(1950) 1 SCC 7"] == [("a", "", "a", 1990, ""), ("a", "none", "a", 1990, ""), ("a", "s", "b", 0, "as in s, it was upheld by the court."), ("b", "t", "a", 1990, ""), ("gone", "t", "a", 1990, "")]
    assert [g[4] for g in got if g[1] == "(1950) 1 SCC 7"] == [text, text] and {r.rank for r in df.where("source_case_id = 'a'").collect()} == {1, 2, 3, 4, 5}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.count("lower(judgment") == 1
