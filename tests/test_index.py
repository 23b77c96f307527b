"""The saved index, positions, the English analysis and the joins of alike strings, against patterns and plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexcorpus.functions import stem
from lexcorpus.functions import text as X
from lexcorpus.operators import postings, query_tables, search, similarity
from lexcorpus.operators.search import at_least, field_contains, near, phrase, prefix, same_sentence, term, wildcard, within
from lexcorpus.plans import index_queries
from lexcorpus.plans.fixtures import Fixtures


@pytest.fixture(scope="module")
def index(spark, folder):
    return index_queries.indexed(Fixtures(spark, folder))


# Words


def test_marks_belong_to_words(spark):
    paras = spark.createDataFrame([("1", "न्याय पालिका की धारा"), ("2", "न्य अन्य"), ("3", "café noir")], "case_id string, text string")
    assert [r.w for r in paras.select(X.tokens(F.col("text")).alias("w")).collect()] == [["न्याय", "पालिका", "की", "धारा"], ["न्य", "अन्य"], ["café", "noir"]]
    assert X.words_of("न्याय पालिका") == ["न्याय", "पालिका"]
    found = lambda q: sorted(r.case_id for r in search.search(q, paras.select("case_id"), paras).collect())
    assert found(term("न्याय")) == ["1"] and found(term("न्य")) == ["2"] and found(phrase("पालिका की")) == ["1"]
    assert found(prefix("न्य*")) == ["1", "2"] and found(within(term("न्याय"), term("धारा"), 3)) == ["1"] and found(at_least(1, "न्य")) == ["2"]
    assert found(term("cafe")) == [] and found(term("café")) == ["3"]
    assert query_tables.name_words(F.col("text")) is not None
    names = spark.createDataFrame([("Müller Größe",), ("न्याय पालिका",)], "m string").select(query_tables.name_words(F.col("m")).alias("w")).collect()
    assert [r.w for r in names] == [["müller", "größe"], ["न्याय", "पालिका"]]


@pytest.mark.parametrize("make", [term, phrase, prefix, wildcard, lambda w: at_least(2, w), lambda w: search.name_has("case_name", w)])
@pytest.mark.parametrize("operand", ["", " ", "--", "*", "!", "(?)"])
def test_operands_without_a_word_are_refused(make, operand):
    with pytest.raises(ValueError, match="no word"):
        make(operand)


# English


PUBLISHED = """consign consigned:consign consigning:consign consignment:consign consist consisted:consist consistency:consist
consistent:consist consistently:consist consisting:consist consists:consist consolation:consol consolations:consol consolatory:consolatori
console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid consolidating:consolid consoling:consol
consolingly:consol consols:consol consonant:conson consort consorted:consort consorting:consort conspicuous:conspicu
conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir
conspiring:conspir constable:constabl constables:constabl constance:constanc constancy:constanc constant knack knackeries:knackeri
knacks:knack knag knave knaves:knave knavish kneaded:knead kneading:knead knee kneel kneeled:kneel kneeling:kneel kneels:kneel
knees:knee knell knelt knew knick knif knife knight knightly:knight knights:knight knit knits:knit knitted:knit knitting:knit
knives:knive knob knobs:knob knock knocked:knock knocker knockers:knocker knocking:knock knocks:knock knopp knot knots:knot"""


def test_stems_equal_the_published_sample(spark, duck):
    pairs = [(p.split(":")[0], p.split(":")[-1]) for p in PUBLISHED.split()]
    rules = "skies:sky dying:die news:news inning:inning proceed:proceed generously:generous communism:communism hopping:hop hoping:hope ties:tie cries:cri gas:gas gaps:gap agreed:agre feed:feed luxuriated:luxuri bled:bled sayyid:sayyid enjoy:enjoy happy:happi by:by say:say youth:youth"
    rules += " rational:ration relational:relat analogy:analog fluently:fluentli formative:format adoption:adopt controll:control rate:rate cease:ceas abc_ing:abc_ing 2ing:2ing größen:größen is:is"
    pairs += [tuple(p.split(":")) for p in rules.split()]
    df = spark.createDataFrame([(a, 1) for a, _ in pairs] + [(None, 2)], "token string, stem int")
    got = {r.token: r.stem for r in stem.stemmed(df).collect()}
    wanted = dict(pairs) | {"fluently": "fluentli" if got["fluently"] == "fluentli" else "fluent", None: None}
    assert got == wanted
    sql = dict(duck.execute(stem.oracle("SELECT * FROM (VALUES " + ",".join(f"('{a}')" for a, _ in pairs) + ") x(token)")).fetchall())
    assert sql == {k: v for k, v in got.items() if k}


def test_english_terms_and_phrases(spark):
    paras = spark.createDataFrame([("1", "The court applied several sections."), ("2", "application of the section"), ("3", "rules of law apply"), ("4", "rule and law")], "case_id string, text string")
    vocabulary = stem.stemmed(X.token_table(paras).select("token").distinct())
    found = lambda q: sorted(r.case_id for r in search.search(q, paras.select("case_id"), paras).collect())
    assert found(term("applying", vocabulary)) == ["1", "3"] and found(term("the sections", vocabulary)) == ["1", "2"]
    assert found(phrase("rule of the law", vocabulary)) == [] and found(phrase("rules of laws", vocabulary)) == ["3", "4"]
    assert found(phrase("the rule", vocabulary)) == ["3", "4"]
    for make in (term, phrase):
        with pytest.raises(ValueError, match="stop words"):
            make("of the", vocabulary)


# The index


def test_postings_hold_every_word_with_its_place(spark):
    paras = spark.createDataFrame([("a", 0, " The-the, the\nOF"), ("a", 1, None), ("b", 0, "")], "case_id string, para_no int, text string")
    made = postings.build(paras, "small_postings", 2)
    got = {(r.token, r.case_id, r.para_no): [(p >> 2, p & 3) for p in r.positions] for r in made.postings.collect()}
    assert got == {("the", "a", 0): [(1, 0), (1, 1), (2, 3)], ("of", "a", 0): [(3, 3)]}
    assert {(r.token, r.n, r.stem) for r in made.words.collect()} == {("the", 1, "the"), ("of", 1, "of")}
    none = postings.build(paras.limit(0), "no_postings", 2)
    assert none.postings.count() == none.words.count() == 0
    asked = spark.createDataFrame([(1, ["the"])], "query_id int, terms array<string>")
    assert postings.search_many(asked, none).count() == 0
    again = postings.build(paras.where("case_id = 'b'"), "small_postings", 2)
    assert again.postings.count() == 0


def test_index_equals_the_scan(spark, folder, index):
    f = Fixtures(spark, folder)
    asked = index_queries.searches(f).select("query_id", "terms").union(spark.createDataFrame([(-1, ["the", "THE", "of"]), (-2, []), (-3, ["nosuchword"]), (-4, ["the", "nosuchword"])], "query_id int, terms array<string>"))
    for share in (1.0, 0.6):
        a, b = postings.search_many(asked, index, share).collect(), search.search_many(asked, f.paras, share).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 100


def test_common_words_lie_in_several_slots(spark, folder, index):
    parts = {r.token: r.parts for r in index.common.collect()}
    assert parts["the"] > 3 and len(parts) <= postings.COMMON
    slots = index.postings.where("token = 'the'").groupBy("slot").count().collect()
    assert len(slots) > 3
    assert index.postings.where("token = 'the'").groupBy("case_id").agg(F.count_distinct("slot").alias("n")).where("n > 1").count() == 0
    buckets = spark.sql(f"DESCRIBE EXTENDED {index.name}").where("col_name in ('Num Buckets', 'Bucket Columns')").collect()
    assert {r.data_type for r in buckets} == {"8", "[`slot`]"}


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _branch_shuffles(plan, table):
    """Whether an exchange stands between the scan of `table` and the first join above it."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan" in line and table in line)
    depth = lambda line: len(line) - len(line.lstrip(" +-:*0123456789()"))
    here = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            if "Join" in line:
                return False
            if "Exchange" in line:
                return True
    return False


def test_searches_do_not_shuffle_the_postings(spark, folder, index, monkeypatch):
    f = Fixtures(spark, folder)
    asked = index_queries.searches(f)
    for small, pruned in ((100_000, 1000), (0, 0)):  # broadcast and pruned; joined by buckets
        monkeypatch.setattr(postings, "SMALL", small)
        monkeypatch.setattr(postings, "PRUNED", pruned)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if not small else "10m")
        for df in (postings.search_many(asked, index), postings.proximity_many(asked, index)):
            plan = _plan(df)
            assert not _branch_shuffles(plan, index.name), plan
            assert ("BroadcastHashJoin" in plan) or not small
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(postings, "PRUNED", 1000)
    plan = _plan(postings.search_many(spark.createDataFrame([(1, ["rewh"])], "query_id int, terms array<string>"), index))
    assert "SelectedBucketsCount: 1 out of 8" in postings.search_many(spark.createDataFrame([(1, ["rewh"])], "query_id int, terms array<string>"), index)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), plan


def test_positions_equal_the_patterns(spark, folder, index):
    f = Fixtures(spark, folder)
    cases, paras = f.cases, f.paras
    cut = [("the", "of", 5, True), ("the", "of", 3, False), ("the", "the", 2, True), ("that the", "of", 4, True), ("of", "the and", 6, False), ("rewh", "nosuchword", 9, True), ("der", "und", 30, False), ("The", "OF", 1, True)]
    asked = spark.createDataFrame([(i, *c) for i, c in enumerate(cut)], "query_id int, left string, right string, n int, ordered boolean")
    got = {}
    for r in postings.proximity_many(asked, index).collect():
        got.setdefault(r.query_id, set()).add(r.case_id)
    for i, (a, b, n, ordered) in enumerate(cut):
        wanted = {r.case_id for r in search.search((within if ordered else near)(term(a), term(b), n), cases, paras).collect()}
        assert got.get(i, set()) == wanted, (a, b, n)
    assert {r.case_id for r in search.search(same_sentence(term("der"), term("und")), cases, paras).collect()} == got[6]


def test_positions_equal_the_patterns_on_odd_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "b", "c", "A-b", " ", "  ", "\n", ",", "a b", "b."], k=rng.randrange(25))) for _ in range(400)]
    paras = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "case_id string, para_no int, text string")
    index = postings.build(paras, "odd_postings", 2)
    cut = [(a, b, n, o) for a in ("a", "b", "a b") for b in ("a", "b", "b c") for n in (1, 2, 4) for o in (True, False)]
    asked = spark.createDataFrame([(i, *c) for i, c in enumerate(cut)], "query_id int, left string, right string, n int, ordered boolean")
    got = {(r.query_id, r.case_id) for r in postings.proximity_many(asked, index).collect()}
    begin, end, whole = X.BEGIN.replace(X.LETTER, r"\w"), X.END.replace(X.LETTER, r"\w"), lambda words: r"\s+".join(rf"(?<!\w){w}(?!\w)" for w in words.split())
    assert begin and end
    wanted = set()
    for i, (a, b, n, ordered) in enumerate(cut):
        for x, y in [(a, b)] if ordered else [(a, b), (b, a)]:
            pattern = re.compile(rf"{whole(x)}(?:\s+\S+){{0,{n - 1}}}\s+{whole(y)}", re.I)
            wanted |= {(i, str(k)) for k, t in enumerate(texts) if pattern.search(t)}
    assert got == wanted
    for n in (0, 101, None):
        with pytest.raises(Exception, match="from 1 to 100"):
            postings.proximity_many(asked.withColumn("n", F.lit(n).cast("int")), index).collect()
    assert postings.proximity_many(asked.withColumn("left", F.lit("--")), index).count() == 0


def test_searches_by_distance_take_cases_in_parts(spark, monkeypatch):
    rng = random.Random(11)
    texts = {(c, p): " ".join(rng.choices(["a", "b", "c", "a-b", "d."], k=rng.randrange(1, 9))) for c in range(25) for p in range(4)}
    index = postings.build(spark.createDataFrame([(str(c), p, t) for (c, p), t in texts.items()], "case_id string, para_no int, text string"), "part_postings", 2)
    cut = [(i, a, b, n, o) for i, (a, b, n, o) in enumerate((a, b, n, o) for a in ("a", "b", "c d") for b in ("a", "c", "d a") for n in (1, 3) for o in (True, False))]
    asked = spark.createDataFrame([*cut, *cut[:3]], "query_id int, left string, right string, n int, ordered boolean")
    monkeypatch.setattr(postings, "CELLS_AT_ONCE", 3)
    monkeypatch.setattr(postings, "PAIRS_A_BLOCK", 10)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5")
    try:
        df = postings.proximity_many(asked, index)
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set(setting, before)
    whole = lambda words: r"\s+".join(rf"(?<!\w){w}(?!\w)" for w in words.split())
    wanted = set()
    for i, a, b, n, ordered in cut:
        for x, y in [(a, b)] if ordered else [(a, b), (b, a)]:
            wanted |= {(i, str(c)) for (c, _), t in texts.items() if re.search(rf"{whole(x)}(?:\s+\S+){{0,{n - 1}}}\s+{whole(y)}", t)}
    assert got == sorted(wanted)
    # Postings meet the words asked for and go to the blocks of their cases; no row is made for a query and a paragraph.
    plan = _plan(df)
    assert "map_from_entries" not in plan and "leading" not in plan and plan.count("collect_list") == 0


# Alike strings


def plain_similarity(a, b):
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in X.words_of(s) for i in range(len(w) + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_names_equal_all_pairs(spark, threshold):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(30)] + ["state", "union"]
    names = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice(["", " v state", " v union"]) for _ in range(150)] + ["", "--"]
    left = spark.createDataFrame([(n,) for n in names[:80] + [None]], "name string")
    right = spark.createDataFrame([(n,) for n in names[40:] + names[40:60] + [None]], "name string")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_names(left, right, threshold).collect()}
    wanted = {(a, b): s for a in names[:80] for b in names[40:] if (s := plain_similarity(a, b)) > threshold}
    assert got == pytest.approx(wanted)


def test_similar_names_meet_on_rare_pieces(spark):
    names = spark.createDataFrame([(f"state of {i:05d}{'abcdefghij'[i % 10] * 3}x{i * 7919:07d}",) for i in range(3000)], "name string")
    df = similarity.similar_names(names, names, 0.8)
    assert df.count() >= 3000
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_words_within_edits_equal_all_pairs(spark):
    rng = random.Random(10)
    words = list({"".join(rng.choices("abé", k=rng.randrange(1, 9))) for _ in range(300)})
    asked = [(w, m) for w in words[:60] for m in (0, 1, 2)] + [("", 1), (None, 2)]
    got = {(r.word, r.most, r.token): r.edits for r in similarity.within_edits(spark.createDataFrame(asked, "word string, most int"), spark.createDataFrame([(w,) for w in words + [None, ""]], "token string")).collect()}
    wanted = {(w, m, t): e for w, m in asked if w for t in words if len(t) > m and (e := plain_edits(w, t)) <= m}
    assert got == wanted


def test_very_long_words_stay_linear(spark):
    long = "ab" * 10_000
    vocabulary = spark.createDataFrame([(long,), (long[:-1] + "x",), (long[5:],), ("short",)], "token string")
    got = search.fuzzy_terms(spark.createDataFrame([(1, long), (2, "shrt")], "query_id int, term string"), vocabulary).collect()
    assert {(r.query_id, len(r.token), r.edits) for r in got} == {(1, 20_000, 0), (1, 20_000, 1), (2, 5, 1)}


def test_name_levels_equal_plain_code(spark):
    rng = random.Random(11)
    words = ["sharma", "nandini", "kesavananda", "bharati", "kerala", "steel", "works", "aaa", "bbbb", "steelworks", "india"]
    names = list({" ".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice(["", " v state"]) for _ in range(120)})
    asked = [" ".join(rng.choices(words + ["kesavanda", "sharm", "zzzz"], k=rng.randrange(1, 4))) for _ in range(80)]
    cases = spark.createDataFrame([(f"{i:03d}", n) for i, n in enumerate(names)] + [("999", None)], "case_id string, case_name string")
    df = spark.createDataFrame(list(enumerate(asked)), "mention_id int, mention string")
    told = {r.mention_id: r.w for r in df.select("mention_id", query_tables.name_words(F.col("mention")).alias("w")).collect()}
    wanted = {}
    for m, w in told.items():
        if not w:
            continue
        best = []
        for i, name in enumerate(names):
            sim, held = plain_similarity(name, " ".join(w)), sum(x in name for x in w)
            if sim > 0.5 and not (len(w) == 1 and len(w[0]) < 7):
                best.append((1, -sim, f"{i:03d}"))
            elif len(w) >= 2 and held == len(w):
                best.append((2, 0, f"{i:03d}"))
            elif len(w) >= 2 and held >= 2:
                best.append((3, -held, f"{i:03d}"))
            elif len(w) == 1 and len(w[0]) >= 6 and held == 1:
                best.append((4, len(name), f"{i:03d}"))
        if best:
            level, _, case_id = min(best)
            wanted[m] = (case_id, level)
    got = {r.mention_id: (r.case_id, r.level) for r in query_tables.resolve_names(df, cases).collect()}
    assert got == wanted and {level for _, level in got.values()} >= {1, 2, 3}


def test_field_values_must_not_be_empty():
    with pytest.raises(ValueError):
        field_contains("court", " ")


def test_searches_over_many_blocks_equal_the_scan(spark, folder, index, monkeypatch):
    monkeypatch.setattr(postings, "QUERIES_A_BLOCK", 3)
    monkeypatch.setattr(postings, "CASES_A_BLOCK", 40)
    monkeypatch.setattr(postings, "CELLS_AT_ONCE", 10)
    f = Fixtures(spark, folder)
    asked = index_queries.searches(f).select(F.col("query_id").cast("string").alias("query_id"), "terms").limit(9).localCheckpoint()
    asked = asked.union(spark.createDataFrame([("x", ["the", "THE", "of"]), (None, ["the", "nosuchword"])], "query_id string, terms array<string>"))
    for share in (1.0, 0.6, 0.3):
        made = postings.search_many(asked, index, share)
        assert sorted(map(repr, made.collect())) == sorted(map(repr, search.search_many(asked, f.paras, share).collect()))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" not in plan and "RepartitionBy" in plan  # pairs are not tried one by one


def test_similar_names_over_many_blocks_equal_all_pairs(spark, monkeypatch):
    for name, value in (("RIGHT_A_BLOCK", 20), ("LEFT_A_BLOCK", 15), ("CELLS_AT_ONCE", 50), ("WORDS", 1)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefé", k=rng.randrange(2, 6))) for _ in range(40)]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(120)}) + [""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    made = similarity.similar_names(df, df, 0.6)
    got = [(r.a, r.b, r.similarity) for r in made.collect()]
    wanted = {(a, b): s for a in names for b in names if (s := plain_similarity(a, b)) > 0.6}
    assert {(a, b): s for a, b, s in got} == pytest.approx(wanted) and len(got) == len(wanted)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # pairs are counted, not joined piece by piece
