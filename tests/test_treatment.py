"""Treatment counts around names, against the plain text functions, and the plan of the scan."""

import random

import pytest
from pyspark.sql import functions as F

from lexcorpus.functions import treatment as T
from lexcorpus.functions.text import context_window
from lexcorpus.operators import citations

PHRASES = {"overruled": ("aba", "is bad law"), "distinguished": ("that", "hat"), "followed": ("of",), "affirmed": ("THE x", "that"), "doubted": ("zz",)}


def test_scanner_equals_windows_and_counts(spark):
    rng = random.Random(12)
    parts = ["aba", "ab", " ", "\n", "  ", "that", "is bad law", "is  bad\nlaw", "of", "the x", "zz", "İ", "é", "Name V Other", "name"]
    texts = ["".join(rng.choices(parts[: 15 if i % 5 else 14], k=rng.randrange(60))) for i in range(200)] + ["", "x" * 50 + "zzz"]
    names = ["name v other", "NAME", "", None, "missing", "aba", "x"]
    rows = [(i, t, k, n) for i, t in enumerate(texts) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "i int, t string, k int, n string")
    near = F.coalesce(context_window(F.col("t"), F.col("n"), 15), F.substring("t", 1, 40))
    wanted = {(r.i, r.k): [r[c] for c in PHRASES] for r in df.select("i", "k", *[n.alias(c) for c, n in T.counts(near, PHRASES).items()]).collect()}
    scanner = T.Scanner(PHRASES, 15, 40)
    for i, t in enumerate(texts):
        assert [wanted[i, k] for k in range(len(names))] == scanner.read(t, names), t


def test_each_judgment_leaves_its_scan_once(spark, monkeypatch):
    cases = spark.createDataFrame([("a", "A v B", 1990, "we follow the ratio of C v D; E v F is overruled"), ("c", "C v D", 1980, None), ("e", "E v F", None, "")], "case_id string, case_name string, year int, judgment string")
    cites = spark.createDataFrame([("a", "c"), ("a", "c"), ("a", "e"), ("c", "e"), ("a", None), ("x", "c"), ("a", "gone")], "source_case_id string, cited_case_id string")
    for size in (1000, 1):
        monkeypatch.setattr(citations, "NAMES_A_ROW", size)
        df = citations.treatment_status(cites, cases, window=13)
        got = {r.case_id: r for r in df.collect()}
        assert set(got) == {"c", "e"} and got["c"].scanned == 2 and got["e"].scanned == 1
        assert got["e"].status == "overruled" and got["e"].label == "Overruled in 1 later case"
        assert [(x.source_case_id, x.treatment) for x in got["e"].top_citing] == [("a", "overruled")]
    counted = citations.treatment_counts(cites, cases)
    counted.collect()
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    above = plan.split("MapInArrow")[0]
    assert "judgment" not in above  # no text above the reading


def test_empty_tables(spark):
    cases = spark.createDataFrame([], "case_id string, case_name string, year int, judgment string")
    cites = spark.createDataFrame([], "source_case_id string, cited_case_id string")
    assert citations.treatment_status(cites, cases).count() == 0
    assert T.Scanner().read("", ["x", ""]) == [[0] * 5] * 2 and T.Scanner().read("text", []) == []
    with pytest.raises(AttributeError):
        T.Scanner().read(None, [])


def test_prevailing_is_the_dominant_count(spark):
    phrases = [p for some in T.TREATMENTS.values() for p in some]
    texts = [(None,), ("",), *((f"x {a} y {b.upper()}, {a}",) for a, b in zip(phrases, [*phrases[7:], *phrases[:7]], strict=True)), *((f"{b} {a}",) for a, b in zip(phrases, [*phrases[3:], *phrases[:3]], strict=True))]
    df = spark.createDataFrame(texts, "text string").select(T.prevailing(F.col("text")).alias("a"), T.dominant(T.counts(F.col("text"))).alias("b"))
    rows = df.collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) > 3
