"""Fill-in-middle, tree concatenation of BPE and whitening against brute force, libraries and round trips."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexcorpus.llm import fim, queries, tree_bpe, whitening

BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\nx"), (5, "no line end"), (6, "a\nb\n"), (6, "a\nb\n"), (None, "é\n日本\n\U0001f600 x\nü"), (7, "holds <S> a mark\n"),
    (8, "x" * 100_000), (9, " " * 70_000 + "end"), (10, "line of words\n" * 9000), (11, "日本語" * 30_000), (12, "<|endoftext|>" * 2000), (13, "a1!" * 3000 + "\n\n \n"), (None, None), (8, "x" * 100_000),
    (14, "né " * 30_000 + "z" * 5000 + "\t\t" + "'s" * 2000), (15, "\x00\x85\xa0\x1c" * 900), (16, "<|endoftext|>" + "ab" * 40_000 + " <|endoftext|>\n" + "é" * 9000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 5, "old", [1], 2, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int, ids string, output array<int>, key int, part string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 fill-in-middle


def plainly(doc_id, text):
    """The transformation by a pattern and slices."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in fim.MARKS):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_patterns_and_slices(spark, folder, odd):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rng = random.Random(1)
    texts += [(1000 + i, "".join(rng.choices("ab\n\n é日\U0001f600", k=rng.randrange(60)))) for i in range(3000)]
    made = fim.transform(spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd.select("doc_id", "text")))
    made = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    wanted = [plainly(*x) for x in texts + ODD]
    assert sorted((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made if r.form != "plain") == sorted(x for x in wanted if x[1] != "plain")
    assert sorted(r.output for r in made if r.form == "plain") == sorted(x[4] for x in wanted if x[1] == "plain")
    assert all(r.back == (r.text or "") for r in made)
    assert {"plain", "spm", "psm"} == {r.form for r in made}


def test_fim_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op11_fill_in_middle(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, prefix, middle, output = plainly(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))


def test_fim_clashing_columns_and_empty_table(odd):
    made = fim.transform(odd)
    assert sorted(made.columns) == sorted({*odd.columns, "prefix_chars", "middle_chars"})
    assert made.count() == len(ODD) and fim.transform(odd.limit(0)).count() == 0


def test_fim_other_units_and_shares(spark):
    df = spark.createDataFrame([(i, f"One. Two! é{i} Three? rest") for i in range(400)], "doc_id long, text string")
    made = fim.transform(df, ends=".!?", percent=50, spm_percent=0, marks=("[A]", "[B]", "[C]")).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[A]", "[B]", "[C]"))).collect()
    assert {r.n for r in made} == {4} and all(r.back == r.text for r in made)
    assert 120 < sum(r.form == "psm" for r in made) < 280 and not any(r.form == "spm" for r in made)
    borders = {0, 4, 9}
    assert all(r.prefix_chars in borders or r.prefix_chars > 9 for r in made if r.form == "psm")
    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("ab", "ba", "<M>"), ("<P>", "x<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(df, marks=marks)


def test_swar_rank_and_select():
    rng = np.random.default_rng(2)
    for size in (0, 1, 8, 9, 1000):
        raw = rng.integers(0, 256, size=size, dtype=np.uint8)
        raw[rng.random(size) < 0.3] = 10
        words = np.zeros((size + 7) // 8 * 8, dtype=np.uint8)
        words[:size] = raw
        found = fim.Marked(fim.equal_bytes(words.view("<u8"), 10))
        places = np.flatnonzero(raw == 10)
        assert (found.select(np.arange(1, len(places) + 1)) == places).all()
        at = np.arange(size + 1)
        assert (found.rank(at) == np.searchsorted(places, at)).all()


# 12 tree concatenation


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_tree_bpe_equals_the_library(spark, odd, library):
    made = tree_bpe.decode(tree_bpe.encode(odd, BYTES, RANKS), BYTES)
    assert sorted(made.columns) == sorted({*odd.columns, "decoded"})
    got = made.collect()
    assert len(got) == len(ODD)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    once = tree_bpe.encode(odd, BYTES, RANKS, decoded_col="form").select("ids", "form").collect()
    assert sorted((r.ids, r.form) for r in once) == sorted((r.ids, r.decoded) for r in got)


def test_tree_bpe_with_tiny_units_equals_the_library(spark, library):
    rng = random.Random(3)
    alphabets = ["ab", "a", " ", " \n\t", "abcdefghij", "0123456789", "!?'", "aé日 \n", "the of and in to is ", "'slvmtd ", "\x85\xa0 a", "<|endoftext|> x"]
    texts = ["".join(rng.choices(a, k=rng.randrange(1, 400))) for a in alphabets for _ in range(30)] + ["<|endoftext|>".join("ab " * i for i in range(20))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for unit, spread in ((1, 10), (3, 20), (7, 1 << 20), (16, 50)):
        for r in tree_bpe.encode(df, BYTES, RANKS if unit != 3 else None, unit=unit, spread=spread).collect():
            assert np.frombuffer(r.ids, dtype="<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids, (unit, r.text)


def test_tree_join_grows_until_both_sides_agree(library):
    encoder = tree_bpe.TreeEncoder(BYTES)
    rng = random.Random(4)
    for k in range(400):
        word = "".join(rng.choices("abst" if k % 2 else "aé0Ġ", k=rng.randrange(2, 200)))
        at = rng.randrange(1, len(word))
        got = encoder.join(encoder.merged(word[:at]), encoder.merged(word[at:]))
        assert got.tolist() == encoder.merged(word).tolist()


def test_tree_bpe_odd_ids_and_empty_table(spark, odd, library):
    assert tree_bpe.encode(odd.limit(0), BYTES).count() == 0
    rng = random.Random(5)
    rows = [[rng.randrange(50_300) for _ in range(rng.randrange(9))] for _ in range(500)]
    df = spark.createDataFrame([(r, np.array(r, dtype="<u4").tobytes()) for r in rows] + [(None, None)], "list array<int>, ids binary")
    for r in tree_bpe.decode(df, BYTES).collect():
        assert r.decoded == (None if r.ids is None else library.decode(r.list, skip_special_tokens=False))


def test_tree_bpe_query(spark, folder, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op12_tree_bpe(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(docs[r.doc_id]))


# 13 whitening


def whitened_plainly(x):
    """n, deviations, shares and whitened rows by whole numbers and an eigenvalue routine."""
    n, s = len(x), [sum(c) for c in zip(*x.tolist(), strict=True)]
    deviation = [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
    centred = np.array([[(n * v - t) / n for v, t in zip(row, s, strict=True)] for row in x.tolist()])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, e[::-1] / e.sum(), centred @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))


def test_whitening_query_equals_eigenvectors(spark, folder):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.floor(np.array([rows[i] for i in ids], dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, deviation, share, whitened = whitened_plainly(x)
    got = queries.op13_whitening(spark, folder).collect()
    width = min(32, x.shape[1])
    assert len(got) == len(ids) * width
    at = {i: k for k, i in enumerate(ids)}
    made = np.zeros((len(ids), width))
    for r in got:
        made[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    same = np.abs((made * whitened[:, :width]).mean(axis=0))
    assert (same > 1 - 1e-6).all()


def test_whitening_of_ill_conditioned_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3000, 5)) * [1e6, 1e4, 100, 10, 2]
    x = np.rint(base @ np.linalg.qr(rng.normal(size=(5, 5)))[0]).astype(np.int64) + 10**6
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, vector array<long>").repartition(5)
    model = whitening.fit(df)
    _, _, share, _ = whitened_plainly(x)
    assert model.explained == pytest.approx(share, rel=1e-6) and model.identity_error < 1e-6
    assert np.allclose(model.directions.T @ model.directions, np.eye(5), atol=1e-12)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, vector array<long>, whitened string, n int"
    good = [[1, 2, 3], [4, 0, 3], [2, 7, 3], [2, 7, 3], [5, 5, 3]]
    rows = [(i if i else None, v, "x", 1) for i, v in enumerate(good)] + [(9, None, "x", 1), (9, [1, None, 2], "x", 1), (9, [], "x", 1), (9, [1, 2], "x", 1)]
    df = spark.createDataFrame(rows, schema)
    model = whitening.fit(df)
    made = whitening.transform(df, model).collect()
    n, deviation, share, _ = whitened_plainly(np.array(good))
    assert model.n == n == len(made) and sorted(int(r.deviation) for r in made) == sorted(deviation)
    assert len(model.scales) == 2 and model.explained == pytest.approx(share[:2], rel=1e-9) and model.identity_error < 1e-9
    one = df.limit(1)
    assert [r.whitened for r in whitening.transform(one, whitening.fit(one)).collect()] == [[]]
    none = df.limit(0)
    assert whitening.transform(none, whitening.fit(none)).count() == 0
    assert whitening.transform(df, whitening.fit(none)).count() == 0
    twice = spark.createDataFrame([(i, [a, a, 2 * a, b]) for i, (a, b) in enumerate([(1, 2), (5, 1), (7, 7), (2, 9)])], "vec_id long, vector array<long>")
    assert len(whitening.fit(twice).scales) == 2
    with pytest.raises(Exception, match="2\\*\\*46"):
        whitening.fit(spark.createDataFrame([(1, [1 << 50])], "vec_id long, vector array<long>"))


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf")],)], "v array<float>")
    assert [r.x for r in df.select(whitening.whole_numbers(F.col("v"), 64, 10).alias("x")).collect()] == [[42, 9], None, None, None, None]


def test_triangular_solve():
    rng = np.random.default_rng(7)
    upper = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    rows = rng.normal(size=(11, 70))
    assert np.allclose(whitening.solved(rows, upper) @ upper, rows)


def test_matrix_of_sliced_lists():
    lists = pa.array([[9], [1, 2], [3, None], None, [5, 6]]).slice(1)
    fits, x = whitening._matrix(lists, 2)
    assert fits.tolist() == [True, False, False, True] and x.tolist() == [[1, 2], [5, 6]]
