"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.llm import cover_tree, fim, langid, licenses, near_dup, packing, piece_lattice, secret_scan, tiff, token_counts, toxicity, tree_bpe, whitening
from lexcorpus.llm.common import held_out, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "unmatched")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the packed documents, with a checksum in place of their ids."""
    pieces = packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.fit(docs.where(~F.col("held_out")), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", utf8.alias("utf8")).withColumn("n_bytes", F.octet_length("utf8").cast("long"))
    padding = F.greatest(F.ceil(F.col("n_bytes") / tiff.WIDTH), F.lit(1)) * tiff.WIDTH - F.col("n_bytes")
    # A byte 255 is no UTF-8, so the padding is made as hexadecimal digits.
    stored = docs.withColumn("media", tiff.encoded(F.concat("utf8", F.unhex(F.repeat(F.lit("FF"), padding.cast("int"))))))
    read = stored.withColumn("pages", tiff.decoded(F.col("media")))
    # Pages are joined as hexadecimal digits: joining them one by one would copy a long text again and again.
    joined = F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["pixels"])), ""))
    read = read.withColumn("payload", F.when(F.size("pages") == 1, F.get("pages", F.lit(0))["pixels"]).otherwise(joined))
    levels = F.aggregate("pages", F.array_repeat(F.lit(0), 8), lambda out, p: F.zip_with(out, p["levels"], lambda a, b: a + b))
    feature = F.concat_ws(";", F.concat(F.lit("pages="), F.size("pages")), F.concat(F.lit("rows="), F.aggregate("pages", F.lit(0), lambda n, p: n + p["height"])), F.concat(F.lit("levels="), F.concat_ws(",", levels.cast("array<string>"))))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", held_out().alias("held_out"), "text"), toxicity.fit(docs, labels.where(~held_out())))
    return scored.drop("text").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    best = cover_tree.top_k(vectors.select("vec_id", F.when(finite, whole).alias("vector")), F.col("vec_id") % 20 == 0)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; the mark put in front of a text is taken off."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    made = piece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep=["doc_id"])
    back = piece_lattice.decode(made, model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    text = F.substring("decoded", 2, 2**31 - 1)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tree_bpe.encode(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded_col="decoded")
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return back.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = whitening.whole_numbers(F.col("embedding"), scale=64, shift=1_000_000).alias("vector")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole)
    model = whitening.fit(vectors)
    explained = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    rows = whitening.transform(vectors, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_license_scan, op2_packing, op3_language_id, op4_secret_scan, op5_tiff, op6_toxicity, op7_ngram_jaccard, op8_token_counts,
        op9_cover_tree, op10_piece_lattice, op11_fill_in_middle, op12_tree_bpe, op13_whitening,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """What can be written in SQL; tests hold the others against plain code."""
    top = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""
    near = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w WHERE len(w) > 0),
f AS (SELECT doc_id, g, md5(array_to_string(g, '|')) AS f FROM g),
n AS (SELECT f, min(doc_id) AS node, count(*) AS copies, any_value(g) AS g FROM f GROUP BY f),
e AS (SELECT node, len(g) AS k, unnest(g) AS s FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.s = b.s AND a.node <> b.node GROUP BY a.node, b.node, a.k, b.k HAVING count(*) >= 0.8 * (a.k + b.k - count(*)) - 1e-9),
l AS (SELECT a AS node, sum(copies) AS links FROM p JOIN n ON n.node = p.b GROUP BY a),
r AS (SELECT node, node AS root FROM n UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n.node, d.doc_id) AS copy_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN n ON n.f = f.f LEFT JOIN l ON l.node = n.node LEFT JOIN c ON c.node = n.node"""
    return {"op1_license_scan": licenses.oracle("documents"), "op7_ngram_jaccard": near, "op9_cover_tree": top}
