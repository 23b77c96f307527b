"""Choosing and laying out paragraphs as evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexcorpus.functions.text import escaped, highlighted


def quality_gate(paras: DataFrame, least: float = 0.5, length: int = 80) -> DataFrame:
    return paras.where((F.coalesce("quality_score", F.lit(0.5)) > least) & (F.length("text") > length))


def _top(paras: DataFrame, order: Sequence[Column], n: int, key: str = "case_id") -> DataFrame:
    return paras.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def _place(types: Sequence[str]) -> Column:
    chain = F.when(F.col("para_type") == types[0], 0)
    for i, t in enumerate(types[1:], 1):
        chain = chain.when(F.col("para_type") == t, i)
    return chain.otherwise(len(types))


def judgment_paragraphs(paras: DataFrame, n: int = 30) -> DataFrame:
    """Judgment and order paragraphs per case, the judgment first, then by quality."""
    fit = paras.where(F.col("para_type").isin("judgment", "order") & (F.coalesce("quality_score", F.lit(1.0)) > 0.1) & (F.col("word_count") > 30))
    return _top(fit, [_place(("judgment", "order")), F.coalesce("quality_score", F.lit(0.5)).desc(), F.col("paragraph_id")], n)


def all_paragraphs(paras: DataFrame, n: int = 20) -> DataFrame:
    fit = paras.where((F.coalesce("quality_score", F.lit(1.0)) > 0.05) & (F.col("word_count") > 40))
    return _top(fit, [_place(("judgment", "order", "issues", "facts")), F.coalesce("quality_score", F.lit(0.5)).desc(), F.col("paragraph_id")], n)


def best_paragraphs(paras: DataFrame, n: int = 15) -> DataFrame:
    fit = paras.where((F.col("quality_score") > 0.3) & (F.col("word_count") > 30))
    return fit.orderBy(_place(("judgment", "order")), F.desc("quality_score"), "paragraph_id").limit(n)


def decisive_paragraph(paras: DataFrame) -> DataFrame:
    """Per case the first paragraph of a deciding type (0.9), else the longest (0.6 over 200 letters, else 0.5)."""
    typed = F.coalesce(F.lower("para_type").isin("judgment", "order", "finding", "relief", "decision"), F.lit(False))
    length = F.coalesce(F.length("text"), F.lit(0))
    order = [F.when(typed, 0).otherwise(1), F.when(typed, 0).otherwise(-length), F.col("para_no")]
    sure = F.when(typed, 0.9).when(length > 200, 0.6).otherwise(0.5)
    return _top(paras, order, 1).withColumn("confidence", sure).drop("rank")


#: Paragraph groups in order, and their headings.
GROUPS = {"facts": "FACTS OF THE CASE", "issues": "ISSUES / QUESTIONS OF LAW", "judgment": "JUDGMENT / RATIO", "order": "FINAL ORDER", "general": "OTHER PARAGRAPHS"}


def evidence_context(paras: DataFrame, n: int = 4, most: int = 600) -> DataFrame:
    """Per case its paragraphs under headings: at most n per group, each cut to `most` letters."""
    low = F.lower("para_type")
    rows = paras.where(F.length(F.trim("text")) > 0).withColumns({"group": F.when(low.isin(list(GROUPS)), low).otherwise("general"), "body": F.trim("text")})
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "group").orderBy("para_no"))).where(F.col("rank") <= n)
    place = F.create_map(*[F.lit(x) for i, g in enumerate(GROUPS) for x in (g, i)])
    line = F.concat(F.lit("[Para "), F.col("para_no").cast("string"), F.lit("] "), F.substring("body", 1, most), F.when(F.length("body") > most, "...").otherwise(""))
    groups = top.groupBy("case_id", "group").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    heads = F.create_map(*[F.lit(x) for g, h in GROUPS.items() for x in (g, f"=== {h} ===")])
    block = F.concat_ws("\n\n", F.element_at(heads, F.col("group")), F.col("lines.line"))
    whole = groups.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.element_at(place, F.col("group")).alias("place"), block.alias("block")))).alias("blocks"))
    return whole.select("case_id", F.array_join("blocks.block", "\n\n").alias("context"))


def evidence_string(hits: DataFrame, n: int = 10, most: int = 800) -> DataFrame:
    """Per query its best hits as numbered lines with their text."""
    top = _top(hits, [F.desc_nulls_last("relevance_score"), F.col("case_id")], n, "query_id")
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Case: "), "case_name", F.lit(" ("), F.coalesce("court", F.lit("")), F.lit(" "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(") | Relevance: "), F.col("relevance_score").cast("string"))
    lines = top.select("query_id", "rank", F.concat(head, F.lit("\n"), F.substring("text", 1, most)).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "line")))["line"], "\n\n").alias("evidence"))


def best_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each query and case; a null score counts as 0."""
    order = Window.partitionBy("query_id", "case_id").orderBy(F.coalesce("relevance_score", F.lit(0.0)).desc(), "paragraph_id")
    return hits.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def snippets(paras: DataFrame, page: DataFrame, terms: Sequence[str], n: int = 3) -> DataFrame:
    """Per case of the page its best paragraphs as highlighted spans; equal beginnings count once."""
    own = paras.join(page.select("case_id"), "case_id", "left_semi")
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.regexp_count("text", F.lit("(?iu)" + escaped(t)))
    scored = own.withColumn("hits", hits if terms else F.lit(1)).where("hits > 0").withColumn("__head", F.substring("text", 1, 60))
    order = [F.desc("hits") if terms else F.desc_nulls_last("quality_score"), F.col("para_no")]
    first = scored.withColumn("__same", F.row_number().over(Window.partitionBy("case_id", "__head").orderBy(*order))).where("__same = 1")
    top = _top(first, order, n)
    spans = highlighted(F.col("text"), terms) if terms else F.array(F.struct(F.substring("text", 1, 300).alias("text"), F.lit(False).alias("highlighted")))
    return top.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "para_no", "hits", spans.alias("spans")))).alias("fragments"))
