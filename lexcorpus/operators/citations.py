"""Citation graph: statistics, prominence, precedent status, lists, trees and contexts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexcorpus.functions import prominence as P
from lexcorpus.functions import treatment as T
from lexcorpus.functions.dictionaries import TREATMENTS
from lexcorpus.functions.text import context_window
from lexcorpus.sources import tables


def statistics(cites: DataFrame) -> DataFrame:
    """Per target citation: totals, distinct sources, mean confidence and the commonest relationship."""
    by_kind = cites.groupBy("target_citation", "relationship").agg(F.count("*").alias("n"))
    common = by_kind.where(F.col("relationship").isNotNull()).groupBy("target_citation").agg(F.min_by("relationship", F.struct(-F.col("n"), "relationship")).alias("most_common"))
    count_if = lambda kind: F.count_if(F.col("relationship") == kind).alias(f"{kind}_count")
    totals = cites.groupBy("target_citation").agg(F.count("*").alias("total"), F.count_distinct("source_case_id").alias("sources"), F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("avg_confidence"), count_if("overruled"), count_if("approved"), count_if("followed"))
    return totals.join(common, totals.target_citation.eqNullSafe(common.target_citation), "left").select(totals["*"], "most_common")


def scored(stats: DataFrame) -> DataFrame:
    """Statistics with court, weight, prominence and status."""
    c = F.col("target_citation")
    made = stats.withColumns({"court": P.court(c), "weight": P.court_weight(c)})
    made = made.withColumn("prominence", P.prominence(F.col("total"), F.col("weight"), F.coalesce("most_common", F.lit("cited")), F.col("avg_confidence")))
    return made.withColumn("status", P.score_status(F.col("prominence"), F.col("most_common")))


def edge_kind() -> Column:
    return F.coalesce(F.when(F.col("relationship") != "", F.col("relationship")), F.lit("cited"))


def edge_confidence() -> Column:
    return F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.6).otherwise(F.col("confidence"))


def no_prominence() -> Column:
    """The prominence of a target that is not named."""
    return P.prominence(F.lit(0), F.lit(2), F.lit("cited"), F.lit(0.5))


def precedent_status(cases: DataFrame, cites: DataFrame, statistics_of: DataFrame | None = None) -> DataFrame:
    """case_id, status, strength, label, treatment_counts and citing_count of every case.

    `statistics_of` are the edges whose targets are counted, if more than those of `cites`. Edges
    are grouped before they meet the scores, so a landmark's edges shrink to one row per case.
    """
    scores = scored(_rated(cites if statistics_of is None else statistics_of)).select(F.col("target_citation").alias("target"), "prominence")
    groups = cites.groupBy("source_case_id", "target_citation", "relationship", "confidence").agg(F.count("*").alias("n"))
    # Edges without a target meet no score; they are dealt by their source, so that they do not come to one task.
    spread = F.when(F.col("target_citation").isNull(), F.xxhash64("source_case_id", "relationship", "confidence")).otherwise(F.lit(0))
    met = groups.withColumn("__spread", spread).join(scores.withColumn("__spread", F.lit(0).cast("long")).withColumnRenamed("target", "target_citation"), ["target_citation", "__spread"], "left")
    prominence = F.when(F.col("target_citation").isNull(), no_prominence()).otherwise(F.col("prominence")).alias("prominence")
    return folded_status(cases, met.select("source_case_id", "n", edge_kind().alias("kind"), edge_confidence().alias("sure"), prominence))


def _rated(cites: DataFrame) -> DataFrame:
    """Of `statistics` what `scored` asks for, in one reading of the edges: they are grouped by target and relationship, then by target."""
    kind = F.col("relationship")
    by_kind = cites.where(F.col("target_citation").isNotNull()).groupBy("target_citation", "relationship").agg(F.count("*").alias("n"), F.sum("confidence").alias("sure"), F.count("confidence").alias("n_sure"))
    common = F.min_by(kind, F.when(kind.isNotNull(), F.struct(-F.col("n"), kind))).alias("most_common")
    mean = F.coalesce(F.try_divide(F.sum("sure"), F.sum("n_sure")), F.lit(0.5)).alias("avg_confidence")
    return by_kind.groupBy("target_citation").agg(F.sum("n").alias("total"), mean, common)


def folded_status(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """Status of every case from edges (source_case_id, n, kind, sure, prominence of what is cited)."""
    kinds = edges.groupBy("source_case_id", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("prominence") * P.modifier(F.col("kind")) * F.col("n")).alias("score"), F.sum(F.col("sure") * F.col("n")).alias("sure"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    folded = kinds.groupBy(F.col("source_case_id").alias("case_id")).agg(F.sum("n").alias("total"), F.sum("groups").alias("citing_count"), F.sum("score").alias("score"), F.sum("sure").alias("sure"), of("overruled").alias("overruled"), of("approved").alias("approved"), of("followed").alias("followed"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("treatment_counts"))
    base = F.least(F.lit(100), (F.round(F.col("score") / F.col("total") + F.col("sure") / F.col("total") * 25, 9)).cast("int"))
    joined = cases.select("case_id").join(folded, "case_id", "left").withColumn("base", base)
    good = (F.col("approved") > F.col("total") * 0.3) | (F.col("followed") > F.col("total") * 0.3)
    bad = F.col("overruled") > F.col("total") * 0.5
    status = F.when(F.col("total").isNull(), "unknown").when(bad, "dubious").when(good, "reliable").when(F.col("base") >= 75, "active_authority").when(F.col("base") >= 50, "cited").otherwise("limited")
    strength = F.when(F.col("total").isNull(), 50).when(bad, F.greatest(F.lit(20), F.col("base") - 30)).when(good, F.least(F.lit(90), F.col("base") + 10)).otherwise(F.col("base"))
    made = joined.withColumns({"status": status, "strength": strength, "citing_count": F.coalesce("citing_count", F.lit(0))})
    label = F.when(F.col("total").isNull(), "unknown").otherwise(F.concat(F.lit("("), "status", F.lit(") citing "), F.col("citing_count").cast("string"), F.lit(" unique authorities")))
    return made.select("case_id", "status", "strength", label.alias("label"), F.coalesce("treatment_counts", F.create_map().cast("map<string,bigint>")).alias("treatment_counts"), "citing_count")


def with_status(cases: DataFrame, status: DataFrame, strength: int = 50) -> DataFrame:
    """Cases with their stored status; where none is stored, unknown and a neutral strength."""
    known = status.select("case_id", "status", "strength", "label")
    return cases.join(known, "case_id", "left").withColumns({"status": F.coalesce("status", F.lit("unknown")), "strength": F.coalesce("strength", F.lit(strength)), "label": F.coalesce("label", F.lit("unknown"))})


def validity(cases: DataFrame, cites: DataFrame) -> DataFrame:
    """overruled (and by whom, the least id), highly_cited over 50 citations, or valid."""
    over = F.col("relationship").isin("overruled", "overruled_by", "overrules")
    seen = cites.where(F.col("cited_case_id").isNotNull()).groupBy(F.col("cited_case_id").alias("case_id")).agg(F.count("*").alias("cited_by"), F.min(F.when(over, F.col("source_case_id"))).alias("overruled_by"))
    joined = cases.select("case_id").join(seen, "case_id", "left")
    status = F.when(F.col("overruled_by").isNotNull(), "overruled").when(F.col("cited_by") > 50, "highly_cited").otherwise("valid")
    return joined.select("case_id", status.alias("validity"), "overruled_by", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def validity_of(asked: DataFrame, cases: DataFrame, cites: DataFrame) -> DataFrame:
    """The same for the cases asked for (case_id); one that the corpus does not hold is unknown."""
    told = validity(cases, cites.join(asked.select(F.col("case_id").alias("cited_case_id")).distinct(), "cited_case_id", "left_semi"))
    found = asked.select("case_id").join(told, "case_id", "left")
    return found.withColumns({"validity": F.coalesce("validity", F.lit("unknown")), "cited_by": F.coalesce("cited_by", F.lit(0))})


def _ranked(edges: DataFrame, key: str, order: Sequence, n: int) -> DataFrame:
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def cited_by(cites: DataFrame, cases: DataFrame, n: int = 10) -> DataFrame:
    """The n cases that cite each case: the highest authority, then the surest edge, first."""
    info = cases.select(F.col("case_id").alias("source_case_id"), "authority_score")
    edges = cites.where(F.col("cited_case_id").isNotNull()).join(info, "source_case_id")
    order = [F.desc_nulls_last("authority_score"), F.desc_nulls_last("confidence"), F.col("source_case_id"), F.col("target_citation"), F.col("relationship").asc_nulls_last(), F.col("created_at")]
    return _ranked(edges, "cited_case_id", order, n).select("cited_case_id", "rank", "source_case_id", "confidence")


RELIED = ("relied_on", "followed", "applied", "cited")


def relied_on(cites: DataFrame, cases: DataFrame, n: int = 10, kinds: Sequence[str] = RELIED) -> DataFrame:
    """The n precedents each case relies on, the surest first; targets outside the corpus stay."""
    info = cases.select(F.col("case_id").alias("cited_case_id"), F.col("case_name").alias("cited_name"))
    order = [F.desc_nulls_last("confidence"), F.col("target_citation"), F.col("relationship"), F.col("created_at"), F.asc_nulls_last("cited_case_id")]
    top = _ranked(cites.where(F.col("relationship").isin(list(kinds))), "source_case_id", order, n)
    return top.join(info, "cited_case_id", "left").select("source_case_id", "rank", "target_citation", "relationship", "confidence", "cited_case_id", "cited_name")


def _tree_edges(cites: DataFrame) -> DataFrame:
    """at, case_id, confidence and relationship: parallel edges as one."""
    return cites.where(F.col("cited_case_id").isNotNull()).groupBy(F.col("source_case_id").alias("at"), F.col("cited_case_id").alias("case_id")).agg(F.max("confidence").alias("confidence"), F.min("relationship").alias("relationship"))


def _tree_level(front: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The paths of `front` (root, at, path) with one citation more."""
    step = front.join(edges, "at").where(~F.array_contains("path", F.col("case_id")))
    return step.select("root", "case_id", F.lit(depth).alias("depth"), "relationship", "confidence", F.concat("path", F.array("case_id")).alias("path"))


def _tree_front(level: DataFrame) -> DataFrame:
    return level.select("root", F.col("case_id").alias("at"), "path")


def citation_tree(cites: DataFrame, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """Every path of up to `max_depth` citations from the roots, without a case twice on it.

    Parallel edges count once, by the surest and then the least relationship.
    """
    if not 1 <= max_depth <= 3:
        raise ValueError("depth must be from 1 to 3")
    edges = _tree_edges(cites)
    front = roots.select(F.col("case_id").alias("root"), F.col("case_id").alias("at"), F.array("case_id").alias("path"))
    levels = []
    for depth in range(1, max_depth + 1):
        levels.append(_tree_level(front, edges, depth))
        front = _tree_front(levels[-1])
    return reduce(DataFrame.unionByName, levels)


def deep_citation_tree(cites: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """The paths of `citation_tree` to any depth, whatever their number.

    Edges and all levels but the last are written to the shared folder, so each level is one join over what
    is written; the last one is not held anywhere. It ends early where a level is empty. The number of paths
    grows with fan-out to the power of the depth, so this is for few roots or for edges of one kind.
    """
    if max_depth < 1:
        raise ValueError("depth must be at least 1")
    edges = tables.written(_tree_edges(cites))
    front = roots.select(F.col("case_id").alias("root"), F.col("case_id").alias("at"), F.array("case_id").alias("path"))
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        level = _tree_level(front, edges, depth)
        if depth < max_depth:
            level = tables.written(level)
        levels.append(level)
        if depth < max_depth and level.isEmpty():
            break
        front = _tree_front(level)
    return reduce(DataFrame.unionByName, levels)


#: Cited cases that travel to a judgment in one row.
NAMES_A_ROW = 1000


def treatment_counts(cites: DataFrame, cases: DataFrame, phrases: Mapping[str, Sequence[str]] = TREATMENTS, window: int = 1000) -> DataFrame:
    """cited_case_id, source_case_id, edges and a count for each class of phrases, for every cited case and its citing judgments.

    The names that a judgment cites come to it together, so each judgment leaves its scan once (once
    for every `NAMES_A_ROW` or so of its cited cases) and is read once; only numbers are shuffled after that.
    """
    scanner = T.Scanner(phrases, window)
    classes = list(phrases)
    names = cases.select(F.col("case_id").alias("cited_case_id"), F.col("case_name").alias("name"))
    pairs = cites.where(F.col("cited_case_id").isNotNull()).groupBy("source_case_id", "cited_case_id").agg(F.count("*").alias("edges")).join(names, "cited_case_id")
    parts = F.ceil(F.count("*") / NAMES_A_ROW).alias("__parts")
    dealt = pairs.join(pairs.groupBy("source_case_id").agg(parts), "source_case_id").withColumn("__part", F.pmod(F.xxhash64("cited_case_id"), F.col("__parts")))
    lists = dealt.groupBy("source_case_id", "__part").agg(*[F.collect_list(F.struct("cited_case_id", "name", "edges")).alias("cited")])
    texts = cases.select(F.col("case_id").alias("source_case_id"), "judgment").where(F.length("judgment") > 0)
    each = texts.join(lists, "source_case_id").select("source_case_id", "judgment", "cited.cited_case_id", "cited.name", "cited.edges")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                source, text, cited, asked, edges = (batch.column(k)[row].as_py() for k in range(5))
                found = list(zip(*scanner.read(text, asked), strict=True)) or [[]] * len(classes)
                columns = [pa.array(cited, pa.string()), pa.array([source] * len(cited), pa.string()), pa.array(edges, pa.int64()), *[pa.array(c, pa.int64()) for c in found]]
                yield pa.RecordBatch.from_arrays(columns, ["cited_case_id", "source_case_id", "edges", *classes])

    return each.mapInArrow(read, ", ".join(["cited_case_id string, source_case_id string, edges long", *[f"`{c}` long" for c in classes]]))


def treatment_status(cites: DataFrame, cases: DataFrame, phrases: Mapping[str, Sequence[str]] = TREATMENTS, window: int = 1000, top: int = 10) -> DataFrame:
    """Status of each cited case from the wording of the judgments that cite it.

    A citing case that cites twice counts twice in the sums, but is listed once; the `top` listed are those of the least ids.
    """
    counted = treatment_counts(cites, cases, phrases, window)
    totals = counted.groupBy("cited_case_id").agg(F.sum("edges").alias("scanned"), *[F.sum(F.col(c) * F.col("edges")).alias(c) for c in phrases])
    listed = counted.withColumn("treatment", T.dominant({c: F.col(c) for c in phrases})).where(F.col("treatment").isNotNull())
    first = _ranked(listed, "cited_case_id", [F.col("source_case_id")], top).select("cited_case_id", "rank", "source_case_id", "treatment")
    info = cases.select(F.col("case_id").alias("source_case_id"), "case_name", "year")
    best = first.join(info, "source_case_id").groupBy("cited_case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_case_id", "case_name", "year", "treatment"))).alias("top_citing"))
    four = (F.col("followed") + F.col("affirmed"), F.col("distinguished"), F.col("doubted"), F.col("overruled"))
    made = totals.join(best, "cited_case_id", "left")
    return made.select(F.col("cited_case_id").alias("case_id"), T.status(*four).alias("status"), T.label(*four).alias("label"), T.strength(*four).alias("strength"), "scanned", *phrases, "top_citing")


def citation_contexts(cites: DataFrame, cases: DataFrame, paras: DataFrame, n: int = 100, window: int = 200) -> DataFrame:
    """Why each case cites what it cites: stored sentence or a window of the judgment, treatment, proposition."""
    info = cases.select(F.col("case_id").alias("cited_case_id"), F.col("case_name").alias("cited_name"), F.col("year").alias("cited_year"))
    places = paras.select("paragraph_id", "para_no")
    order = [F.asc_nulls_last("para_no"), F.col("target_citation"), F.col("created_at"), F.asc_nulls_last("cited_case_id"), F.col("relationship"), F.col("confidence")]
    kept = ["source_case_id", "rank", "target_citation", "cited_case_id", "para_no", "context_sentence"]
    top = _ranked(cites.join(places, "paragraph_id", "left"), "source_case_id", order, n).select(*kept)
    # A judgment meets the citations of its case in one row and is put in lower case once for all of them; those with a sentence do not ask for it.
    stored = F.length("context_sentence") > 0
    asked = top.where(F.coalesce(~stored, F.lit(True))).groupBy("source_case_id").agg(F.collect_list(F.struct(*kept[1:])).alias("edges"))
    own = cases.select(F.col("case_id").alias("source_case_id"), "judgment")
    # A lambda's variable is computed once for all citations of a row.
    cut = F.transform(F.array(F.lower("judgment")), lambda low: F.transform("edges", lambda e: e.withField("context_sentence", F.coalesce(context_window(F.col("judgment"), e["target_citation"], window, low), F.lit("")))))
    read = asked.join(own, "source_case_id", "left").select("source_case_id", F.inline(F.get(cut, F.lit(0))))
    made = top.where(stored).unionByName(read).withColumnRenamed("context_sentence", "context").join(info, "cited_case_id", "left")
    treatment = F.coalesce(T.prevailing(F.col("context")), F.lit("cited"))
    return made.select("source_case_id", "rank", "target_citation", "cited_case_id", "cited_name", "cited_year", "para_no", F.substring("context", 1, 300).alias("context"), treatment.alias("treatment"), F.when(F.col("context") != "", T.proposition(F.col("context"), F.coalesce("target_citation", F.lit("")))).otherwise("").alias("cited_for"))


def case_details(cases: DataFrame, acts: DataFrame, cites: DataFrame, paras: DataFrame, edges: int = 20, first: int = 10) -> DataFrame:
    """One nested row per case: cited-by count, acts, citations out and in, first paragraphs."""

    def nested(rows: DataFrame, key: str, order: Sequence, n: int, name: str, *columns: str) -> DataFrame:
        top = _ranked(rows, key, order, n)
        return top.groupBy(F.col(key).alias("case_id")).agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias(name))

    pairs = cites.where(F.col("cited_case_id").isNotNull())
    parts = [
        pairs.groupBy(F.col("cited_case_id").alias("case_id")).agg(F.count("*").alias("cited_by_count")),
        nested(acts, "case_id", [F.desc("confidence"), F.col("act_name"), F.col("section")], edges, "acts", "act_name", "section"),
        nested(cites, "source_case_id", [F.desc("confidence"), F.col("target_citation"), F.col("created_at")], edges, "citations_out", "target_citation"),
        nested(pairs, "cited_case_id", [F.desc("confidence"), F.col("source_case_id"), F.col("created_at")], edges, "citations_in", "source_case_id"),
        nested(paras.where(F.col("para_no") < first), "case_id", [F.col("para_no")], first, "paragraphs", "para_no", "text"),
    ]
    out = cases
    for part in parts:
        out = out.join(part, "case_id", "left")
    return out.withColumn("cited_by_count", F.coalesce("cited_by_count", F.lit(0)))
