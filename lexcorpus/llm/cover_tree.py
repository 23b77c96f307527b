"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Vectors are dealt to cells around pivots (a bounded sample of `pivots` vectors), large cells are
split by a hash, and each block gets a cover tree: a node's children are centres more than half
its scale apart, every point lies within that scale of its centre, and each node keeps the
distance to its farthest point as covering radius. Queries get trees in the same way.

For a query node with centre c, radius r and a data node with centre x, radius s, no pair's inner
product exceeds c.x + |c| s + |x| r + r s. A node pair is dropped when that lies below the worst
kth score that any query of the node has so far. A first pass over each query group's own block
gives those scores a start; the second pass meets all blocks, as a grid of query and data shards.

Scores are exact for components that are whole numbers (sums below 2**53). Ties go to the smaller
id. A query never meets rows of its own id. Vectors that are null, empty or hold a null or
non-finite component take no part, nor do null ids; only vectors of equal length are compared.
Repeated rows of one id are separate candidates; as queries, equal rows count once, and different
vectors of one id share one list. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexcorpus.llm.common import checkpointed

#: Points in a block of data and in a group of queries; points that a node holds without children.
BLOCK, GROUP, LEAF = 2048, 512, 32
#: Trees that meet in one cell of the grid, on either side.
GROUPS_A_CELL, BLOCKS_A_CELL = 4, 8


class Node:
    """`own`: points met at this node itself; `every`: those and all points of its children."""

    __slots__ = ("centre", "radius", "norm", "own", "children", "every")

    def __init__(self, centre: np.ndarray, radius: float, own: np.ndarray, children: list[Node], every: np.ndarray):
        self.centre, self.radius, self.norm = centre, radius, float(np.sqrt(centre @ centre))
        self.own, self.children, self.every = own, children, every

    def __reduce__(self):
        return Node, (self.centre, self.radius, self.own, self.children, self.every)


def build(points: np.ndarray) -> Node:
    """The cover tree of a block of points; the first one is the root's centre."""
    length = (points**2).sum(axis=1)
    square = np.maximum(0, length[:, None] + length[None, :] - 2 * points @ points.T)  # a block is small

    def below(rows: np.ndarray, scale: float) -> Node:
        centre = points[rows[0]]
        radius = float(np.sqrt(square[rows[0], rows].max()))
        scale = min(scale, radius)
        if len(rows) <= LEAF or radius == 0:
            return Node(centre, radius, rows, [], rows)
        half, left, single, children = scale / 2, rows, [], []
        while len(left):
            near = square[left[0], left] <= half * half
            if near.sum() == 1:
                single.append(left[near])
            else:
                children.append(below(left[near], half))
            left = left[~near]
        return Node(centre, radius, np.concatenate([rows[:0], *single]), children, rows)

    return below(np.arange(len(points)), math.inf)


class Search:
    """The best k of every query so far, and its traversals."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, worst: np.ndarray):
        self.queries, self.ids, self.k, self.worst = queries, ids, k, worst.copy()
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)

    def _meet(self, rows: np.ndarray, points: np.ndarray, point_ids: np.ndarray) -> None:
        scores = self.queries[rows] @ points.T
        scores[self.ids[rows][:, None] == point_ids[None, :]] = -np.inf
        limit = self.worst[rows]
        if len(point_ids) > self.k:
            limit = np.maximum(limit, np.partition(scores, -self.k, axis=1)[:, -self.k])
        good = (scores >= limit[:, None]) & (scores > -np.inf)
        for at in np.flatnonzero(good.any(axis=1)):
            r, some = rows[at], good[at]
            ids = np.concatenate([self.found[r][1], point_ids[some]])
            values = np.concatenate([self.found[r][2], scores[at, some]])
            best = np.lexsort((ids, -values))[: self.k]
            self.found[r] = (best, ids[best], values[best])
            if len(best) == self.k:
                self.worst[r] = max(self.worst[r], values[best[-1]])

    def visit(self, q: Node, d: Node, points: np.ndarray, point_ids: np.ndarray) -> None:
        bound = q.centre @ d.centre + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        if bound + 1e-6 * (1 + abs(bound)) < self.worst[q.every].min():
            return
        if len(d.own):
            self._meet(q.every, points[d.own], point_ids[d.own])
        if not d.children:
            return
        # The query side goes down with the data side; what it holds itself goes on as a leaf.
        below = [*q.children, *([Node(q.centre, q.radius, q.own, [], q.own)] if len(q.own) else [])] if q.children else [q]
        centres, radii, norms = np.stack([c.centre for c in d.children]), np.array([c.radius for c in d.children]), np.array([c.norm for c in d.children])
        for part in below:
            bounds = centres @ part.centre + part.norm * radii + norms * part.radius + part.radius * radii
            for c in np.argsort(-bounds, kind="stable"):
                self.visit(part, d.children[c], points, point_ids)


def _trees(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Blocks of about `size` rows with their trees: cell, part, tree (binary)."""

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        square = (pivots**2).sum(axis=1)
        for vectors in batches:
            x = np.stack(vectors.to_list()).astype(float) if len(vectors) else np.zeros((0, pivots.shape[1]))
            yield pd.Series(np.argmin(square - 2 * x @ pivots.T, axis=1).astype(np.int32))

    placed = checkpointed(rows.withColumn("cell", nearest("vector")))
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most one per pivot
    parts = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, math.ceil(n / size))]) if counts else F.create_map().cast("map<int,int>")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.element_at(parts, F.col("cell"))).cast("int"))

    def built(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        points = np.stack(pdf["vector"].to_list()).astype(float)
        blob = pickle.dumps((build(points), points, pdf["id"].to_numpy(dtype=np.int64)))
        return pd.DataFrame([(*key, len(pdf), blob)], columns=["cell", "part", "n", "tree"])

    return dealt.groupBy("cell", "part").applyInPandas(built, "cell int, part int, n int, tree binary")


def _searched(groups: Iterator, k: int) -> Iterator[tuple[np.ndarray, list, Search]]:
    """Runs the traversals of query trees with the worst scores they start from, against data trees."""
    for query, worst, data in groups:
        node, points, ids = pickle.loads(query)
        search = Search(points, ids, k, np.full(len(ids), -np.inf) if worst is None else np.frombuffer(worst))
        trees = [pickle.loads(t) for t in data]
        order = np.argsort([-(points.mean(axis=0) @ t[0].centre) for t in trees])
        for t in order:
            search.visit(node, *trees[t])
        yield ids, trees, search


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "vector", k: int = 20, pivots: int = 64) -> DataFrame:
    """query_id, rank, `id_col` and score of the `k` best partners of every row that is a query."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fit = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    rows = fit.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    lengths = [r.n for r in rows.groupBy(F.size("vector").alias("n")).count().collect()]
    made = [_top_k_of(rows.where(F.size("vector") == n), k, pivots) for n in lengths]
    if not made:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _top_k_of(rows: DataFrame, k: int, pivots: int) -> DataFrame:
    pivots = max(1, min(pivots, rows.count() // (BLOCK // 2)))
    centres = np.array([r.vector for r in rows.orderBy(F.xxhash64("id", "vector"), "id").limit(pivots).collect()], dtype=float)
    data = checkpointed(_trees(rows.select("id", "vector"), centres, BLOCK))
    queries = checkpointed(_trees(rows.where("is_query").select("id", "vector").distinct(), centres, GROUP))

    # First pass: each query group against one block of its own cell.
    home = data.where("part = 0").select("cell", F.col("tree").alias("data"))

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [s.worst.tobytes() for _, _, s in _searched(((q, None, [d] if d is not None else []) for q, d in zip(pdf["tree"], pdf["data"], strict=True)), k)]
            yield pdf[["cell", "part", "tree"]].assign(worst=made)

    started_rows = checkpointed(queries.select("cell", "part", "tree").join(home, "cell", "left").mapInPandas(started, "cell int, part int, tree binary, worst binary"))

    # Second pass: all groups against all blocks, in a grid of shards.
    wide, high = (max(1, math.ceil(x.count() / n)) for x, n in ((queries, GROUPS_A_CELL), (data, BLOCKS_A_CELL)))
    left = started_rows.withColumn("i", F.pmod(F.xxhash64("cell", "part"), F.lit(wide)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    right = data.withColumn("j", F.pmod(F.xxhash64("part", "cell"), F.lit(high)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))

    def met(groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, _, search in _searched(((q, w, list(blocks["tree"])) for q, w in zip(groups["tree"], groups["worst"], strict=True)), k):
            own = np.repeat(ids, [len(f[1]) for f in search.found])
            out.append(pd.DataFrame({"query_id": own, "id": np.concatenate([f[1] for f in search.found]), "score": np.concatenate([f[2] for f in search.found])}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    pairs = left.select("i", "j", "tree", "worst").groupBy("i", "j").cogroup(right.select("i", "j", "tree").groupBy("i", "j")).applyInPandas(met, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
