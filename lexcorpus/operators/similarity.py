"""Joins of alike strings: names by the three-letter pieces they share, words by their edits.

`similar_names` compares names in a grid of blocks, to which only the names and their words are shuffled: bits that
stand for their pieces tell which pairs can be alike, and only the pieces of these are counted. `within_edits` cuts every known
word in one segment more than edits are allowed, of which a word within reach must hold one in
nearly the same place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexcorpus.functions import text as X
from lexcorpus.operators import cells

#: Names in one block of either side, pairs that are counted at once, and words of 64 bits that stand for the pieces of a name.
RIGHT_A_BLOCK, LEFT_A_BLOCK, CELLS_AT_ONCE, WORDS = 131_072, 131_072, 2_000_000, 4


def _pieces(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each distinct three-letter piece of some names (words with a space between), as `X.trigrams` cuts them; by row."""
    rows = words.to_pylist()
    letters = np.frombuffer("".join(f"  {w.replace(' ', '   ')} \0" for w in rows).encode("utf-32-le"), np.uint32).astype(np.int64)
    first, second, third = letters[:-2], letters[1:-1], letters[2:]
    whole = (first != 0) & (second != 0) & (third != 0) & ~((second == 32) & (third == 32))  # neither from one word nor from one name to the next
    piece = (first << 42 | second << 21 | third)[whole]
    row = np.cumsum(letters == 0)[:-2][whole]
    order = np.lexsort((piece, row))
    row, piece = row[order], piece[order]
    once = (np.diff(row, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0)
    return row[once], piece[once]


def _bits(row: np.ndarray, piece: np.ndarray, rows: int) -> np.ndarray:
    """WORDS x rows: for each piece of a row one bit in each word; pieces may share bits."""
    made = np.zeros((WORDS, rows), np.uint64)
    for k in range(WORDS):
        at = (piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(58)
        np.bitwise_or.at(made[k], row, np.uint64(1) << at)
    return made


def _alike(threshold: float) -> cells.Maker:
    """Pairs (a, b, similarity) of names (name, words) with their similarity over the threshold.

    Of its pieces a name may lack only so many in another, and it lacks at least as many as bits of it are not set there.
    """
    least = threshold / (1 + threshold)

    def make(block: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        owner, piece = _pieces(block["words"])
        known, number = np.unique(piece, return_inverse=True)
        n, names = block.num_rows, block["name"].combine_chunks()
        size = np.bincount(owner, minlength=n)
        starts = np.cumsum(size) - size
        unset = ~_bits(owner, piece, n)
        lacking, many = np.empty(n, np.uint64), np.empty(n, np.uint8)
        beyond: dict[int, np.ndarray] = {}  # by the pieces of a name: how many bits are too many, for each name of the block

        def match(left: pa.Table) -> Iterator[pa.RecordBatch]:
            asked, rows = left["name"].combine_chunks(), left.num_rows
            row, pieces = _pieces(left["words"])
            own = np.bincount(row, minlength=rows)
            begins = np.searchsorted(row, np.arange(rows + 1))
            place = np.minimum(np.searchsorted(known, pieces), len(known) - 1)
            held = known[place] == pieces
            bits = _bits(row, pieces, rows)
            a, b, waiting = [], [], 0
            for r in range(rows):
                k = int(own[r])
                if k not in beyond:
                    beyond[k] = np.clip(np.floor(k - (k + size) * least + 1e-6) + 1, 0, 255).astype(np.uint8)
                np.bitwise_count(np.bitwise_and(unset[0], bits[0, r], out=lacking), out=many)
                some = np.flatnonzero(many < beyond[k])
                for w in range(1, WORDS):
                    some = some[np.bitwise_count(unset[w, some] & bits[w, r]) < beyond[k][some]]
                a.append(np.full(len(some), r))
                b.append(some)
                waiting += len(some)
                if waiting * 32 >= CELLS_AT_ONCE or len(a) * len(known) >= 16 * CELLS_AT_ONCE or r == rows - 1:
                    yield counted(asked, np.concatenate(a), np.concatenate(b), own, (begins, place, held))
                    a, b, waiting = [], [], 0

        def counted(asked: pa.Array, a: np.ndarray, b: np.ndarray, own: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            """Of some pairs of rows those that are alike, by the pieces they share."""
            begins, place, held = pieces
            several, at = np.unique(a, return_inverse=True)
            has = np.zeros((len(several), len(known)), bool)
            for k, r in enumerate(several):
                mine = slice(begins[r], begins[r + 1])
                has[k, place[mine][held[mine]]] = True
            times = size[b]
            ends = np.cumsum(times)
            entries = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[b] - (ends - times), times)
            pair = np.repeat(np.arange(len(b)), times)
            together = np.bincount(pair[has[at[pair], number[entries]]], minlength=len(b))
            alike = together / (own[a] + size[b] - together)
            fit = alike > threshold
            return pa.RecordBatch.from_arrays([asked.take(pa.array(a[fit])), names.take(pa.array(b[fit])), pa.array(alike[fit])], ["a", "b", "similarity"])

        return match

    return make


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Distinct pairs (a, b, similarity) of left (name) and right (name) whose piece similarity is over `threshold`.

    Null names and names without a word meet none.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    cut = lambda names: names.select("name").distinct().select("name", F.array_join(X.tokens(F.col("name")), " ").alias("words")).where("words <> ''")
    a, b = cut(left), cut(right)
    numbers = cells.blocks(b.count(), RIGHT_A_BLOCK), cells.streamed(a.count(), LEFT_A_BLOCK, left.sparkSession)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("similarity", T.DoubleType())])
    return cells.met(b, a, ("name", "name"), numbers, _alike(threshold), schema)


def _segments(length: Column, edits: Column) -> Column:
    """start (from 1) and size of the edits + 1 segments of a word; the last ones are the longer."""
    parts = edits + 1
    size = F.floor(length / parts).cast("int")
    short = parts - length % parts
    return F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.struct(i.alias("no"), (i * size + F.greatest(i - short, F.lit(0)) + 1).cast("int").alias("start"), F.when(i < short, size).otherwise(size + 1).cast("int").alias("size")),
    )


def within_edits(asked: DataFrame, vocabulary: DataFrame, same_start: int = 0) -> DataFrame:
    """asked (word, most) x vocabulary (token): distinct pairs within `most` edits (0, 1 or 2), with the edits.

    `same_start` letters in front must be equal. A word within `most` edits of a token leaves one of the
    token's most + 1 segments as it is, moved by at most `most` letters, so pairs meet on the token's length,
    the segment's number and its letters. Work grows with the length of a word, not with its square. Null and empty words meet none.
    """
    words = asked.select("word", F.col("most").cast("int").alias("most")).where("word <> '' and most between 0 and 2").distinct()
    start = F.substring("word", 1, same_start) if same_start else F.lit("")
    lengths = F.filter(F.sequence(F.length("word") - F.col("most"), F.length("word") + F.col("most")), lambda n: n > F.col("most"))
    each = words.select("word", "most", start.alias("start"), F.explode(lengths).alias("length"))
    each = each.select("*", F.inline(_segments(F.col("length"), F.col("most"))).alias("no", "at", "size"))
    places = F.sequence(F.greatest(F.col("at") - F.col("most"), F.lit(1)), F.least(F.col("at") + F.col("most"), F.length("word") - F.col("size") + 1))
    reach = F.greatest(F.col("at") - F.col("most"), F.lit(1)) <= F.least(F.col("at") + F.col("most"), F.length("word") - F.col("size") + 1)
    held = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("word"), p, F.col("size"))))
    left = each.where(reach).select("word", "most", "start", "length", "no", F.explode(held).alias("segment"))
    # Only words of lengths that are asked for are cut, once for each number of edits.
    low, high = words.agg(F.min(F.length("word") - F.col("most")), F.max(F.length("word") + F.col("most"))).first()
    known = vocabulary.select("token").where("token <> ''").distinct().where(F.length("token").between(low or 0, high or 0))
    head = F.substring("token", 1, same_start) if same_start else F.lit("")
    cut = known.select("token", head.alias("start"), F.length("token").alias("length"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("most")).where("length > most")
    cut = cut.select("token", "start", "length", "most", F.inline(_segments(F.col("length"), F.col("most"))).alias("no", "at", "size"))
    right = cut.select("token", "start", "length", "most", "no", F.substring(F.col("token"), F.col("at"), F.col("size")).alias("segment"))
    pairs = left.join(right, ["start", "length", "most", "no", "segment"]).select("word", "most", "token").distinct()
    near = pairs.withColumn("edits", F.levenshtein("word", "token", 2)).where((F.col("edits") >= 0) & (F.col("edits") <= F.col("most")))
    return near.select("word", "most", "token", "edits")
