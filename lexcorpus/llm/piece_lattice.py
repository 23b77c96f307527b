"""SentencePiece encoding and decoding as relational work over a lattice of pieces.

A text is escaped (a word mark in front and for every space), cut into words before marks and
around line ends, and words again into units, wherever no piece of the vocabulary holds the two
letters that meet: no edge of the lattice crosses such a border, so the best path of a text is the
best paths of its units in a row. Per unit, all substrings up to the longest piece are exploded and
equi-joined to the piece table, edges are grouped by unit, and a higher-order aggregate folds them,
edge by edge, into the best path: the largest sum of piece scores, ties to the earlier start. A
letter that is no piece is a unit of its own and is written as the byte pieces of its UTF-8. This
is the unigram reading of the table's scores: a merge-ordered vocabulary's scores are its ranks, and
the same path comes out as from the sentencepiece library on the same pieces in unigram mode, not as
from its merges. Units of every length take the same way: long ones are exploded block by block, and
the fold keeps the scores of the last letters only.

`encode` looks the words that are frequent in a bounded sample up in a broadcast table of their
paths, which the lattice made before; that choice changes how fast it is, never what comes out. Texts
are cut once, in chunks of some thousand rows that are written in buckets: what the table gave, with a
hole for each other unit, and these units once. The units of all chunks are encoded once each, written in
buckets by unit, meet their chunks there and come to them once; texts are not shuffled.

Null and empty texts have no pieces. Repeated texts get equal ids, rows keep their number; other
columns pass through, but one with the output's name is replaced. Letters that are no Unicode text
(lone surrogates cannot occur in a Spark string) are not expected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexcorpus.llm.common import bucketed, checkpointed

MARK = "▁"
#: Letters of a unit that are exploded and folded in one block.
BLOCK = 64
#: Edges of a unit that are folded in one chunk.
CHUNK = 256
#: Letters of units in one partition, so that their edges (two a letter or so) fit in memory.
CHARS_A_PARTITION = 300_000
#: Rows of the sample in which frequent words are sought, words whose paths are broadcast, and the longest of them.
SAMPLE_ROWS, FREQUENT, FREQUENT_LENGTH = 20_000, 100_000, 32
#: Letters of texts (and one text more at most) in one chunk, and chunks of a partition when the paths come back to them.
CHUNK_LETTERS, CHUNKS_A_PARTITION = 4_000_000, 4
#: Fixed value: what an unknown letter scores below the least piece.
UNKNOWN_PENALTY = 10.0

_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: An edge is one long: its end, its length (in so many bits) and its id (likewise), so that edges sort by them in turn.
_LENGTH, _ID = 6, 31
#: The id of an edge over an unknown letter is this and its code point.
UNKNOWN = 1 << 30


class Pieces:
    """The piece table of a model file: normal pieces with ids and scores, and the byte pieces."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(model.get_piece_size())
        self.normal = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        bytes_ = [i for i in every if model.is_byte(i)]
        if [model.id_to_piece(i) for i in bytes_] != [f"<0x{b:02X}>" for b in range(256)] or bytes_ != list(range(bytes_[0], bytes_[0] + 256)):
            raise ValueError("the vocabulary has no byte pieces in a row")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, *_ in self.normal):
            raise ValueError("a piece crosses the border of a word")
        self.size, self.first_byte, self.longest = len(every), bytes_[0], max(len(p) for p, *_ in self.normal)
        self.unknown = min(s for *_, s in self.normal) - UNKNOWN_PENALTY
        self.pairs = {p[i : i + 2] for p, *_ in self.normal for i in range(len(p) - 1)}
        if self.longest >= 1 << _LENGTH or self.size >= UNKNOWN:
            raise ValueError("a piece is longer than a block, or there are too many")
        if not {c for p, *_ in self.normal for c in p} <= {p for p, *_ in self.normal}:
            raise ValueError("a letter of a piece is no piece")  # it would stand alone only as an unknown one

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, piece_score; its size is that of the vocabulary."""
        return spark.createDataFrame(self.normal, "piece string, id int, piece_score double")

    def scores(self) -> Column:
        """Per id its score, as a constant array."""
        known = {i: s for _, i, s in self.normal}
        return F.split(F.lit(",".join(repr(known.get(i, self.unknown)) for i in range(self.size))), ",").cast("array<double>")

    def hexes(self) -> Column:
        """Per id the UTF-8 it stands for, as hexadecimal digits; nothing for control ids."""
        known = {i: p.replace(MARK, " ").encode().hex() for p, i, _ in self.normal} | {self.first_byte + b: f"{b:02x}" for b in range(256)}
        return F.split(F.lit(",".join(known.get(i, "") for i in range(self.size))), ",")

    def units(self, word: str) -> list[str]:
        """`word` cut wherever no piece can cross."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks(letters: int, size: int) -> int:
    return max(1, -(-letters // size))


def words_of(text: str) -> list[str]:
    """The words of a text; joined together they are the escaped text."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def _length(edge: Column) -> Column:
    return F.shiftright(edge, _ID).bitwiseAND(F.lit((1 << _LENGTH) - 1)).cast("int")


def _id(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit((1 << _ID) - 1)).cast("int")


def _end(edge: Column) -> Column:
    return F.shiftright(edge, _ID + _LENGTH)


def _fold(edges: Column, pieces: Pieces) -> Column:
    """Per position of a unit the best score up to it and the edge that ends there, as one array for each `CHUNK` of edges.

    Edges are sorted, so those of one end are neighbours and the longer ones come later. A chunk's
    array starts with the last `longest + 1` positions of the one before it, from which its own
    edges may start; the last of them is still open, as edges of the same end may follow.
    """
    # A letter without a piece has an id beyond the table.
    score = lambda e: F.coalesce(F.get(pieces.scores(), _id(e)), F.lit(pieces.unknown))
    start = F.array(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("edge"))))

    def settled(path: Column, e: Column) -> Column:
        last = F.element_at(path, -1)
        reached = lambda back: F.element_at(path, F.negative(back))["score"] + score(e)
        at = lambda back: F.struct(reached(back).alias("score"), e.alias("edge"))
        opened = F.array_append(path, at(_length(e)))
        replaced = F.array_append(F.slice(path, F.lit(1), F.size(path) - 1), at(_length(e) + 1))
        return F.when(_end(e) > _end(last["edge"]), opened).when(reached(_length(e) + 1) >= last["score"], replaced).otherwise(path)

    def chunk(paths: Column, c: Column) -> Column:
        last = F.element_at(paths, -1)
        tail = F.when(F.size(last) > pieces.longest + 1, F.slice(last, F.lit(-pieces.longest - 1), pieces.longest + 1)).otherwise(last)
        return F.array_append(paths, F.aggregate(F.slice(edges, c * CHUNK + 1, F.lit(CHUNK)), tail, settled))

    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / CHUNK).cast("int")), start, chunk)


def _positions(paths: Column, longest: int) -> Column:
    """The arrays of `_fold` as one, with an element for each position after the start.

    Of each array remain its own positions and the one that was open when it began; the one that it
    leaves open is taken from the next.
    """
    last = F.size(paths) - 1

    def own(path: Column, k: Column) -> Column:
        repeated = F.least(F.size(F.get(paths, k - 1)), F.lit(longest + 1))
        return F.when(k == 0, F.slice(path, F.lit(1), F.lit(0))).otherwise(F.slice(path, repeated, F.size(path) - repeated + F.when(k == last, 1).otherwise(0)))

    every = F.flatten(F.transform(paths, own))
    return F.slice(every, F.lit(2), F.size(every))


def _ids(edges: Column) -> Column:
    """The ids along a path, from its last position (`edges` holds the best one for each) back to the first."""
    start = F.struct(F.size(edges).alias("at"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<array<int>>").alias("filled"))

    def back(state: Column, j: Column) -> Column:
        edge = F.get(edges, j - 1)
        at = (j - _length(edge)).alias("at")
        full = F.struct(at, F.array(_id(edge)).alias("ids"), F.array_append(state["filled"], state["ids"]).alias("filled"))
        room = F.struct(at, F.array_append(state["ids"], _id(edge)).alias("ids"), state["filled"].alias("filled"))
        return F.when(state["at"] != j, state).when(F.size(state["ids"]) < BLOCK, room).otherwise(full)

    return F.aggregate(F.sequence(F.size(edges), F.lit(1), F.lit(-1)), start, back, lambda s: F.reverse(F.flatten(F.array_append(s["filled"], s["ids"]))))


def _byte_ids(code_point: Column, first_byte: int) -> Column:
    letter = F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")
    digits = F.hex(F.encode(letter, "utf-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + first_byte)


def best_paths(units: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """Best path of each row's `unit`: keys, score, ids.

    Keys must be distinct; units must be cut as `Pieces.units` does, in which a letter that is no
    piece stands alone. A null unit has no ids and no score. Where `units` is already distributed
    by some of the keys, nothing is shuffled.
    """
    named = [f"k{i}" for i in range(len(keys))]
    n = F.length("unit").alias("n")
    own = units.select(*[F.col(k).alias(a) for k, a in zip(keys, named, strict=True)], "unit", n)
    blocks = own.select(*named, "unit", "n", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int")))).alias("block"))
    # A block's part starts `longest - 1` letters before the block itself, so that it holds all edges that end in it.
    base = F.greatest(F.lit(0), F.col("block") * BLOCK - pieces.longest + 1).alias("base")
    reach = F.substring("unit", base + 1, (F.col("block") + 1) * BLOCK - base)
    parts = blocks.select(*named, "n", base, (F.col("block") * BLOCK - base).alias("ahead"), F.when(F.col("n") <= BLOCK, F.col("unit")).otherwise(reach).alias("part"))
    sized = parts.select(*named, "n", "base", "ahead", "part", F.length("part").alias("here"))
    starts = sized.select(*named, "n", "base", "ahead", "part", "here", F.explode_outer(F.sequence(F.lit(0), F.col("here") - 1)).alias("start"))
    bounded = F.sequence(F.greatest(F.lit(1), F.col("ahead") - F.col("start") + 1), F.least(F.lit(pieces.longest), F.col("here") - F.col("start")))
    spans = starts.select(*named, "n", "base", "part", "start", F.explode_outer(F.when(F.col("start").isNotNull(), bounded)).alias("length"))
    end = (F.col("base") + F.col("start") + F.col("length")).cast("long").alias("end")
    cut = spans.select(*named, "n", end, F.col("length").cast("long").alias("length"), F.substring("part", F.col("start") + 1, F.col("length")).alias("piece"))
    met = cut.join(F.broadcast(pieces.table(units.sparkSession)), "piece", "left").where(F.col("id").isNotNull() | F.col("n").isNull() | (F.col("n") <= 1))
    value = F.coalesce(F.col("id"), F.lit(UNKNOWN) + F.ascii("piece")).cast("long")
    edge = F.shiftleft("end", _ID + _LENGTH).bitwiseOR(F.shiftleft("length", _ID)).bitwiseOR(value)
    by_unit = met.groupBy(*named).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    folded = by_unit.select(*named, F.when(F.size("edges") > 0, _fold(F.col("edges"), pieces)).alias("paths"))
    placed = folded.select(*named, _positions(F.col("paths"), pieces.longest).alias("positions"))
    found = placed.select(*named, F.element_at("positions", -1)["score"].alias("score"), F.col("positions.edge").alias("edges"))
    first = _id(F.get("edges", F.lit(0)))
    ids = F.when(first >= UNKNOWN, _byte_ids(first - UNKNOWN, pieces.first_byte)).otherwise(_ids(F.col("edges")))
    return found.select(*[F.col(a).alias(k) for k, a in zip(keys, named, strict=True)], "score", ids.alias("ids"))


def _made(units: DataFrame, pieces: Pieces, partitions: int) -> DataFrame:
    """unit and ids of the distinct units of `units`, as a table in so many buckets by unit.

    A partition's groups fit in memory, so they are aggregated by hash instead of sorted.
    """
    conf, name = units.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(name)
    conf.set(name, str(CHARS_A_PARTITION))
    try:
        spread = units.repartition(partitions, "unit").distinct()
        return bucketed(best_paths(spread, pieces, ["unit"]).select("unit", "ids"), partitions, "unit")
    finally:
        conf.set(name, before)


def frequent_words(df: DataFrame, pieces: Pieces, total: int, kind: str, text_col: str = "text") -> dict[str, bytes]:
    """Paths of the words and units that are most frequent in a bounded sample of `total` texts, as ids of dtype `kind`."""
    sample = df.select(F.col(text_col).alias("text")).sample(min(1.0, SAMPLE_ROWS / max(1, total)), seed=1)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(words_of(text or ""))
            if len(counts) > FREQUENT:
                yield pd.DataFrame(counts.items(), columns=["word", "n"])
                counts.clear()
        yield pd.DataFrame(counts.items(), columns=["word", "n"])

    @F.pandas_udf("array<string>")
    def cut(words: pd.Series) -> pd.Series:
        return words.map(lambda w: pieces.units(w) if len(w) <= FREQUENT_LENGTH else [])

    words = sample.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    named = words.select("n", F.col("word"), F.explode(F.array_union(F.array("word"), cut("word"))).alias("part"))
    best = named.where(F.length("part") <= FREQUENT_LENGTH).groupBy("part").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "part").limit(FREQUENT)
    chosen = checkpointed(best.select("part", F.explode(cut("part")).alias("unit")))
    letters = chosen.agg(F.sum(F.length("unit"))).first()[0] or 0
    known = {r.unit: np.array(r.ids, dtype=kind).tobytes() for r in _made(chosen.select("unit"), pieces, blocks(letters, CHARS_A_PARTITION)).collect()}  # at most FREQUENT words of FREQUENT_LENGTH letters
    return {w: b"".join([known[u] for u in pieces.units(w)]) for (w,) in chosen.select("part").distinct().collect()}


def _pressed(codes: np.ndarray) -> bytes:
    """Codes of 32 bits, their lower and upper halves apart: the upper ones are nearly all 0."""
    halves = codes.view("<u2").reshape(-1, 2)
    return zstandard.ZstdCompressor(level=3).compress(halves.T.tobytes())


def _codes(frame: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), "<u2")
    return np.ascontiguousarray(halves.reshape(2, -1).T).view("<u4").ravel()


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `out_col`: the ids of each whole text (empty for null and empty texts), to the columns in `keep` (default: all)."""
    pieces = Pieces(model_path)
    total, letters = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    table = df.sparkSession.sparkContext.broadcast(frequent_words(df, pieces, total, "<u4", text_col))
    size = pieces.size  # code size + k is the k-th of the units of a chunk that the lattice is still to encode

    def chunk(texts: list[str | None]) -> tuple[bytes, list[int], list[str]]:
        known, units, rare, parts, lengths = table.value.get, {}, {}, [], []
        for text in texts:
            words = words_of(text or "")
            found = list(map(known, words))
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        word = words[k]
                        if word not in rare:
                            own = [known(u) or (size + units.setdefault(u, len(units))).to_bytes(4, "little") for u in pieces.units(word)]
                            rare[word] = b"".join(own)
                        found[k] = rare[word]
            parts.append(b"".join(found))
            lengths.append(len(parts[-1]) // 4)
        return _pressed(np.frombuffer(b"".join(parts), "<u4")), lengths, list(units)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(sizes // CHUNK_LETTERS, append=-1)) + 1
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                rows = batch.slice(start, end - start)
                frame, lengths, units = chunk(rows.column("text").to_pylist())
                one = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("columns"))
                yield pa.RecordBatch.from_arrays([one, pa.array([frame], pa.binary()), pa.array([lengths], pa.list_(pa.int32())), pa.array([units], pa.list_(pa.string()))], ["rows", "frame", "lengths", "units"])

    others = [c for c in df.columns if c != out_col and (keep is None or c in keep)]
    columns = F.struct(F.lit(None).cast("int").alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("columns")
    taken = df.select(F.col(text_col).cast("string").alias("text"), columns)
    schema = T.StructType([T.StructField("rows", T.ArrayType(taken.schema["columns"].dataType)), T.StructField("frame", T.BinaryType()), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("units", T.ArrayType(T.StringType()))])
    # Chunks are numbered in what is written, so that their numbers stay when an executor is lost later on.
    cuts = taken.mapInArrow(cut, schema).withColumn("chunk", F.monotonically_increasing_id())
    wide = blocks(letters, CHUNKS_A_PARTITION * CHUNK_LETTERS)
    named = bucketed(cuts, wide, "chunk") if keep is not None else checkpointed(cuts)  # Parquet cannot hold every type
    left = named.select(F.explode("units").alias("unit"))
    parts = blocks(left.agg(F.coalesce(F.sum(F.length("unit")), F.lit(0))).first()[0], CHARS_A_PARTITION)
    paths = _made(left, pieces, parts)
    places = named.select("chunk", F.posexplode("units").alias("k", "unit")).repartition(parts, "unit").join(paths, "unit")
    found = places.select("chunk", "k", "ids").repartition(wide, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("k", "ids")).alias("paths"))
    whole = named.select("chunk", "rows", "frame", "lengths").join(found, "chunk", "left").select("rows", "frame", "lengths", "paths.k", "paths.ids")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows, frame, lengths, k, ids = (c[at] for c in batch.columns)
                codes = _codes(frame.as_py())
                each, starts, values = np.ones(len(codes), np.int64), np.zeros(len(codes), np.int64), codes.astype(np.int32)
                hole = codes >= size
                if hole.any():
                    lists = ids.values
                    place = np.argsort(k.values.to_numpy())[codes[hole] - size]
                    many = pc.list_value_length(lists).to_numpy()
                    each[hole], starts[hole] = many[place], (np.cumsum(many) - many)[place]
                    inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    gather, values = np.repeat(hole, each), np.repeat(values, each)
                    values[gather] = lists.flatten().to_numpy()[(np.repeat(starts, each) + inner)[gather]]
                ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])]
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.values, made], ["columns", "ids"])

    out = T.StructType([taken.schema["columns"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return whole.mapInArrow(filled, out).select(*[F.col(f"columns.c{k}").alias(c) for k, c in enumerate(others)], F.col("ids").alias(out_col))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds `out_col`: the text of each row's ids, word marks as spaces; the mark in front is kept.

    Control ids and ids outside the vocabulary stand for nothing, bytes that are no UTF-8 become
    replacement characters. Empty or null ids give an empty text.
    """
    table = Pieces(model_path).hexes()
    digits = F.array_join(F.transform(F.col(ids_col), lambda i: F.when(i >= 0, F.get(table, i))), "")
    return df.withColumn(out_col, F.coalesce(F.make_valid_utf8(F.unhex(digits).cast("string")), F.lit("")))
