"""N-gram Jaccard join by MinHash banding, and the near-duplicate classes of its links.

Texts are sets of `n`-grams of lower-case words. Equal sets make one node that counts its copies,
so copies are never paired. Nodes are shuffled on the hashes of their MinHash bands; the numbers
of bands and rows follow from a target recall at the threshold. All pairs that share a bucket are
verified on their full n-gram sets: a bucket is cut into blocks of bounded size, each pair of
blocks is one cell of work, and a pair counts only in the first bucket it shares. A cell returns,
for each node, how many documents it links to and the root of its links within the cell; pairs
themselves are never written. Classes are the connected components of those links.

Texts of fewer words than `n` are one n-gram of all their words. Null texts and texts without a
word have no n-gram: they link to nothing, and each is a class of its own. Null and repeated ids
are allowed: rows are told apart by id and text, and a class takes the least non-null id of its
members. Every row of the input gives one row, repeated rows included; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.llm import substrings
from lexcorpus.llm.common import checkpointed, hashable
from lexcorpus.llm.components import components
from lexcorpus.llm.langid import chunks

#: Distinct words whose hashes a worker remembers; nodes in a block of a bucket.
CACHE_ENTRIES, BLOCK = 400_000, 256
#: Members from which a group is large, and at most so many groups of that share of all rows.
LARGE = 10_000

_WORD = re.compile(r"\w+")


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows per band): the most rows with which pairs at the threshold still meet as asked."""
    for rows in range(most_hashes, 0, -1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no number of bands reaches this recall; raise most_hashes")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly over their range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashed n-grams of words of many texts at once."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.factors = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram hashes of all texts, one after another; how many each has). Repeats are kept."""
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*words) - self.known.keys())
        self.known.update(zip(new, _mix(substrings.hashes(new)).tolist(), strict=True))
        counts = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.fromiter((h for w in words for h in map(self.known.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
        width = np.minimum(counts, self.n)  # the words of each n-gram of a text
        made = np.where(counts > 0, counts - width + 1, 0)
        first = np.repeat(np.cumsum(counts) - counts, made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
        each, total = np.repeat(width, made), np.repeat(width, made).astype(np.uint64)
        for k in range(self.n):
            inside = each > k
            total[inside] += flat[first[inside] + k] * self.factors[k]
        return _mix(total), made


def _signatures(shingler: Shingler, texts: list[str | None], bands: int, rows: int) -> tuple[list[bytes | None], list[list[int] | None]]:
    """Fingerprint of each text's set of n-grams, and its band hashes; null where it has none."""
    grams, made = shingler(texts)
    full = np.flatnonzero(made)
    if not len(full):
        return [None] * len(texts), [None] * len(texts)
    starts = (np.cumsum(made) - made)[full]
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.zeros((len(full), bands), dtype=np.uint64)
    for k, seed in enumerate(seeds):
        least = np.minimum.reduceat(grams * seed, starts)
        keys[:, k // rows] = _mix(keys[:, k // rows] + least + np.uint64(k % rows + 1))
    prints: list = [None] * len(texts)
    found: list = [None] * len(texts)
    for r, at, count, key in zip(full.tolist(), starts.tolist(), made[full].tolist(), keys.view(np.int64).tolist(), strict=True):
        prints[r] = xxhash.xxh128_digest(np.unique(grams[at : at + count]).tobytes())
        found[r] = key
    return prints, found


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, decided on the whole sets."""
    sizes = np.array([len(s) for s in [*left, *right]])
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    both, n = np.zeros((len(left), len(right))), int(shared.sum())
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, n, 4096):
        lo, hi = np.searchsorted(place, [at, at + 4096])
        part = np.zeros((len(sizes), min(4096, n - at)), dtype=np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        both += part[: len(left)] @ part[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - both
    return both >= threshold * union - 1e-9


def _share_earlier(left: list[list[int]], right: list[list[int]], bucket: int) -> np.ndarray:
    """Which pairs share a bucket before this one."""
    earlier = {b: i for i, b in enumerate({b for own in [*left, *right] for b in own if b < bucket})}
    marks = np.zeros((len(left) + len(right), max(1, len(earlier))), dtype=np.float32)
    for r, own in enumerate([*left, *right]):
        marks[r, [earlier[b] for b in own if b < bucket]] = 1
    return marks[: len(left)] @ marks[len(left) :].T > 0


def _verified(bucket: int, nodes: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], own: list[list[int]], one_block: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, links) of the nodes that have a link in this cell."""
    a = np.arange(len(nodes)) if one_block else np.flatnonzero(side == 0)
    b = a if one_block else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return nodes[:0], nodes[:0], copies[:0]
    linked = _links([sets[i] for i in a], [sets[i] for i in b], threshold)
    linked &= ~_share_earlier([own[i] for i in a], [own[i] for i in b], bucket)
    whole = np.zeros((len(nodes), len(nodes)), dtype=bool)
    whole[np.ix_(a, b)] = linked
    whole |= whole.T
    np.fill_diagonal(whole, False)
    links = whole @ copies
    label, before = nodes.copy(), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(whole, label[None, :], np.iinfo(np.int64).max).min(axis=1))
    some = links > 0
    return nodes[some], label[some], links[some]


def _row_keys(id_col: Column, text: Column) -> dict[str, Column]:
    """Two hashes that tell rows apart, null ids and texts included."""
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(id_col, F.length(text), text)}


def _joined(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows` with the columns of their group, as a left join; `groups` has one row per key.

    Groups of more than a ten-thousandth of all rows, of which there are fewer than ten thousand, go
    to their members by broadcast, so that no large group lands in one task.
    """
    large = groups.where(F.col(size) > max(LARGE, total // LARGE)).drop(size)
    few = F.broadcast(large.select(key))
    return rows.join(F.broadcast(large), key).unionByName(rows.join(few, key, "left_anti").join(groups.drop(size), key, "left"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per row of `df`: `id_col`, k1, k2, class_id, copy_id, n_links, kept.

    class_id and copy_id are the least ids of the row's class and of the rows with its n-gram set;
    n_links counts the other rows whose Jaccard similarity with it reaches the threshold; kept
    marks the row (with its exact repeats) that stands for its class. k1 and k2 are row keys.
    """
    bands, rows = bands_for(threshold, recall)
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    source = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumns(_row_keys(F.col("id"), F.col("text")))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for pdf in batches:
            prints, keys = [], []
            for part in chunks(list(pdf["text"])):
                for out, more in zip((prints, keys), _signatures(shingler, part, bands, rows), strict=True):
                    out += more
            made = pdf.drop(columns="text")
            made["print"], made["bands"] = prints, keys
            yield made

    signatures = checkpointed(source.mapInPandas(signed, f"id {id_type}, k1 long, k2 long, print binary, bands array<bigint>"))
    grouped = signatures.where(F.col("print").isNotNull()).groupBy("print")
    nodes = checkpointed(grouped.agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("row"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))

    met = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = met.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("node").alias("first")).where("m > 1")
    shared = shared.withColumn("bucket", F.col("first") * bands + F.col("band"))  # a node is in one bucket of a band
    members = checkpointed(met.join(shared, ["band", "key"]).select("node", "bucket", "m"))
    # A bucket whose members all share one larger bucket has no pair of its own.
    largest = members.groupBy("node").agg(F.max(F.struct("m", "bucket"))["bucket"].alias("largest"))
    placed = members.join(largest, "node")
    needed = placed.groupBy("bucket").agg(F.min("largest").alias("lo"), F.max("largest").alias("hi")).where("lo <> hi or lo = bucket")
    members = checkpointed(placed.join(needed.select("bucket"), "bucket", "left_semi").select("node", "bucket", "m"))

    candidates = members.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("own"))  # at most one per band
    wanted = candidates.join(nodes.select("node", "copies", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2")), "node")
    texts = source.select("k1", "k2", "text").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"), F.first("copies").alias("copies"), F.first("own").alias("own"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cells = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", "bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    work = cells.join(texts, "node").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held = Shingler(n), []

        def finish(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Verifies whole cells; `pdf` is sorted by cell."""
            if not len(pdf):
                return
            sets: list[np.ndarray] = []
            for part in chunks(list(pdf["text"])):
                grams, made = shingler(part)
                sets += [np.unique(g) for g in np.split(grams, np.cumsum(made)[:-1])]
            columns = [pdf[c].to_numpy() for c in ("bucket", "a", "b", "node", "side", "copies")]
            bucket, a, b, node, side, copies = columns
            own = list(pdf["own"])
            ends = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            out = []
            for lo, hi in zip([0, *ends], [*ends, len(pdf)], strict=True):
                cut = slice(int(lo), int(hi))
                out.append(_verified(int(bucket[lo]), node[cut], side[cut], copies[cut], sets[cut], own[cut], a[lo] == b[lo], threshold))
            yield pd.DataFrame({name: np.concatenate(c) for name, c in zip(("u", "v", "links"), zip(*out, strict=True), strict=True)})

        for pdf in batches:
            last = pdf.iloc[-1]
            same = ((pdf["bucket"] == last["bucket"]) & (pdf["a"] == last["a"]) & (pdf["b"] == last["b"])).to_numpy()
            if same.all() and held and (held[-1].iloc[-1][["bucket", "a", "b"]] == last[["bucket", "a", "b"]]).all():
                held.append(pdf)
                continue
            yield from finish(pd.concat([*held, pdf[~same]], ignore_index=True))
            held = [pdf[same]]
        if held:
            yield from finish(pd.concat(held, ignore_index=True))

    found = checkpointed(work.mapInPandas(verified, "u long, v long, links long"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v"))
    info = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = info.groupBy("root").agg(F.min("row").alias("class_row"), F.count("*").alias("of_class"))
    total = signatures.count()
    classed = _joined(info, checkpointed(classes), "root", "of_class", total)
    facts = classed.select("print", "copies", F.col("row.id").alias("least"), "class_row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    made = _joined(signatures.select("id", "k1", "k2", "print"), checkpointed(facts), "print", "copies", total)
    alone = F.col("print").isNull()
    return made.select(
        F.col("id").alias(id_col),
        "k1",
        "k2",
        F.when(alone, F.col("id")).otherwise(F.col("class_row.id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("least")).alias("copy_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        (alone | ((F.col("class_row.k1") == F.col("k1")) & (F.col("class_row.k2") == F.col("k2")))).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`df` with one row of each near-duplicate class; all columns are kept.

    Of rows that are equal in id and text the one stays whose other columns hash least.
    """
    kept = near_duplicates(df, id_col, text_col, **options).where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    keys = _row_keys(F.col(id_col), F.col(text_col))
    keyed = df.withColumns({f"__{k}": v for k, v in keys.items()})
    left = keyed.join(kept.distinct(), ["__k1", "__k2"], "left_semi").withColumn("__other", F.xxhash64(*hashable(df)))
    first = left.groupBy("__k1", "__k2").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "__other").alias("__row"))
    return first.select("__row.*")
