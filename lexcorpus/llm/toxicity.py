"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the character n-grams (`N_GRAMS` long, binary per text) of lower-case tokens with a
space at either end. Spark counts, over the labelled training rows, in how many toxic and other
texts each n-gram occurs; its log-count ratio scales the feature, and n-grams whose counts do not
differ significantly are left out; all others are kept. A logistic regression is then fitted on the
scaled features.

It learns from distinct rows (id and text) with a label (0 or 1), on `train_rows` of them at most,
give or take their square root, chosen by a hash, labels first and then rows, so that many rows of
one id do not exceed the bound either; that bound also bounds what the driver fits.
Repeated labels of an id count once, as toxic if any says so. Null and empty texts have no feature
and get the score of the intercept. With no labelled row every score is 0; with labels of one
class only, the score is that class's share. Texts are read whole; other columns pass through, but
one with the output's name is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.llm import substrings
from lexcorpus.llm.common import hash_sample
from lexcorpus.llm.langid import CACHE_ENTRIES, chunks

N_GRAMS = (3, 4, 5)
#: A fixed value: the chi-square statistic of one degree of freedom at one in a million, as about as many n-grams are tried.
SIGNIFICANT = 23.93


def _grams(tokens: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token positions, hashes) of all n-grams of the given tokens; a row of hashes per token."""
    for at, prefix in substrings.by_length([f" {t} " for t in tokens]):
        parts = [prefix[:, n:] - prefix[:, :-n] * substrings._POWERS[n] for n in N_GRAMS if prefix.shape[1] > n]
        if parts:
            yield at, np.concatenate(parts, axis=1)


class _Features:
    """Sets of n-grams per text; remembers those of each token."""

    def __init__(self, keep: substrings.Lookup | None):
        self.keep, self.known = keep, {}

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        tokens = [set(t.lower().split()) if t else set() for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*tokens) - self.known.keys())
        self.known.update(dict.fromkeys(new, ()))
        for at, grams in _grams(new):
            if self.keep is None:
                self.known.update((new[k], g) for k, g in zip(at, grams, strict=True))
                continue
            cells, found = self.keep.find(grams.ravel())
            rows = cells // grams.shape[1]
            for k in np.unique(rows):
                self.known[new[at[k]]] = found[rows == k]
        for own in tokens:
            parts = [g for g in map(self.known.__getitem__, own) if len(g)]
            yield np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
        if self.keep is None:
            self.known.clear()


@dataclass
class Classifier:
    keys: np.ndarray  # hashes of the n-grams kept
    ratio: np.ndarray  # their naive Bayes log-count ratios
    weight: np.ndarray  # of the scaled features
    intercept: float


def _logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the penalised log loss."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    values, n = ratio[cols], len(ratio)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values * w[cols], minlength=len(rows)) + w[-1]

    def backward(e: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, values * e[owner], minlength=n), e.sum())

    v = np.ones(n + 1)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = backward(forward(v / np.linalg.norm(v)))
    step = 1 / (0.25 * np.linalg.norm(v) * 1.05 + penalty)
    w = z = np.zeros(n + 1)
    t, decay = 1.0, np.append(np.full(n, penalty), 0)
    for _ in range(steps):
        new = z - step * (backward(1 / (1 + np.exp(-np.clip(forward(z), -50, 50))) - y) + decay * z)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000, min_texts: int = 3, penalty: float = 1.0, steps: int = 300) -> Classifier:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(hash_sample(known, ["id"], train_rows)), "id").dropDuplicates(["id", "text"]).persist()
    train = hash_sample(labelled, ["text", "id"], train_rows).select("text", "y").persist()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = _Features(None)
        for pdf in batches:
            at = 0
            for part in chunks(list(pdf["text"]), 500_000):
                sets = list(features(part))
                y = np.repeat(pdf["y"].to_numpy()[at : at + len(part)], list(map(len, sets)))
                at += len(part)
                grams, place = np.unique(np.concatenate(sets), return_inverse=True)
                toxic = np.bincount(place, y, minlength=len(grams)).astype(np.int64)
                yield pd.DataFrame({"gram": grams.view(np.int64), "pos": toxic, "neg": np.bincount(place, minlength=len(grams)) - toxic})

    size = train.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = int(size.pos), size.n - int(size.pos)
    if not pos or not neg:
        share = pos / size.n if size.n else 0.0
        return Classifier(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0), {0.0: -50.0, 1.0: 50.0}[share])
    a, b = F.col("pos"), F.col("neg")
    total, both = F.lit(float(pos + neg)), a + b
    chi2 = total * F.pow(a * F.lit(float(neg)) - b * F.lit(float(pos)), 2) / (F.lit(float(pos)) * F.lit(float(neg)) * both * (total - both + 0.5))
    grams = train.mapInPandas(counted, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(both >= min_texts)
    best = grams.withColumn("chi2", chi2).where(F.col("chi2") >= SIGNIFICANT).toPandas().sort_values("gram", ignore_index=True)
    keys = best["gram"].to_numpy(dtype=np.int64).view(np.uint64)
    ratio = np.log((1 + best["pos"].to_numpy(dtype=float)) / (pos + 2)) - np.log((1 + best["neg"].to_numpy(dtype=float)) / (neg + 2))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = _Features(substrings.Lookup(keys))
        for pdf in batches:
            sets = [f.tolist() for part in chunks(list(pdf["text"])) for f in features(part)]
            yield pd.DataFrame({"found": sets, "y": pdf["y"]})

    rows = train.mapInPandas(found, "found array<int>, y int").toPandas()  # at most train_rows, give or take
    train.unpersist()
    labelled.unpersist()
    order = [np.asarray(f, dtype=np.int64) for f in rows["found"]]
    weight, intercept = _logistic(order, rows["y"].to_numpy(dtype=float), ratio, penalty, steps)
    return Classifier(keys, ratio, weight, intercept)


_workers: dict[str, _Features] = {}


def score(df: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds `out_col`: the probability that a text is toxic."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = _Features(substrings.Lookup(shared.value.keys))
        each = shared.value.ratio * shared.value.weight
        for texts in batches:
            z = [each[f].sum() + shared.value.intercept for part in chunks(list(texts)) for f in _workers[key](part)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -50, 50))))

    return df.withColumn(out_col, scored(F.col(text_col)))
