"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum, over all its segmentations into pieces, of the product of their probabilities;
a forward pass adds them up without listing them. A text is scored by the product over its words
and the share of its language among the training rows.

Words are runs of letters (as Unicode has them) in lower case behind a word mark, of any length: the
forward pass rescales its sums every few letters of a long word, so that none vanishes. Any single
letter is always an edge, with a small probability where it is no piece. Piece probabilities are fitted by expectation maximisation: Spark counts words per
language, and each round's expected counts are summed over partitions of those words.

Texts that are null or hold no letter get `und` with score 0. Rows with a null language, null
text or a null id take part in prediction but not in training. Texts are read whole. With no
training row at all every text is `und`. Columns beside the text pass through untouched, but ones
with the outputs' names are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.llm import substrings
from lexcorpus.llm.common import hash_sample, hashable

UNKNOWN = "und"
#: Letters up to which a word's sums need no rescaling, and how often those of longer words are rescaled.
SHORT, RESCALED = 24, 8
#: Distinct tokens that a worker remembers; characters of text that it scores at once.
CACHE_ENTRIES, CHUNK = 400_000, 2_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def words(token: str) -> list[str]:
    """The words of one token: marked runs of letters."""
    out = []
    for run in _LETTERS.findall(token):
        if run.isalpha():
            out.append(_MARK + run)
        else:  # signs such as a half or a superscript count as word characters there, but are no letters
            out += [_MARK + part for part in "".join(c if c.isalpha() else " " for c in run).split()]
    return out


def vocabulary(model_path: str) -> list[str]:
    """Pieces that can occur in a unit: lower-case letters with or without a word mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [p for p in pieces if re.fullmatch(rf"{_MARK}?[^\W\d_]*", p) and p and p == p.lower()]


@dataclass
class Unigrams:
    """Piece probabilities: one row per piece, then one for a letter that is no piece; a column per language."""

    langs: list[str]
    pieces: list[str]
    probs: np.ndarray
    prior: np.ndarray

    def __post_init__(self):
        self.lookup = substrings.Lookup(substrings.hashes(self.pieces))
        self.longest = max(map(len, self.pieces), default=1)

    def __reduce__(self):
        return Unigrams, (self.langs, self.pieces, self.probs, self.prior)

    def edges(self, prefix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of the lattices of equally long units, by end."""
        n, every_start = prefix.shape[1] - 1, {}
        if n > SHORT:  # all substrings of one length at once
            for k in range(1, min(n, self.longest) + 1):
                spans = prefix[:, k:] - prefix[:, :-k] * substrings._POWERS[k]
                cells, found = self.lookup.find(spans.ravel())
                every_start[k] = np.full(spans.shape, -1, dtype=np.int32)
                every_start[k].ravel()[cells] = found
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if every_start:
                    found = every_start[j - i][:, i]
                    rows = np.flatnonzero(found >= 0)
                    found = found[rows].astype(np.int64)
                else:
                    rows, found = self.lookup.find(substrings.span(prefix, i, j))
                if i == j - 1:
                    every = np.full(len(prefix), len(self.pieces))
                    every[rows] = found
                    rows, found = np.arange(len(prefix)), every
                if len(rows):
                    yield i, j, rows, found

    def _rescale(self, sums: np.ndarray, offset: np.ndarray, at: int, behind: range) -> None:
        """Divides the sums of the positions still in reach by the one `at`, and keeps its logarithm."""
        by = sums[at].copy()
        for i in behind:
            sums[i] /= by
            offset[i] += np.log(by)

    def log_probs(self, units: list[str]) -> np.ndarray:
        """Log probability of each unit under each language."""
        out = np.zeros((len(units), len(self.langs)))
        for at, prefix in substrings.by_length(units):
            n = prefix.shape[1] - 1
            alpha = np.zeros((n + 1, len(at), len(self.langs)))
            offset = np.zeros_like(alpha) if n > SHORT else None
            alpha[0], done = 1, 0
            for i, j, rows, found in self.edges(prefix):
                if offset is not None and j > done + 1:  # position j - 1 is complete
                    done = j - 1
                    if done % RESCALED == 0:
                        self._rescale(alpha, offset, done, range(max(0, done - self.longest), done + 1))
                        offset[j:] = offset[done]
                alpha[j, rows] += alpha[i, rows] * self.probs[found]
            out[at] = np.log(alpha[-1]) + (0 if offset is None else offset[-1])
        return out

    def expected(self, units: list[str], lang: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, over units of the given language and count."""
        out, k = np.zeros(self.probs.size), len(self.langs)
        for at, prefix in substrings.by_length(units):
            own, n = lang[at], prefix.shape[1]
            edges = [(i, j, rows, found * k + own[rows]) for i, j, rows, found in self.edges(prefix)]
            alpha, beta, p = np.zeros((n, len(at))), np.zeros((n, len(at))), self.probs.ravel()
            alpha[0] = beta[-1] = 1
            before, behind = (np.zeros_like(alpha), np.zeros_like(alpha)) if n - 1 > SHORT else (None, None)
            done = 0
            for i, j, rows, cell in edges:
                if before is not None and j > done + 1:
                    done = j - 1
                    if done % RESCALED == 0:
                        self._rescale(alpha, before, done, range(max(0, done - self.longest), done + 1))
                        before[j:] = before[done]
                alpha[j, rows] += alpha[i, rows] * p[cell]
            done = n - 1
            for i, j, rows, cell in sorted(edges, key=lambda e: -e[0]):
                if behind is not None and i < done - 1:
                    done = i + 1
                    if done % RESCALED == 0:
                        self._rescale(beta, behind, done, range(done, min(n, done + self.longest + 1)))
                        behind[: i + 1] = behind[done]
                beta[i, rows] += beta[j, rows] * p[cell]
            weight = count[at] / alpha[-1]
            for i, j, rows, cell in edges:
                share = weight[rows] * alpha[i, rows] * beta[j, rows] * p[cell]
                if before is not None:
                    share *= np.exp(before[i, rows] + behind[j, rows] - before[-1, rows])
                out += np.bincount(cell, share, minlength=out.size)
        return out.reshape(self.probs.shape)


def fit(df: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", train_rows: int = 20_000, rounds: int = 3) -> Unigrams:
    """Fits on the rows of `df` with a text and a language, on about `train_rows` of them at most.

    That bound keeps the word counts small. Rows are chosen by a hash of all their columns (but maps,
    which have none), so that copies of one text under many ids are not chosen together.
    """
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sample = hash_sample(known, hashable(known), train_rows).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                counts.update((lang, u) for u in chain.from_iterable(map(words, text.lower().split())))
            if len(counts) > CACHE_ENTRIES:
                yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "unit", "n"])
                counts.clear()
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "unit", "n"])

    units = sample.mapInPandas(counted, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")).persist()
    shares = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, pieces = sorted(shares), vocabulary(model_path)
    prior = np.array([shares[x] for x in langs], dtype=float)
    model = Unigrams(langs, pieces, np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1)), prior / max(1, prior.sum()))
    place = {x: i for i, x in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        shared = df.sparkSession.sparkContext.broadcast(model)

        def expected(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros(shared.value.probs.shape)
            for pdf in batches:
                total += shared.value.expected(list(pdf["unit"]), pdf["lang"].map(place).to_numpy(), pdf["n"].to_numpy(dtype=float))
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        summed = units.mapInPandas(expected, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        total = np.full(model.probs.shape, 0.01)
        got = summed.toPandas()  # at most a row for each piece of the vocabulary and language
        total[got["piece"], got["lang"]] += got["n"]
        model = Unigrams(langs, pieces, total / total.sum(axis=0), model.prior)
        shared.unpersist()
    units.unpersist()
    return model


class _Scorer:
    """Scores texts; remembers what the words of a token add to each language's score."""

    def __init__(self, model: Unigrams):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.added = np.zeros((1 << 16, len(self.model.langs) + 1))  # the last column counts words

    def learn(self, tokens: list[str]) -> None:
        units, owner, first = [], [], len(self.rows)
        for k, token in enumerate(tokens, first):
            self.rows[token] = k
            found = words(token)
            units += found
            owner += [k] * len(found)
        while len(self.rows) > len(self.added):
            self.added = np.concatenate([self.added, np.zeros_like(self.added)])
        np.add.at(self.added, np.array(owner, dtype=np.int64), np.column_stack([self.model.log_probs(units), np.ones(len(units))]))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        tokens = [t.lower().split() if t else [] for t in texts]
        if len(self.rows) > CACHE_ENTRIES or sum(map(len, tokens)) == 0:
            self.forget()
        self.learn(list(set().union(*tokens) - self.rows.keys()))
        out = []
        for own in tokens:
            total = self.added[np.fromiter(map(self.rows.__getitem__, own), dtype=np.int64, count=len(own))].sum(axis=0)
            if not total[-1] or not self.model.langs:
                out.append((UNKNOWN, 0.0))
                continue
            score = total[:-1] + np.log(self.model.prior)
            best = int(np.argmax(score))
            out.append((self.model.langs[best], float(1 / np.exp(score - score[best]).sum())))
        return out


_scorers: dict[str, _Scorer] = {}


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[list[str | None]]:
    """Runs of texts of about `size` characters; no text is cut."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def predict(df: DataFrame, model: Unigrams, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the likeliest language and its posterior probability."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = _Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([x for part in chunks(list(texts)) for x in _scorers[key](part)], columns=["lang", "score"])

    made = df.withColumn("__predicted", predicted(F.col(text_col)))
    return made.withColumns({lang_out: F.col("__predicted.lang"), score_out: F.col("__predicted.score")}).drop("__predicted")
