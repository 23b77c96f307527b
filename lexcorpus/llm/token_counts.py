"""Token counts with a whole-token shortcut.

A sentencepiece BPE vocabulary whose pieces never hold a word mark after another character cuts
every text into independent pre-tokens: a run of spaces with what follows it, or a line end with
what follows it. `prove_whole_tokens` runs the encoder once over the whole vocabulary and keeps
the strings that encode alone as one token. Counting then looks pre-tokens up in that table and
merges only the rest, each distinct one once per worker while the cache holds it.

Null texts count as empty and have no token; texts of any length are read whole; equal texts get
equal counts; columns beside the text pass through untouched, but one with the output's name is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a worker remembers, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 64

_PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
_MARK = "▁"


def _load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def _count_alone(model, key: str) -> int:
    """Tokens of one pre-token; a key is what follows the first space, or starts with a line end."""
    if not key:
        return 1
    # The encoder puts a word mark in front; before a line end that mark is a token of its own.
    return len(model.encode(key)) - (key[0] == "\n")


def prove_whole_tokens(model_path: str) -> dict[str, int]:
    """Pre-token key -> token count, for every vocabulary string that encodes alone as itself.

    Raises if the vocabulary holds a piece that crosses a pre-token border, as counts of
    pre-tokens then would not add up.
    """
    model, proved = _load(model_path), {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        body = piece.lstrip(_MARK)
        if _MARK in body or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
        if piece.startswith(_MARK):
            key, expected = piece[1:].replace(_MARK, " "), [i]
            if key and model.encode(key) == expected:
                proved[key] = 1
        else:
            key = "\n" + piece
            ids = model.encode(key)
            if len(ids) == 3 and ids[-1] == i:
                proved[key] = 2
    return proved


class _Counts(dict):
    """Counts by pre-token key; what is missing is merged by the encoder."""

    def __init__(self, model_path: str, proved: dict[str, int]):
        super().__init__(proved)
        self.proved, self.model = proved, _load(model_path)

    def __missing__(self, key: str) -> int:
        n = _count_alone(self.model, key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.proved)
            self[key] = n
        return n

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        if _MARK in text:
            text = text.replace(_MARK, " ")
        keys = text.replace("\n", " \n").split(" ")
        if "" in keys:  # spaces in runs, at an end or before a line end
            keys = [p[1:] if p[0] == " " else p for p in _PRE_TOKEN.findall(" " + text)]
        elif keys[0][0] == "\n":  # the mark in front of a text is a token if a line end follows
            return 1 + sum(map(self.__getitem__, keys))
        return sum(map(self.__getitem__, keys))


_workers: dict[str, _Counts] = {}


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Adds `out_col` (long): the tokens of `text_col`, without any added token."""
    proved = df.sparkSession.sparkContext.broadcast(prove_whole_tokens(model_path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model_path not in _workers:
            _workers[model_path] = _Counts(model_path, proved.value)
        of_text = _workers[model_path].of_text
        for texts in batches:
            yield pd.Series([of_text(t) for t in texts], dtype="int64")

    return df.withColumn(out_col, counted(F.col(text_col)))
