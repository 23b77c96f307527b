"""Fill-in-middle transformation: texts are cut in three at the ends of units and reordered.

A unit is a line, or what another set of one-byte signs ends. Units are found in the UTF-8 bytes of
a whole batch at once, eight bytes to a word: the bytes that end a unit are marked by arithmetic on
words, `bitwise_count` counts the marks of each word, a search in the cumulative counts finds the
word that holds the k-th mark, and the place within that word follows from prefix sums of its
bytes. Spark then cuts and joins the texts by the numbers of characters found.

The cuts of a row depend on its id alone: four numbers from the SHA-256 of the seed and the id.
Equal rows get equal results. A null text is an empty one; an empty text, and one that holds a
mark, stays as it is (`plain`). A null id counts as an empty string. Texts of any length are cut
whole, an empty table gives an empty one, and columns with the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Rows whose bytes are looked at together.
ROWS = 1024

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


class Marked:
    """The marked bytes (the high bit of each) of an array of little-endian words."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))  # positions may be one past the last byte
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in front of byte positions."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte positions of the k-th marks, from 1; each must exist."""
        word = np.searchsorted(self.upto, k, side="left") - 1
        within = (k - self.upto[word]).astype(np.uint64)
        sums = (self.marks[word] >> np.uint64(7)) * _ONES  # each byte: marks up to it in its word
        reached = ((sums | _HIGH) - within * _ONES) & _HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte of `words` that equals `byte`."""
    x = words ^ (np.uint64(byte) * _ONES)
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def first_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point: all but 10xxxxxx."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, ends: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the characters up to the two cuts that two numbers choose."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(at[-1] - at[0])
    raw = np.zeros((size + 7) // 8 * 8, dtype=np.uint8)
    if size:
        raw[:size] = np.frombuffer(data, dtype=np.uint8, count=size, offset=int(at[0]))
    words, at = raw.view("<u8"), at - at[0]
    marks = np.zeros_like(words)
    for byte in ends:
        marks |= equal_bytes(words, byte)
    units, characters = Marked(marks), Marked(first_bytes(words))
    start, stop = at[:-1], at[1:]
    before = units.rank(start)
    last = stop > start
    last[last] = units.rank(stop[last]) == units.rank(stop[last] - 1)  # something stands behind the last mark
    n = units.rank(stop) - before + last
    a, b = h1 % (n + 1), h2 % (n + 1)

    def position(k: np.ndarray) -> np.ndarray:
        out = np.where(k == n, stop, start)
        inner = (k > 0) & (k < n)
        out[inner] = units.select((before + k)[inner]) + 1
        return out

    base = characters.rank(start)
    return n, characters.rank(position(np.minimum(a, b))) - base, characters.rank(position(np.maximum(a, b))) - base


def _check(marks: Sequence[str]) -> None:
    """Marks must be found again: none may hold another, nor begin as one ends."""
    for a, b in [*permutations(marks, 2), *((m, m) for m in marks)]:
        if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
            raise ValueError("marks must neither be empty nor overlap")
    if len(set(marks)) != 3:
        raise ValueError("three different marks are needed")


def transform(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    ends: str = "\n",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars (null if plain) and output.

    `ends` are one-byte characters that end a unit. `percent` of the rows are transformed, of these
    `spm_percent` with the suffix first (`spm`), the others with the prefix first (`psm`).
    """
    _check(marks)
    if not ends or not ends.isascii():
        raise ValueError("units must end in ASCII characters")
    first, second, third = marks
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    bytes_ = ends.encode()

    @F.arrow_udf("struct<n: long, first: long, second: long>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            parts = [cuts(texts.slice(i, ROWS), a.slice(i, ROWS).to_numpy(), b.slice(i, ROWS).to_numpy(), bytes_) for i in range(0, len(texts), ROWS)]
            columns = [np.concatenate([np.zeros(0, dtype=np.int64), *[p[k] for p in parts]]) for k in range(3)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])

    plain = (text == "") | (h[2] % 100 >= percent)
    for m in marks:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    cut = f"__cut_{len(df.columns)}"
    told = df.drop("n", "form", "prefix_chars", "middle_chars", "output").withColumn(cut, found(text, h[0], h[1]))
    a, b = F.col(cut)["first"].cast("int"), F.col(cut)["second"].cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.lit(2**31 - 1) - b)
    told = told.withColumns({"n": F.col(cut)["n"], "form": form})
    shown = F.col("form") != "plain"
    return told.withColumns(
        {
            "prefix_chars": F.when(shown, a.cast("long")),
            "middle_chars": F.when(shown, (b - a).cast("long")),
            "output": F.when(~shown, text)
            .when(F.col("form") == "psm", F.concat(F.lit(first), prefix, F.lit(second), suffix, F.lit(third), middle))
            .otherwise(F.concat(F.lit(second), suffix, F.lit(first), prefix, F.lit(third), middle)),
        }
    ).drop(cut)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that `transform` made `output` from; null if either is null."""
    _check(marks)
    first, second, third = marks

    def parts(a: str, b: str) -> tuple[Column, Column, Column]:
        """What stands behind `a`, behind `b` and behind the last mark."""
        body = F.substring(output, F.lit(len(a) + 1), F.lit(2**31 - 1))
        x = F.substring_index(body, b, 1)
        rest = F.substring(body, F.length(x) + len(b) + 1, F.lit(2**31 - 1))
        y = F.substring_index(rest, third, 1)
        return x, y, F.substring(rest, F.length(y) + len(third) + 1, F.lit(2**31 - 1))

    prefix, suffix, middle = parts(first, second)
    suffix2, prefix2, middle2 = parts(second, first)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2))
