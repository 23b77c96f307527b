"""Byte-level BPE encoding and decoding, with tree concatenation of long unsplit text.

The encoder's pre-tokenizer splits a text into words before any merge, and a border between a word's
last sign and white space is always such a split. Texts are cut there. Where a word stays longer
than `unit` bytes it is halved until its parts are short enough; the parts are encoded each on its
own, and neighbours are joined pair by pair, level by level. A join takes the last k tokens on its
left and the first k on its right, encodes their bytes anew, and doubles k until the new tokens
begin with the same token as the old ones on the left and end with the same one on the right.

That is exact. A sequence is what BPE makes of a word if and only if every two neighbours in it are
what BPE makes of their joint bytes: merges are taken by rank, then from the left, so as long as none
crosses a border each side goes on as if alone, and the first merge that crosses one would be taken
for the two neighbours alone too. Both old sequences and the new one have only such neighbours, and
where a side agrees the pair at its edge is an old one.

Texts over `spread` bytes leave their task: their parts are rows of a shuffle, encoded wherever they
land, and only the tokens of one text come together again. Equal long texts are encoded once and
found again by their SHA-256, so no row number has to survive a lost executor.

A null text is an empty one and has no token. Ids and repeated rows stay as they are, an empty table
gives an empty one, columns with the output's name are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.llm.packing import _Encoder

#: The longest word that is encoded in one go, in bytes, and the longest text that stays in its task.
UNIT, SPREAD = 2048, 1 << 16
#: Rows of a batch that are Python objects at one time.
ROWS = 256

#: A sign that no engine takes for white space, in front of one that all do.
_CUT = re.compile(r"[\w!-~](?=[ \t\r\n])")
_ALPHABET: dict[str, int] = {}


def _alphabet() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary -> the byte."""
    if not _ALPHABET:
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        _ALPHABET.update({chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)})
    return _ALPHABET


class TreeEncoder:
    """Encodes texts with the tokenizers file at `path`; `ranks_path` may hold its vocabulary as merge ranks.

    A part of a text is (spelled, joined, string): a plain string for the library, or words spelled
    in the vocabulary's letters with spaces between them; `joined` if its word goes on from the part before.
    """

    def __init__(self, path: str, ranks_path: str | None = None, unit: int = UNIT):
        about = json.load(open(path))
        split = about["pre_tokenizer"] or {}
        if about["normalizer"] or about["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE without normaliser or prefix space is needed")
        if unit < 1:
            raise ValueError("unit must be at least 1")
        self.library = _Encoder(path, ranks_path)
        self.tokenizer, self.unit = self.library.tokenizer, unit
        added = [t["content"] for t in about["added_tokens"]]
        if any(re.search(r"\s", t) for t in added):
            raise ValueError("added tokens with white space are not supported")
        self.added = set(added)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    # cutting

    def parts(self, text: str, size: int) -> Iterator[tuple[bool, bool, str]]:
        """The parts of a text, of about `size` characters where it can be cut."""
        start = 0
        while start < len(text):
            cut = _CUT.search(text, start + size) if len(text) - start > size else None
            end = cut.end() if cut else len(text)
            piece = text[start:end] if start or end < len(text) else text
            if self._may_hold_long(piece):
                yield from self._around_long(piece)
            else:
                yield False, False, piece
            start = end

    def _may_hold_long(self, text: str) -> bool:
        if len(text) * 4 <= self.unit:
            return False
        words = [len(w.encode()) if len(w) * 4 > self.unit else len(w) for w in text.split()]
        return max(words, default=0) > self.unit or len(text) - sum(map(len, text.split())) > self.unit

    def _around_long(self, text: str) -> Iterator[tuple[bool, bool, str]]:
        start = done = 0
        for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
            if (end - done) * 4 > self.unit and len(text[done:end].encode()) > self.unit:
                if start < done:
                    yield False, False, text[start:done]
                yield from self._spelled(text[done:end])
                start = end
            done = end
        if start < done:
            yield False, False, text[start:done]

    def _spelled(self, text: str) -> Iterator[tuple[bool, bool, str]]:
        """Words as the library splits them; the long ones are halved until their parts are short."""
        for part in self.added_pattern.split(text) if self.added_pattern else [text]:
            if part in self.added:
                yield False, False, part
                continue
            short: list[str] = []
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else ():
                if len(word) <= self.unit:
                    short.append(word)
                    continue
                if short:
                    yield True, False, " ".join(short)
                    short = []
                leaves = [word]
                while len(leaves[0]) > self.unit:
                    leaves = [half for x in leaves for half in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
                for i, leaf in enumerate(leaves):
                    yield True, i > 0, leaf
            if short:
                yield True, False, " ".join(short)

    # encoding

    def merged(self, word: str) -> np.ndarray:
        """Ids of one word in the vocabulary's letters."""
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], dtype="<u4")

    def leaf(self, spelled: bool, string: str) -> np.ndarray:
        if not spelled:
            return np.frombuffer(self.library(string), dtype="<u4")
        words = string.split(" ")
        return self.merged(words[0]) if len(words) == 1 else np.concatenate([self.merged(w) for w in words])

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a word from those of its halves."""
        k, spell = 1, self.tokenizer.id_to_token
        while True:
            a, b = left[-k:], right[:k]
            new = self.merged("".join(map(spell, [*a.tolist(), *b.tolist()])))
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], new, right[len(b) :]])
            k *= 2

    def concatenated(self, leaves: list[tuple[bool, np.ndarray]]) -> np.ndarray:
        """Ids of a text from (joined, ids) of its parts in order."""
        out, word = [], []
        for joined, ids in [*leaves, (False, None)]:
            if not joined and word:
                while len(word) > 1:
                    pairs = [self.join(*word[i : i + 2]) for i in range(0, len(word) - 1, 2)]
                    word = pairs + word[2 * len(pairs) :]
                out.append(word[0])
                word = []
            word.append(ids)
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

    def __call__(self, text: str) -> bytes:
        leaves = [(joined, self.leaf(spelled, string)) for spelled, joined, string in self.parts(text, max(1, len(text)))]
        return (leaves[0][1] if len(leaves) == 1 else self.concatenated(leaves)).astype("<u4", copy=False).tobytes()


_encoders: dict[tuple, TreeEncoder] = {}
_spellings: dict[str, dict[int, bytes]] = {}


def _encoder(*key) -> TreeEncoder:
    return _encoders.get(key) or _encoders.setdefault(key, TreeEncoder(*key))


def _in_slices(column: pa.Array, made: Callable[[list], pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *(made(column.slice(at, ROWS).to_pylist()) for at in range(0, len(column), ROWS))])


def encode(
    df: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    text_col: str = "text",
    out_col: str = "ids",
    decoded_col: str | None = None,
    unit: int = UNIT,
    spread: int = SPREAD,
) -> DataFrame:
    """Adds `out_col` (binary): the ids of each whole text as little-endian unsigned 32-bit integers.

    With `decoded_col` the ids are decoded where they were made, in the same pass, as `decode` does.
    """
    key = (tokenizer_path, ranks_path, unit)
    kind = pa.struct([("ids", pa.binary()), ("text", pa.string())])

    def with_text(ids: list[bytes]) -> pa.Array:
        texts = [_text_of(x, _bytes_of(tokenizer_path)) for x in ids] if decoded_col else [None] * len(ids)
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], fields=list(kind))

    @F.arrow_udf("struct<ids: binary, text: string>")
    def at_once(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(*key)
        for texts in batches:
            yield _in_slices(texts, lambda rows: with_text([encoder(t) for t in rows]), kind)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*key)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for i, part in enumerate(encoder.parts(text, spread)):
                    rows.append((name, i, *part))
                    if len(rows) == 512:
                        yield part_rows(rows)
                        rows = []
                if rows:
                    yield part_rows(rows)

    def part_rows(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "part", "spelled", "joined", "string"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*key)
        for batch in batches:
            ids = [encoder.leaf(a, b).tobytes() for a, b in zip(batch.column("spelled").to_pylist(), batch.column("string").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("joined"), pa.array(ids, pa.binary())], ["key", "part", "joined", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        each = [(j, np.frombuffer(x, dtype="<u4")) for j, x in zip(group["joined"].to_pylist(), group["ids"].to_pylist(), strict=True)]
        return pa.table({"key": group["key"][:1], "made": with_text([_encoder(*key).concatenated(each).astype("<u4").tobytes()])})

    rest = df.drop(*({out_col, decoded_col} - {text_col, None}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named, made = f"__key_{len(df.columns)}", f"__ids_{len(df.columns)}"
    at_home = rest.where(F.octet_length(text) <= spread).withColumn(made, at_once(text))
    far = rest.where(F.octet_length(text) > spread).withColumn(named, F.sha2(text, 256))
    rows = far.select(named, text.alias("string")).mapInArrow(parts, "key string, part int, spelled boolean, joined boolean, string string")
    # Copies of a long text meet here, before its parts are encoded.
    once = rows.dropDuplicates(["key", "part"]).mapInArrow(leaves, "key string, part int, joined boolean, ids binary")
    told = once.groupBy("key").applyInArrow(joined, "key string, made struct<ids: binary, text: string>").select(F.col("key").alias(named), F.col("made").alias(made))
    whole = at_home.unionByName(far.join(told, named).drop(named))
    return whole.withColumns({out_col: F.col(made)["ids"], **({decoded_col: F.col(made)["text"]} if decoded_col else {})}).drop(made)


def _text_of(ids: bytes | None, table: dict[int, bytes]) -> str | None:
    return None if ids is None else b"".join([table.get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _bytes_of(path: str) -> dict[int, bytes]:
    """What each id of the vocabulary spells."""
    if path not in _spellings:
        from tokenizers import Tokenizer

        letters = _alphabet()
        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        _spellings[path] = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
    return _spellings[path]


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds `out_col` (string): the text of binary ids, special tokens included.

    Ids outside the vocabulary are left out, bytes that are no UTF-8 become U+FFFD, null stays null.
    """

    @F.arrow_udf("string")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _bytes_of(tokenizer_path)
        for column in batches:
            yield _in_slices(column, lambda rows: pa.array([_text_of(x, table) for x in rows], pa.string()), pa.string())

    return df.withColumn(out_col, spelled(F.col(ids_col)))
