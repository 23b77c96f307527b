"""Vector bin packing of token sequences by the dot-product heuristic.

Every document is tokenized, ends with `end_id`, and becomes an item with three demands: tokens,
one segment, and loss-bearing tokens. Sequences (bins) hold at most `max_tokens`, `max_segments`
and `max_loss` of these at once. Each bin takes, again and again, the fitting item with the
largest weighted dot product of its demands and the bin's remaining room; the weights are the
mean demands of the waiting items. When no whole item fits, an item is cut to the room left and
its rest waits for the next bin, so bins close full unless the segment limit closes them.

Documents are packed where they are read: no token is shuffled, and each task holds one window of
items. Every bin that stays short, the last one of a task or one that the segment or loss limit
closes, is cut at powers of two, as such lengths need no padding.

A null text is an empty one and still yields its end token. Null or repeated ids are kept as they
are: rows are items, not ids. Texts of any length are tokenized whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import contextlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabulary splits a text before its merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Encoder:
    """Ids of whole texts as the tokenizers library gives them for the vocabulary at `path`.

    `ranks_path`, where given, holds the same byte-level vocabulary as merge ranks. The tiktoken
    library then encodes the Latin-1 texts, where both give the same ids (a test compares them),
    at a quarter of the CPU time; all other texts go through tokenizers, and so do those whose
    white space runs are too long for the other library's patterns.
    """

    def __init__(self, path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks = Tokenizer.from_file(path), None
        if ranks_path:
            import tiktoken

            lines = [line.split() for line in open(ranks_path, "rb")]
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            self.ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks={base64.b64decode(t): int(i) for t, i in lines}, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        if self.ranks:
            with contextlib.suppress(ValueError):  # no Latin-1, or a run of white space that the library refuses
                text.encode("latin-1")
                return np.array(self.ranks.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[tuple, _Encoder] = {}


@dataclass
class _Item:
    row: int  # of the task's documents
    start: int  # ids of the document before this item
    length: int
    loss: int  # loss-bearing ids; they are the last ones

    def cut(self, room: int, loss_room: int) -> int:
        """Most ids of its front that fit; the loss-bearing ones come last."""
        return min(room, self.length - self.loss + min(self.loss, loss_room), self.length)

    def split(self, at: int) -> tuple[_Item, _Item]:
        quiet = self.length - self.loss
        front = _Item(self.row, self.start, at, max(0, at - quiet))
        return front, _Item(self.row, self.start + at, self.length - at, self.loss - front.loss)


def _fill(items: list[_Item], limits: tuple[int, int, int], last: bool) -> tuple[list[list[_Item]], list[_Item]]:
    """Bins, and the items of the one left open (none, if this is the last window)."""
    max_tokens, max_segments, max_loss = limits
    waiting = list(items)
    need = np.array([(x.length, 1, x.loss) for x in waiting], dtype=np.float64).reshape(-1, 3)
    free = np.ones(len(waiting), dtype=bool)
    scale = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
    weight = need.mean(axis=0) / scale if len(need) else scale
    left, bins = len(waiting), []
    while left:
        room, bin_ = scale.copy(), []
        while left:
            fits = free & (need <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, (need / scale) @ (weight * room / scale), -1.0)))
                bin_.append(waiting[k])
                room -= need[k]
                free[k] = False
                left -= 1
            else:
                cuts = np.where(free, np.minimum(room[0], need[:, 0] - need[:, 2] + np.minimum(need[:, 2], room[2])), 0)
                k = int(np.argmax(cuts))
                if room[1] < 1 or cuts[k] < 1:
                    break
                front, rest = waiting[k].split(waiting[k].cut(int(room[0]), int(room[2])))
                bin_.append(front)
                room -= (front.length, 1, front.loss)
                waiting[k], need[k] = rest, (rest.length, 1, rest.loss)
            if room[0] < 1:
                break
        bins.append(bin_)
    if bins and not last and sum(x.length for x in bins[-1]) < max_tokens and len(bins[-1]) < max_segments:
        return bins[:-1], bins[-1]
    return bins, []


def _at_powers(bin_: list[_Item], max_tokens: int) -> list[list[_Item]]:
    """Cuts an underfilled bin into ones whose lengths are powers of two."""
    total, out, rest = sum(x.length for x in bin_), [], list(bin_)
    if total == max_tokens:
        return [bin_]
    while total:
        size, part = 1 << (total.bit_length() - 1), []
        total -= size
        while size:
            x = rest.pop(0)
            if x.length > size:
                x, later = x.split(size)
                rest.insert(0, later)
            part.append(x)
            size -= x.length
        out.append(part)
    return out


def pack_texts(
    df: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
    max_tokens: int = 2048,
    max_segments: int = 128,
    max_loss: int | None = None,
    end_id: int = 1,
    window: int = 1024,
) -> DataFrame:
    """Packs every row of `df`; one row per piece.

    `loss_from_col` (long) tells how many leading ids bear no loss, such as a prompt's; null or
    absent: every id bears loss. Returns `id_col`, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens (with the end id), loss_tokens, sequence_id and offset.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    if min(limits) < 1:
        raise ValueError("every limit must be at least 1")
    id_type = df.schema[id_col].dataType
    quiet = F.coalesce(F.col(loss_from_col), F.lit(0)) if loss_from_col else F.lit(0)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), quiet.cast("long").alias("quiet"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, ranks_path)
        encoder = _encoders.get(key) or _encoders.setdefault(key, _Encoder(*key))
        base, sequences = TaskContext.get().partitionId() << 33, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        docs: dict[int, tuple[pa.Scalar, bytes]] = {}
        items: list[_Item] = []

        def rows_of(bins: list[list[_Item]], type_: pa.DataType) -> pa.RecordBatch:
            nonlocal sequences
            out: list[list] = [[] for _ in range(8)]
            for bin_ in [part for whole in bins for part in _at_powers(whole, max_tokens)]:
                at = 0
                for x in bin_:
                    id_, ids = docs[x.row]
                    piece = (id_, x.start, x.length, ids[4 * x.start : 4 * (x.start + x.length)], len(ids) // 4, x.loss, base + sequences, at)
                    for column, value in zip(out, piece, strict=True):
                        column.append(value)
                    at += x.length
                sequences += 1
            types = [type_, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_col, "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        row, type_ = 0, None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for at in range(0, batch.num_rows, window):
                part = batch.slice(at, window)
                texts = part.column(1).to_pylist()
                for id_, ids, skip in zip(part.column(0).to_pylist(), map(encoder, texts), part.column(2).to_pylist(), strict=True):
                    ids += end
                    n = len(ids) // 4
                    docs[row] = (id_, ids)
                    rest = _Item(row, 0, n, max(0, n - max(0, skip)))
                    while rest.length > max_tokens:
                        front, rest = rest.split(max_tokens)
                        items.append(front)
                    items.append(rest)
                    row += 1
                bins, items = _fill(items, limits, last=False)
                yield rows_of(bins, type_)
                open_ = {x.row for x in items}
                docs = {k: v for k, v in docs.items() if k in open_}
        if items:
            bins, _ = _fill(items, limits, last=True)
            yield rows_of(bins, type_)

    kind = f"`{id_col}` {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(packed, kind)
