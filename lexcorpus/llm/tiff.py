"""TIFF columns: a reader that emits one row per page, and a writer to make such columns.

The reader walks the chain of image directories of a classic TIFF in either byte order, decodes
strips or tiles that are stored plain or by PackBits, LZW or deflate, undoes horizontal
differencing, and crops tiles at the page's edges. It handles 8-bit samples in one plane, any
number of them per pixel. A page that cannot be decoded gives a row with its error and no pixels;
what is no TIFF at all gives one row, page 0, with an error. A null gives no row. Directories that
point back to earlier ones end the walk.

The writer lays a payload out in pages of `WIDTH` samples a row, with tiles or strips and codecs
that follow from each page's own bytes, so equal payloads give equal files.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: tag numbers and compression schemes.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "strip_rows": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_CODES = {1: "B", 3: "H", 4: "I"}
#: The writer's samples per row, rows per page, per strip, and the side of a tile.
WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 576, 64, 16, 64
#: The writer's choices: (compression, in tiles, with differences), taken by a page's checksum.
STYLES = ((LZW, False, False), (LZW, True, True), (PACKBITS, False, False), (PACKBITS, True, False), (DEFLATE, False, False), (DEFLATE, False, True), (DEFLATE, True, False), (DEFLATE, True, True))


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """Stops once `most` bytes are there; so do the other decoders."""
    out, i, n, size = [], 0, len(data), 0
    while i < n and (most is None or size < most):
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
            continue
        size += len(out[-1])
    return b"".join(out)


def pack_bits(row: bytes) -> bytes:
    out, at = [], 0
    for run in [*re.finditer(rb"(.)\1{2,}", row, re.DOTALL), None]:
        stop = run.start() if run else len(row)
        while at < stop:
            part = row[at : min(stop, at + 128)]
            out.append(bytes([len(part) - 1]) + part)
            at += len(part)
        if run:
            left = run.end() - at
            while left > 1:
                n = min(left, 128)
                out.append(bytes([257 - n, row[at]]))
                left -= n
                at += n
            at = run.end() - left
    return b"".join(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes are most significant bit first and widen one code early, as the format asks."""
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    table = singles.copy()
    out, previous, width, bits, held = [], b"", 9, 0, 0
    size, room = len(table), math.inf if most is None else most
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or room <= 0:
            break
        if code == 256:
            table, size = singles.copy(), 258
            previous, width = b"", 9
            continue
        if code < size:
            entry = table[code]
        elif code == size and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(entry)
        room -= len(entry)
        if previous:
            table.append(previous + entry[:1])
            size += 1
            if size >= 511:
                width = 10 if size < 1023 else 11 if size < 2047 else 12
        previous = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 9, 256, 9
    # A string in the table is known by the code of all but its last byte, and that byte.
    codes: dict[int, int] = {}
    following, prefix = 258, data[0] if data else -1

    for byte in data[1:]:
        longer = prefix << 8 | byte
        known = codes.get(longer)
        if known is not None:
            prefix = known
            continue
        held = held << width | prefix
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1
        codes[longer] = following
        following += 1
        prefix = byte
        if following == 4094:
            held = held << width | 256
            bits += width
            codes = {}
            following, width = 258, 9
        elif following >= (1 << width):
            width += 1
    if prefix >= 0:
        held = held << width | prefix
        bits += width
        if following + 1 >= (1 << width) and width < 12:
            width += 1
    held = held << width | 257
    bits += width
    out += (held << (-bits % 8)).to_bytes((bits + 7) // 8, "big")
    return bytes(out)


def _decoded(data: bytes, compression: int, most: int) -> bytes:
    """At most about `most` bytes, whatever the data would unfold to."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {compression} is not supported")


def _encoded(block: np.ndarray, compression: int) -> bytes:
    if compression == PACKBITS:  # each row on its own
        return b"".join(pack_bits(r.tobytes()) for r in block)
    return lzw_encode(block.tobytes()) if compression == LZW else zlib.compress(block.tobytes(), 1)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _CODES:
            form = f"{order}{count}{_CODES[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            found[tag] = struct.unpack_from(form, data, place)
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> dict:
    def one(name: str, default: int | None = None) -> int:
        value = tags.get(TAGS[name], (default,))[0]
        if value is None:
            raise ValueError(f"tag {name} is missing")
        return value

    width, height, samples = one("width"), one("height"), one("samples", 1)
    compression, predictor, tiled = one("compression", NONE), one("predictor", 1), TAGS["tile_offsets"] in tags
    if set(tags.get(TAGS["bits"], (1,))) != {8} or one("planar", 1) != 1 or predictor not in (1, 2):
        raise ValueError("only 8-bit samples in one plane, plain or differenced, are supported")
    wide, high = (one("tile_width"), one("tile_height")) if tiled else (width, min(one("strip_rows", height), height))
    kind = "tile" if tiled else "strip"
    offsets, counts = tags[TAGS[f"{kind}_offsets"]], tags[TAGS[f"{kind}_counts"]]
    if min(wide, high, width, height, samples) < 1:
        raise ValueError("a page without samples")
    across = -(-width // wide)
    if len(offsets) != across * -(-height // high) or len(counts) != len(offsets):
        raise ValueError("blocks do not cover the page")
    rows = []
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        tall = high if tiled else min(high, height - k * high)
        block = np.frombuffer(_decoded(data[offset : offset + count], compression, tall * wide * samples), dtype=np.uint8)
        if block.size < tall * wide * samples:
            raise ValueError("a block is cut short")
        block = block[: tall * wide * samples].reshape(tall, wide, samples)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=np.uint8)
        if k % across == 0:
            rows.append([])
        rows[-1].append(block)
    pixels = np.concatenate([np.concatenate(r, axis=1) if len(r) > 1 else r[0] for r in rows])[:height, :width]
    return {"width": width, "height": height, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": pixels.tobytes(), "levels": np.bincount(pixels.ravel() >> 5, minlength=8).tolist()}


_EMPTY = dict.fromkeys(("width", "height", "samples", "compression", "predictor", "tiled", "pixels", "levels"))
PAGE = "struct<page: int, width: int, height: int, samples: int, compression: int, predictor: int, tiled: boolean, pixels: binary, levels: array<int>, error: string>"


def pages(data: bytes) -> Iterator[dict]:
    """All pages of one file, in order."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order or len(data) < 8:
        yield {"page": 0, **_EMPTY, "error": "not a TIFF"}
        return
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
        except struct.error:
            yield {"page": len(seen) - 1, **_EMPTY, "error": "a directory is cut short"}
            return
        try:
            yield {"page": len(seen) - 1, **_page(data, tags), "error": None}
        except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
            yield {"page": len(seen) - 1, **_EMPTY, "error": str(e)[:200]}


def write(payload: bytes, width: int = WIDTH) -> bytes:
    """A little-endian file of `payload`, whose length is a positive multiple of `width`."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    out, link = [b"II*\0", b""], 1
    size = 8
    for top in range(0, len(image), PAGE_ROWS):
        page = image[top : top + PAGE_ROWS]
        compression, tiled, differenced = STYLES[zlib.crc32(page.tobytes()) % len(STYLES)]
        blocks = []
        if tiled:
            high, wide = -(-len(page) // 16) * 16, -(-width // TILE) * TILE
            padded = np.zeros((high, wide), dtype=np.uint8)
            padded[: len(page), :width] = page
            blocks = [padded[:, x : x + TILE] for x in range(0, wide, TILE)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        if differenced:
            blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
        stored = [_encoded(np.ascontiguousarray(b), compression) for b in blocks]
        offsets = (size + np.cumsum([0, *map(len, stored[:-1])])).tolist()
        out += stored
        size += sum(map(len, stored))
        entries = [("width", [width]), ("height", [len(page)]), ("bits", [8]), ("compression", [compression]), ("photometric", [1]), ("samples", [1]), ("predictor", [2 if differenced else 1])]
        if tiled:
            entries += [("tile_width", [TILE]), ("tile_height", [high]), ("tile_offsets", offsets), ("tile_counts", [len(s) for s in stored])]
        else:
            entries += [("strip_rows", [STRIP_ROWS]), ("strip_offsets", offsets), ("strip_counts", [len(s) for s in stored])]
        entries.sort(key=lambda e: TAGS[e[0]])
        behind = []
        pad = size % 2
        at, extra = size + pad, size + pad + 6 + 12 * len(entries)
        fields = []
        for name, values in entries:
            body = struct.pack(f"<{len(values)}I", *values)
            if len(body) > 4:
                behind.append(body)
                body, extra = struct.pack("<I", extra), extra + len(behind[-1])
            fields.append(struct.pack("<HHI", TAGS[name], 4, len(values)) + body)
        out[link] = struct.pack("<I", at)
        directory = b"\0" * pad + struct.pack("<H", len(entries)) + b"".join(fields)
        out += [directory, struct.pack("<I", 0), *behind]
        link = len(out) - 1 - len(behind)
        size = extra
    return b"".join(out)


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for media in batches:
        yield pd.Series([None if m is None else list(pages(bytes(m))) for m in media], dtype=object)


def _write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for payloads in batches:
        yield pd.Series([None if p is None else write(bytes(p)) for p in payloads], dtype=object)


def decoded(media: Column) -> Column:
    """The pages of a TIFF column as an array of structs."""
    return F.pandas_udf(_read, f"array<{PAGE}>")(media)


def encoded(payload: Column) -> Column:
    """A TIFF column of payloads that fill whole rows."""
    return F.pandas_udf(_write, "binary")(payload)


def read_pages(df: DataFrame, media_col: str) -> DataFrame:
    """One row per page of `media_col`; the other columns of `df` are repeated, the media left out.

    Columns of `df` with the name of a column of pages are left out too. Rows without media give no
    row, equal rows give equal rows, and an empty table gives none.
    """
    names = _EMPTY.keys() | {"page", "error"}
    paged = df.withColumn("__page", F.explode(decoded(F.col(media_col))))
    return paged.select(*[F.col(f"`{c}`") for c in df.columns if c != media_col and c not in names], "__page.*")
