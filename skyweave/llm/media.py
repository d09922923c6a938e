"""Media columns: any bytes as PNG images in binary columns, read back with all checks, and their cosine-transform hashes.

An image has 64 RGB pixels a row, so a payload is padded to a multiple of 192 bytes.  The file is a
signature and chunks (IHDR, IDAT, IEND), each with its CRC; IDAT holds the rows, filtered, in a zlib
stream with its Adler checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import frugal
from .columns import packed, passing, unpacked

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

WIDTH, RGB, UNIT = 64, 2, 192
IDAT_BYTES = 1 << 20
LEVEL = 2
#: Bytes of texts, or one text, that a batch of results is made of.
OUT_BYTES = 1 << 24


def pad(data: bytes, unit: int = UNIT, fill: bytes = b" ") -> bytes:
    return data + fill * (max(unit, -(-len(data) // unit) * unit) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter of each row (none, to the left, or to the row above) with the least sum of signed sizes, the first of equal ones, and the filtered rows."""
    left, up = rows.copy(), rows.copy()
    left[:, 3:] -= rows[:, :-3]
    up[1:] -= rows[:-1]
    made = np.stack([rows, left, up])
    kinds = np.minimum(made, -made).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return kinds.astype(np.uint8), made[kinds, np.arange(len(rows))]


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """Each row with the filter that suits it.  The same payload always gives the same file."""
    line = width * 3
    if not payload or len(payload) % line:
        raise ValueError(f"a payload has a positive multiple of {line} bytes")
    kinds, rows = filtered(np.frombuffer(payload, np.uint8).reshape(-1, line))
    stream = zlib.compress(np.column_stack([kinds, rows]).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, RGB, 0, 0, 0)
    parts = [_chunk(b"IDAT", stream[i : i + IDAT_BYTES]) for i in range(0, len(stream), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the five row filters; runs of rows without a filter, or with the filter to the row above, are done at once."""
    out = rows.copy()
    edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else np.array([], int)
    for a, b in zip(edges, np.r_[edges[1:], len(kinds)], strict=True):
        kind = int(kinds[a])
        if kind == 0:
            continue
        if kind == 1:
            run = out[a:b].reshape(b - a, -1, bpp)
            out[a:b] = np.cumsum(run, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for i in range(a, b):
                above = out[i - 1].astype(np.int16) if i else np.zeros(out.shape[1], np.int16)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for j in range(0, out.shape[1], bpp):
                    up = above[j : j + bpp]
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                        guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
                    left = (out[i, j : j + bpp] + guess) & 255
                    out[i, j : j + bpp], corner = left, up
        else:
            raise ValueError(f"row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a PNG of 8 bits a sample, without palette or interlace: (height, width, channels).

    ValueError: a wrong signature, chunk, checksum, filter or size."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, stream, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if head is not None or at != 8 or n != 13:
                raise ValueError("IHDR is not the first chunk, or has not 13 bytes")
            head = struct.unpack(">IIBBBBB", body)
        elif head is None:
            raise ValueError("IHDR is not the first chunk, or has not 13 bytes")
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, packing, filters, interlace = head
    if depth != 8 or colour not in CHANNELS or packing or filters or interlace or not width or not height:
        raise ValueError("only 8-bit images without palette or interlace")
    bpp = CHANNELS[colour]
    size = height * (1 + width * bpp)
    try:
        unpacker = zlib.decompressobj()
        raw = unpacker.decompress(b"".join(stream), size + 1)  # no more is made than the image has
    except (zlib.error, OverflowError) as e:
        raise ValueError(f"zlib stream: {e}") from e
    if len(raw) != size or not unpacker.eof:
        raise ValueError("size of the samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(rows[:, 0], rows[:, 1:], bpp).reshape(height, width, bpp)


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))


SIDE, LOW = 32, 8
_BASIS = _cosines(SIDE, LOW)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest frequencies of the grey image, shrunk to 32 by 32, exceed their median.

    A side below 32 is stretched by repeating its samples."""
    grey = samples.sum(axis=2, dtype=np.int64)
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        sums = np.add.reduceat(grey, edges, axis=axis) if n >= SIDE else np.take(grey, edges, axis=axis)
        counts = np.diff(np.r_[edges, n]) if n >= SIDE else np.ones(SIDE)
        grey = sums / counts.reshape((-1, 1) if axis == 0 else (1, -1))
    low = (_BASIS @ grey @ _BASIS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def with_media(df: DataFrame, text: str, media: str = "media", payload: str = "payload", feature: str = "feature") -> DataFrame:
    """Replaces ``text`` (null: empty) by a PNG of its padded UTF-8 bytes, the payload read back from that file, and its hash.

    ``text`` may be a string or binary column.  Rows are done one by one, so memory follows the largest
    text; a file that is read back wrong raises ValueError.  Equal texts get equal values.  Other columns pass; those of the
    added names are replaced.  An empty table gives no rows.  No shuffle."""
    rest = passing(df, (text, media, payload, feature))
    rows = df.select(packed(rest), F.col(f"`{text}`").alias("text"))
    schema = rows.select("row").schema.add("media", "binary").add("payload", "binary").add("feature", "binary")
    index = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(index).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().cumsum()
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + OUT_BYTES)))
                files, loads, marks = [], [], []
                for t in texts[at:end]:
                    files.append(encode_png(pad(t.as_py() or b"")))
                    image = decode_png(files[-1])
                    loads.append(image.tobytes())
                    marks.append(cosine_hash(image))
                columns = [c.slice(at, end - at) for c in batch.columns[:index]]
                step = [*columns, pa.array(files, pa.binary()), pa.array(loads, pa.binary()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(step, schema.names)
                at = end

    return unpacked(rows.mapInArrow(frugal(run), schema), rest, F.col("media").alias(media), F.col("payload").alias(payload), F.col("feature").alias(feature))
