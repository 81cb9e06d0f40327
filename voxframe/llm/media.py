"""Media columns: bytes stored as PNG in a binary column, read back, and hashed by low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .rows import bound_batches, map_texts, slices, with_id

#: Row width of an image in samples; payloads are padded to whole rows.
WIDTH = 576
_MAGIC = b"\x89PNG\r\n\x1a\n"
_GRID, _LOW = 32, 8
#: Media bytes decoded at once.
_SLICE = 4 << 20
FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, phash binary"
)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the row width."""
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)


def filtered(rows: np.ndarray, kinds: tuple[int, ...] = (0, 1, 2), step: int = 1) -> np.ndarray:
    """Rows of bytes after their filter byte: of ``kinds`` each row gets the one whose result has the least magnitude."""
    wide = rows.astype(np.int16)
    left, up, corner = np.zeros_like(wide), np.zeros_like(wide), np.zeros_like(wide)
    left[:, step:], up[1:], corner[1:, step:] = wide[:, :-step], wide[:-1], wide[:-1, :-step]
    guesses = {0: lambda: 0, 1: lambda: left, 2: lambda: up, 3: lambda: (left + up) // 2, 4: lambda: _nearest(left, up, corner)}
    made = [(wide - guesses[k]()).astype(np.uint8) for k in kinds]
    best = np.argmin([np.abs(m.view(np.int8).astype(np.int32)).sum(axis=1) for m in made], axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), dtype=np.uint8)
    out[:, 0] = np.array(kinds, dtype=np.uint8)[best]
    for k, m in enumerate(made):
        out[best == k, 1:] = m[best == k]
    return out


def png_encode(payload: bytes, level: int = 1, kinds: tuple[int, ...] = (0, 1, 2)) -> bytes:
    """An 8-bit grey image whose samples are the payload, each row filtered by one of ``kinds``."""
    raw = filtered(np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH), kinds)
    head = struct.pack(">IIBBBBB", WIDTH, len(raw), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _nearest(left, up, corner):
    """Of the three neighbours the one nearest to left + up - corner; the first named of equally near ones."""
    near = left + up - corner
    a, b, c = np.abs(near - left), np.abs(near - up), np.abs(near - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _diagonals(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo filters that look left and up at once: what lies on one diagonal needs the diagonals before it only."""
    height, width = raw.shape[0], raw.shape[1] // step
    given = raw.reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), dtype=np.int16)  # zeros above and on the left
    for d in range(width + height - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        left, up, corner = out[r + 1, d - r], out[r, d - r + 1], out[r, d - r]
        kind = kinds[r][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, _nearest(left, up, corner)], 0)
        out[r + 1, d - r + 1] = (given[r, d - r] + guess) & 255
    return out[1:, 1:].reshape(raw.shape).astype(np.uint8)


def unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters.  raw: rows of bytes; kinds: the filter of each row; step: bytes between like samples."""
    if kinds.max(initial=0) > 4:
        raise ValueError(f"unknown row filter {kinds.max()}")
    if (kinds > 2).any():
        return _diagonals(raw, kinds, step)
    out = raw.copy()
    for c in range(step):  # bytes wrap around, as the filters do
        out[kinds == 1, c::step] = np.cumsum(raw[kinds == 1, c::step], axis=1, dtype=np.uint8)
    upward = kinds == 2
    upward[:1] = False  # nothing is above the first row
    first = np.flatnonzero(upward & ~np.r_[False, upward[:-1]])
    last = np.flatnonzero(upward & ~np.r_[upward[1:], False])
    for a, b in zip(first, last, strict=True):  # a run of such rows adds up from the row before it
        out[a - 1 : b + 1] = np.cumsum(out[a - 1 : b + 1], axis=0, dtype=np.uint8)
    return out


def png_decode(media: bytes) -> np.ndarray:
    """Samples of an 8-bit image as rows of bytes.  Raises ValueError on a bad magic, checksum, length or format."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, head, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut off inside a chunk")
        (size,) = struct.unpack_from(">I", media, at)
        body = media[at + 4 : at + 8 + size]
        if len(body) < 4 + size or at + 12 + size > len(media):
            raise ValueError("cut off inside a chunk")
        if zlib.crc32(body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("chunk checksum does not match")
        kind, body = body[:4], body[4:]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, _, _, lace = head
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or lace or not step:
        raise ValueError("only plain 8-bit images are read")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    if len(raw) != height * (width * step + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, width * step + 1)
    return unfilter(raw[:, 1:], raw[:, 0], step)


def _cosines() -> np.ndarray:
    k, n = np.arange(_LOW)[:, None], np.arange(_GRID)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * _GRID))


def _shrink(rows: np.ndarray, axis: int) -> np.ndarray:
    n = rows.shape[axis]
    edge = np.arange(_GRID) * n // _GRID
    count = np.maximum(np.diff(np.r_[edge, n]), 1)
    return np.add.reduceat(rows, edge, axis=axis) / (count[:, None] if axis == 0 else count[None, :])


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 mean image lie above their median."""
    small = _shrink(_shrink(image.astype(np.float64), 0), 1)
    basis = _cosines()
    low = np.round(basis @ small @ basis.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """doc_id, n_bytes (unpadded), media (PNG bytes).  A null text is stored as an empty one: one row of bytes 255."""

    def kernel():
        def work(texts: list) -> dict[str, list]:
            data = [(t or "").encode() for t in texts]
            return {"n_bytes": [len(d) for d in data], "media": [png_encode(pad(d), level) for d in data]}

        return work

    return map_texts(df, kernel, "n_bytes long, media binary", id_col, text_col)


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads every image of a binary column back and describes it; doc_id and n_bytes pass through.

    A null image gives null features; a damaged one raises ValueError, so that no wrong value is returned.
    """
    bound_batches(df.sparkSession)
    rows = df.select("doc_id", "n_bytes", F.col(media_col).alias("_media"))
    schema = with_id(rows.schema["doc_id"], FEATURES)
    arrow = to_arrow_schema(schema)

    def describe(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 7
        image = png_decode(media)
        payload = image.tobytes()
        phash = cosine_hash(image)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
            hashlib.sha256(media).hexdigest(), phash.hex(), phash,
        )

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column(2), _SLICE):
                part = batch.slice(start, stop - start)
                made = list(zip(*map(describe, part.column(2).to_pylist()), strict=True))
                cols = [part.column(0).cast(arrow.field(0).type), part.column(1)]
                cols += [pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return rows.mapInArrow(run, schema)
