"""Sound files as rows of samples."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, sample_rate int, channels int, samples array<float>, status string, error string"


def decode_wav(data: bytes, strict: bool = False) -> tuple[int, int, np.ndarray]:
    """Rate, channels and samples of a RIFF file of 32-bit floats or 16-bit integers (these over 32768).

    strict: 16-bit integers only, at 16 kHz and of one channel.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    source, form = io.BytesIO(data[12:]), None
    while head := source.read(8):
        kind, size = struct.unpack("<4sI", head)
        body = source.read(size + size % 2)[:size]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE:
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif kind == b"data":
            if form is None:
                raise ValueError("samples before their format")
            code, channels, rate, _, _, bits = form
            if strict and (rate, channels, code, bits) != (16000, 1, 1, 16):
                raise ValueError(f"{rate} Hz with {channels} channels and {bits} bits; 16000 Hz, mono and 16-bit integers are wanted")
            if (code, bits) == (3, 32):
                return rate, channels, np.frombuffer(body[: size // 4 * 4], "<f4")
            if (code, bits) == (1, 16):
                return rate, channels, (np.frombuffer(body[: size // 2 * 2], "<i2") / 32768.0).astype(np.float32)
            raise ValueError(f"unsupported sample format {code} with {bits} bits")
    raise ValueError("no samples")


def read_audio(spark: SparkSession, path: str, strict_mono: bool = False, strict: bool = False) -> DataFrame:
    """A row per file.  A file that cannot be read gives status ``error`` and its message; the others go on.

    strict_mono: also reject what is not 16 kHz and mono; strict: what is not 16-bit integers either.
    """

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rate, channels, samples = decode_wav(content, strict)
                    if strict_mono and (rate, channels) != (16000, 1):
                        raise ValueError(f"{rate} Hz with {channels} channels; 16000 Hz mono is wanted")
                    row = (where, rate, channels, samples.tolist(), "ok", None)
                except (ValueError, struct.error) as e:
                    row = (where, None, None, None, "error", str(e))
                types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(row, types, strict=True)],
                    names=["path", "sample_rate", "channels", "samples", "status", "error"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths listed one a line, trimmed, blank lines left out."""
    from pyspark.sql import functions as F

    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
