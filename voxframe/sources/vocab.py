"""Token vocabularies from text and from model files, and choosing among model files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """(id, piece) of "piece id" lines, split at the first blank."""
    part = F.split("value", " ", 2)
    return lines.select(F.get(part, 1).try_cast("int").alias("id"), F.get(part, 0).alias("piece")).where("id IS NOT NULL")


def blank_id(vocabulary: DataFrame) -> DataFrame:
    """One row (blank): the id of <blk> or <blank> unless that is 0 or missing, then the last id."""
    named = F.max(F.when(F.col("piece").isin("<blk>", "<blank>"), F.col("id")))
    return vocabulary.agg(F.when(F.coalesce(named, F.lit(0)) > 0, named).otherwise(F.max("id")).alias("blank"))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def sentencepiece_pieces(data: bytes) -> list[str]:
    """Pieces of a SentencePiece model file, in order."""
    pieces = []
    for field, value in _fields(data):
        if field == 1 and isinstance(value, bytes):
            pieces.append(next((v.decode() for f, v in _fields(value) if f == 1), ""))
    return pieces


def read_sentencepiece(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, piece) of model files."""

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = sentencepiece_pieces(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())],
                    names=["path", "id", "piece"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, id int, piece string")


def is_special(piece: Column, kind: str = "transducer") -> Column:
    """Pieces that are no text: <|...|>, <unk>, <pad> for attention decoders; <...> but <unk> for transducers."""
    if kind == "attention":
        return piece.rlike("^<\\|.*\\|>$") | piece.isin("<unk>", "<pad>")
    return piece.rlike("^<.*>$") & (piece != "<unk>")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(location, n_files, size_mb) of the folders below a path, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("location")).agg(
        F.count("*").alias("n_files"), F.floor(F.sum("length") / (1 << 20)).cast("long").alias("size_mb")
    )


def total_size(rows: DataFrame) -> DataFrame:
    """Number and total size; from 1024 MB on in GB with one decimal."""
    total = F.coalesce(F.sum("size_mb"), F.lit(0))
    text = F.when(total >= 1024, F.concat(F.call_function("format_number", total / 1024, F.lit("0.0")), F.lit(" GB"))).otherwise(
        F.concat(total.cast("string"), F.lit(" MB"))
    )
    return rows.agg(F.count("*").alias("n"), text.alias("size"))


def pick_candidate(files: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """Of each folder's files (location, name) the first candidate by order, else the first name with the prefix."""
    rank = F.coalesce(
        *[F.when(F.col("name") == n, k) for k, n in enumerate(names)],
        F.when(F.col("name").startswith(prefix), len(names)),
    )
    w = Window.partitionBy("location").orderBy("_rank", "name")
    ranked = files.withColumn("_rank", rank).where("_rank IS NOT NULL").withColumn("_n", F.row_number().over(w))
    return ranked.where("_n = 1").drop("_rank", "_n")


def pick_folder(folders: DataFrame, wanted: str) -> DataFrame:
    """In name order the first folder (name) that is the wanted one or contains "-wanted", else the first."""
    hit = (F.col("name") == wanted) | F.contains("name", F.lit(f"-{wanted}"))
    return folders.orderBy(F.when(hit, 0).otherwise(1), "name").limit(1)


def languages_listed(languages: DataFrame, preferred: list[str]) -> DataFrame:
    """(lang, n): preferred languages in their order, then the others sorted."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("lang"))
    order = F.when(place > 0, place).otherwise(len(preferred) + 1)
    distinct = languages.select("lang").distinct().withColumn("_o", order)
    return distinct.withColumn("n", F.row_number().over(Window.orderBy("_o", "lang"))).drop("_o")
