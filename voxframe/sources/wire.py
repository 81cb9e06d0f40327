"""Line formats between tools.  Lines that do not fit are left out, as every reader of these formats does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import strip_blanks, strip_controls

_SPAN = r"^\s*\[\s*(\d+(?:\.\d+)?)s\s*-\s*(\d+(?:\.\d+)?)s\]\s*"
DIARIZED = _SPAN + r"(Speaker \d+|UNKNOWN):\s*(.*)$"
TIMED = _SPAN + r"(.*)$"


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a line with line_no; all line ends that Unicode knows count."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(F.col(text), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")).alias("line_no", "value"))


def parse_diarized(lines: DataFrame, clean: bool = False) -> DataFrame:
    """(media_id, seg_no, start, end, speaker, text) of lines (media_id, line_no, value)."""
    part = lambda k: F.regexp_extract("value", DIARIZED, k)
    text = strip_controls(part(4)) if clean else strip_blanks(part(4))
    w = Window.partitionBy("media_id").orderBy("line_no")
    return lines.where(F.col("value").rlike(DIARIZED)).select(
        "media_id",
        (F.row_number().over(w) - 1).alias("seg_no"),
        part(1).cast("double").alias("start"),
        part(2).cast("double").alias("end"),
        part(3).alias("speaker"),
        text.alias("text"),
    )


def parse_timed(lines: DataFrame) -> DataFrame:
    """Timed lines of chunked output: each belongs to the last ===CHUNK header above it; after an ===ERROR none does."""
    w = Window.partitionBy("media_id").orderBy("line_no")
    head = F.when(F.col("value").rlike("^===CHUNK \\d+"), F.regexp_extract("value", "^===CHUNK (\\d+)", 1).cast("int")).when(
        F.col("value").rlike("^===ERROR "), -1
    )
    placed = lines.withColumn("chunk", F.last(head, ignorenulls=True).over(w))
    return placed.where(F.col("value").rlike(TIMED) & (F.coalesce("chunk", F.lit(0)) >= 0)).select(
        "media_id",
        F.coalesce("chunk", F.lit(0)).alias("chunk"),
        "line_no",
        F.regexp_extract("value", TIMED, 1).cast("double").alias("start"),
        F.regexp_extract("value", TIMED, 2).cast("double").alias("end"),
        strip_blanks(F.regexp_extract("value", TIMED, 3)).alias("text"),
    )


def parse_segments(lines: DataFrame) -> DataFrame:
    """(media_id, line_no, start, end, speaker_id) of lines "start end speaker"."""
    part = F.split(strip_blanks(F.col("value")), "(?U)\\s+")
    return lines.select(
        "media_id",
        "line_no",
        F.get(part, 0).try_cast("double").alias("start"),
        F.get(part, 1).try_cast("double").alias("end"),
        F.get(part, 2).try_cast("int").alias("speaker_id"),
    ).where("start IS NOT NULL AND end IS NOT NULL AND speaker_id IS NOT NULL")


def parse_request(line: Column) -> Column:
    """Struct (path, mode, context, lang) of a request: tab-separated, at most four parts, in any order after the path."""
    parts = F.split(line, "\\t", 4)
    rest = F.slice(parts, 2, 3)

    def tagged(tag: str) -> Column:
        hit = F.get(F.filter(rest, lambda p: p.startswith(tag)), 0)
        return F.substring(hit, len(tag) + 1, 1 << 30)

    mode = F.when(F.array_contains(rest, "diarize"), "diarize").when(F.array_contains(rest, "timestamps"), "timestamps")
    return F.struct(
        strip_blanks(F.get(parts, 0)).alias("path"),
        F.coalesce(mode, F.lit("text")).alias("mode"),
        tagged("context:").alias("context"),
        tagged("lang:").alias("lang"),
    )


def parse_key_values(lines: DataFrame) -> DataFrame:
    """(key, value) of KEY=value lines: comments and blank lines left out, one pair of quotes taken off, the last wins."""
    row = F.regexp_extract("value", "^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.*?)\\s*$", 2)
    bare = F.regexp_replace(row, "^([\"'])(.*)\\1$", "$2")
    key = F.regexp_extract("value", "^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=", 1)
    found = lines.where(key != "").select(key.alias("key"), bare.alias("value"), "line_no")
    return found.groupBy("key").agg(F.max(F.struct("line_no", "value"))["value"].alias("value"))
