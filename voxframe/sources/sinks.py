"""Results written out: lines of a batch of recordings, one text a recording, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.timefmt import span_text


def _header(word: str, what: str) -> Column:
    return F.concat(F.lit(f"==={word} "), F.col("media_id").cast("string"), F.lit(" "), F.coalesce(what, F.lit("")), F.lit("==="))


def batch_lines(results: DataFrame) -> DataFrame:
    """(media_id, line_no, value) of recognised tokens (media_id, path, pos, text, start, end, status, error).

    A recording's first token follows its header; one that failed has an error line alone, and the others go on.  The rows
    are read once, so that no recogniser runs twice.
    """
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]+", " ")
    line = F.struct((F.col("pos") + 1).alias("line_no"), F.concat(span_text(F.col("start"), F.col("end")), F.lit(" "), flat).alias("value"))
    zero = F.lit(0).alias("line_no")
    head = F.struct(zero, _header("CHUNK", "path").alias("value"))
    failed = F.struct(zero, _header("ERROR", F.regexp_replace("error", "[\\r\\n]+", " ")).alias("value"))
    lines = F.when(F.col("status") == "error", F.array(failed)).when(F.col("pos") == 0, F.array(head, line)).otherwise(F.array(line))
    return results.select("media_id", F.inline(lines))


def exit_state(results: DataFrame) -> DataFrame:
    """(failed, state): how many recordings failed, and 2 if any did, else 0."""
    failed = F.count(F.when(F.col("status") == "error", 1))
    return results.agg(failed.alias("failed"), F.when(failed > 0, 2).otherwise(0).alias("state"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder a recording, its lines in order; each recording is one task's, within which it is sorted by runs on disk."""
    placed = lines.repartition("media_id").sortWithinPartitions("media_id", "line_no")
    placed.select("media_id", "value").write.partitionBy("media_id").mode("overwrite").text(path)


def write_texts(rendered: DataFrame, path: str) -> None:
    """One text a recording (plain or subtitles), each in its own folder."""
    rendered.select("media_id", F.col("text").alias("value")).write.partitionBy("media_id").mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.mode("overwrite").json(path)
