"""Transcripts as text: plain, subtitles, JSON, prompts, and the commands that type them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import typing_text
from voxframe.functions.timefmt import hms, media_length, span_text, srt_time


def _ordered(order: str, column: str, glue: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), glue)


def with_names(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments with ``display``: the name given to a speaker, else the speaker's id."""
    known = names.select("media_id", "speaker", F.col("display").alias("_display"))
    return segments.join(known, ["media_id", "speaker"], "left").withColumn(
        "display", F.coalesce("_display", "speaker")
    ).drop("_display")


def span_lines(segments: DataFrame) -> DataFrame:
    """[S.SSs - E.EEs] Speaker: text"""
    line = F.concat(span_text(F.col("start"), F.col("end")), F.lit(" "), F.col("speaker"), F.lit(": "), F.col("text"))
    return segments.select("media_id", "seg_no", line.alias("line"))


def plain_text(segments: DataFrame) -> DataFrame:
    """One text a medium: a header where the speaker changes, a blank line before it, lines indented by five blanks."""
    w = Window.partitionBy("media_id").orderBy("seg_no")
    before = F.lag("speaker").over(w)
    head = (
        F.when(before.isNull(), F.concat(F.col("display"), F.lit(":\n")))
        .when(before != F.col("speaker"), F.concat(F.lit("\n"), F.col("display"), F.lit(":\n")))
        .otherwise("")
    )
    lines = segments.withColumn("_line", F.concat(head, F.lit("     "), F.col("text")))
    return lines.groupBy("media_id").agg(_ordered("seg_no", "_line", "\n").alias("text"))


def srt_entries(segments: DataFrame) -> DataFrame:
    """Numbered subtitle entries, one row each."""
    w = Window.partitionBy("media_id").orderBy("seg_no")
    n = F.row_number().over(w)
    body = F.concat(
        n.cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n["),
        F.col("display"), F.lit("] "), F.col("text"), F.lit("\n"),
    )
    return segments.select("media_id", n.alias("n"), body.alias("entry"))


def srt_text(segments: DataFrame) -> DataFrame:
    return srt_entries(segments).groupBy("media_id").agg(_ordered("n", "entry", "\n").alias("text"))


def json_text(segments: DataFrame) -> DataFrame:
    """An array of objects a medium, with the speaker's id and displayed name."""
    row = F.struct("seg_no", "start", "end", F.col("speaker").alias("speaker_id"), F.col("display").alias("speaker"), "text")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("seg_no"))
    return segments.groupBy("media_id").agg(F.to_json(rows).alias("text"))


def prompt_text(segments: DataFrame) -> DataFrame:
    """[Speaker] (H:M:S → H:M:S): text, separated by blank lines."""
    line = F.concat(
        F.lit("["), F.col("display"), F.lit("] ("), hms(F.col("start")), F.lit(" → "), hms(F.col("end")), F.lit("): "), F.col("text")
    )
    return segments.withColumn("_line", line).groupBy("media_id").agg(_ordered("seg_no", "_line", "\n\n").alias("text"))


def prompt_plain(segments: DataFrame) -> DataFrame:
    """Texts alone, empty ones left out."""
    return segments.where(F.trim("text") != "").groupBy("media_id").agg(_ordered("seg_no", "text", "\n\n").alias("text"))


def typing_commands(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, kind, value): text to type, and keys for newline (enter), \\x01 (ctrl+j) and tab."""
    marked = F.regexp_replace(typing_text(F.col(text)), "(?=[\\n\\x01\\t])|(?<=[\\n\\x01\\t])", "\x00")
    parts = F.filter(F.split(marked, "\\x00"), lambda p: p != "")
    rows = df.select(key, F.posexplode(parts).alias("n", "part"))
    kind = F.when(F.col("part") == "\n", "enter").when(F.col("part") == "\x01", "ctrl+j").when(F.col("part") == "\t", "tab")
    return rows.select(
        key, "n", F.coalesce(kind, F.lit("type")).alias("kind"), F.when(kind.isNull(), F.col("part")).alias("value")
    )


def timeline_markers(segments: DataFrame, colours: list[str]) -> DataFrame:
    """Milliseconds and colour of each segment; speakers take colours in turn by their index."""
    palette = F.array(*map(F.lit, colours))
    return segments.select(
        "media_id",
        "seg_no",
        (F.col("start") * 1000).cast("long").alias("start_ms"),
        (F.col("end") * 1000).cast("long").alias("end_ms"),
        F.element_at(palette, F.pmod(F.col("speaker_index"), F.lit(len(colours))) + 1).alias("colour"),
    )


def text_from(segments: DataFrame, threshold: float, slack: float = 0.5) -> DataFrame:
    """(media_id, text): the texts that start up to ``slack`` seconds before a time, or later, joined by a space."""
    return segments.where(F.col("start") >= threshold - slack).groupBy("media_id").agg(_ordered("seg_no", "text", " ").alias("text"))


def run_summary(segments: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(media_id, n_speakers, length, summary) of segments (media_id, speaker, end): distinct speakers and the length of
    each medium; with runs (media_id, transcribe_seconds, translate_seconds, either null) also how long these took.

    The summary joins what is known by a dash.
    """
    made = segments.groupBy("media_id").agg(F.countDistinct("speaker").alias("n_speakers"), media_length(F.max("end")).alias("length"))
    took: list[Column] = []
    if runs is not None:
        made = made.join(runs.select("media_id", "transcribe_seconds", "translate_seconds"), "media_id", "left")
        took = [
            F.when(F.col(c).isNotNull(), F.concat(F.lit(word), media_length(F.col(c))))
            for word, c in (("transcribed in ", "transcribe_seconds"), ("translated in ", "translate_seconds"))
        ]
    speakers = F.concat(F.col("n_speakers").cast("string"), F.when(F.col("n_speakers") == 1, F.lit(" speaker")).otherwise(F.lit(" speakers")))
    return made.select("media_id", "n_speakers", "length", F.concat_ws(" — ", speakers, "length", *took).alias("summary"))
