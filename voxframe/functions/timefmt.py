"""Seconds as text.  All functions take and return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(value: Column, width: int = 2) -> Column:
    text = value.cast("long").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, cut off."""
    s = F.floor(seconds)
    return F.concat_ws(":", _pad(F.floor(s / 3600)), _pad(F.floor(s % 3600 / 60)), _pad(s % 60))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds are cut off in binary floating point."""
    x = seconds.cast("double")
    return F.concat(hms(x), F.lit(","), _pad((x % 1 * 1000).cast("int"), 3))


def fixed(value: Column, digits: int = 2) -> Column:
    """Fixed decimals without digit grouping, rounded half-even on the binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def span_text(start: Column, end: Column) -> Column:
    """[S.SSs - E.EEs]"""
    return F.concat(F.lit("["), fixed(start), F.lit("s - "), fixed(end), F.lit("s]"))


def stream_span_text(start: Column, end: Column) -> Column:
    """Like span_text, each number at least five characters wide."""

    def wide(x: Column) -> Column:
        text = fixed(x)
        return F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0"))

    return F.concat(F.lit("["), wide(start), F.lit("s - "), wide(end), F.lit("s]"))


def elapsed(seconds: Column) -> Column:
    """12.3s under a minute, MM:SS under an hour, else HH:MM:SS."""
    whole = F.floor(seconds)
    short = F.concat(fixed(seconds, 1), F.lit("s"))
    minutes = F.concat_ws(":", _pad(F.floor(whole / 60)), _pad(whole % 60))
    return F.when(seconds < 60, short).when(seconds < 3600, minutes).otherwise(hms(seconds))


def media_length(seconds: Column) -> Column:
    """M:SS from a minute on, else 0.0s."""
    whole = F.floor(seconds)
    return F.when(
        seconds >= 60, F.concat_ws(":", F.floor(whole / 60).cast("string"), _pad(whole % 60))
    ).otherwise(F.concat(fixed(seconds, 1), F.lit("s")))


def player_clock(millis: Column) -> Column:
    """M:SS of a player position in milliseconds."""
    s = F.floor(millis / 1000)
    return F.concat_ws(":", F.floor(s / 60).cast("string"), _pad(s % 60))
