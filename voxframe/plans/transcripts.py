"""Whole plans: from recordings to rendered transcripts, and from dictated text to shown text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.intervals import merge_chunks, overlap_join
from voxframe.operators.render import span_lines
from voxframe.operators.sequence import drop_repeated, sentences_from_words, words_from_tokens
from voxframe.operators.textrules import Gates, TextChain


def sentences_of(tokens: DataFrame) -> DataFrame:
    """Timed tokens to words, repeats dropped, to sentences."""
    return sentences_from_words(drop_repeated(words_from_tokens(tokens)))


def diarized_transcript(tokens: DataFrame, segments: DataFrame, tie: str = "last") -> DataFrame:
    """(media_id, seg_no, start, end, speaker, text) of tokens and speaker segments."""
    sentences = sentences_of(tokens).withColumnRenamed("sentence_no", "pos")
    return overlap_join(sentences, segments, tie).withColumnRenamed("pos", "seg_no")


def chunked_transcript(chunk_tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """The same from overlapping chunks, where the chunk's own zone decides which copy of a token stays."""
    merged = merge_chunks(chunk_tokens)
    rows = merged.select("media_id", F.xxhash64("media_id", "start", "end", "text").alias("pos"), "start", "end", "text")
    return overlap_join(rows, segments, "first")


def dictated_text(
    df: DataFrame,
    source: TextChain,
    translate: Callable[[DataFrame], DataFrame] | None = None,
    target: TextChain | None = None,
    target_lang: str | None = None,
) -> DataFrame:
    """normal: the source chain; with ``translate`` the text is translated after it (failure keeps it); with ``target``
    a second pass follows in the target language."""
    out = source.apply(df)
    if translate is None:
        return out
    out = translate(out).withColumn("text", F.coalesce("translated", "text")).drop("translated")
    if target is None:
        return out
    lead = F.regexp_extract("text", "^( ?)", 1)
    again = target.apply(out.withColumn("_lead", lead).withColumn("_lang", F.lit(target_lang)), "text", "_lang")
    text = F.concat("_lead", F.regexp_replace("text", "^[ \\x03]+", ""))
    return again.withColumn("text", text).drop("_lead", "_lang")


def rebuilt_lines(segments: DataFrame, chain: TextChain | None = None) -> DataFrame:
    """Rendered lines of a transcript whose texts went through a chain."""
    chain = chain or TextChain(Gates(short=False))
    return span_lines(chain.apply(segments))
