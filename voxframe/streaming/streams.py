"""The stateful operators over Structured Streaming.  State is keyed by user or stream, bounded, and on event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.intervals import merge_chunks
from voxframe.operators.listening import ChunkedRecogniser, ContextRecogniser, LevelMeter, UtteranceRecogniser
from voxframe.operators.session import Keys, Utterances
from voxframe.operators.speakercache import CacheSizes, StreamingDiarizer
from voxframe.sources.wire import parse_request
from voxframe.streaming.folding import fold_stream


def requests(lines: DataFrame) -> DataFrame:
    """Request lines of a stream (value) as columns."""
    return lines.select(parse_request(F.col("value")).alias("r")).select("r.*")


def session_windows(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of bursts of events (user_id, ts); a gap of exactly ``gap`` does not end one."""
    w = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def owned_tokens(tokens: DataFrame, length: float = 120.0, overlap: float = 15.0, late: str = "5 minutes") -> DataFrame:
    """Streaming form of intervals.merge_chunks: chunk tokens (media_id, chunk, n_chunks, pos, chunk_start, start, end, text,
    ts) on the medium's time, each by the one chunk that owns its middle, also where a chunk is sent again."""
    fresh = tokens.withWatermark("ts", late).dropDuplicatesWithinWatermark(["media_id", "chunk", "pos"])
    return merge_chunks(fresh, length, overlap)


def owned_chunks(tokens: DataFrame, length: int = 120, overlap: int = 15, late: str = "5 minutes") -> DataFrame:
    """(media_id, start, end, n) of tokens (media_id, ts): how many fall into each of the overlapping chunks that own them.

    A token lies in up to two event windows; the one whose middle part holds it counts it, so the counts add up to the
    tokens.  A window is given once the watermark has passed its end.
    """
    step = length - overlap
    w = F.window("ts", f"{length} seconds", f"{step} seconds")
    placed = tokens.withWatermark("ts", late).select("media_id", "ts", w.alias("w"))
    into = F.col("ts").cast("double") - F.col("w.start").cast("timestamp").cast("double")
    owned = placed.where((into >= overlap / 2) & (into < length - overlap / 2))
    counted = owned.groupBy("media_id", "w").agg(F.count("*").alias("n"))
    return counted.select("media_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def level_meter(blocks: DataFrame, late: str = "10 seconds", **options) -> DataFrame:
    """(media_id, chunk, levels) of blocks (media_id, seq, ts, samples): see listening.LevelMeter."""
    return fold_stream(blocks, ["media_id"], ["seq"], LevelMeter(**options), "ts", late)


def continue_utterances(
    utterances: DataFrame, words: dict[str, frozenset[str]], keywords: tuple[str, ...] = (), ttl: int = 30, late: str = "10 seconds"
) -> DataFrame:
    """Streaming form of session.fold_utterances; the end of a user's last text expires on event time."""
    return fold_stream(utterances, ["user_id"], ["seq"], Utterances(words, keywords, ttl), "ts", late)


def push_to_talk(events: DataFrame, debounce: float = 150, cooldown: float = 500, hold: float = 300, late: str = "10 seconds") -> DataFrame:
    """Streaming form of session.debounce_keys over key events (user_id, ms, value); ms is the event time."""
    timed = events.withColumn("ts", F.timestamp_millis(F.col("ms").cast("long")))
    return fold_stream(timed, ["user_id"], ["ms", "value"], Keys(debounce, cooldown, hold), "ts", late)


def stream_diarizer(frames: DataFrame, factory: Callable, sizes: CacheSizes = CacheSizes(), idle: float = 5000.0, late: str = "10 seconds") -> DataFrame:
    """(media_id, frame, p) of feature rows (media_id, i, ts, vector): see speakercache.StreamingDiarizer."""
    return fold_stream(frames, ["media_id"], ["i"], StreamingDiarizer(factory, sizes, idle), "ts", late)


def stream_chunks(blocks: DataFrame, factory: Callable, late: str = "10 seconds", **options) -> DataFrame:
    """(media_id, pos, id, frame) of blocks (media_id, seq, ts, samples): see listening.ChunkedRecogniser."""
    return fold_stream(blocks, ["media_id"], ["seq"], ChunkedRecogniser(factory, **options), "ts", late)


def stream_recogniser(blocks: DataFrame, factory: Callable, blank: int, end: int, late: str = "10 seconds", **options) -> DataFrame:
    """(media_id, seq, text) of blocks (media_id, seq, ts, samples): see listening.UtteranceRecogniser."""
    return fold_stream(blocks, ["media_id"], ["seq"], UtteranceRecogniser(factory, blank, end, **options), "ts", late)


def recognise_in_context(recordings: DataFrame, factory: Callable, mode: str = "times", late: str = "10 seconds", **options) -> DataFrame:
    """(user_id, seq, text, with_context, failed) of recordings (user_id, seq, ts, samples): see listening.ContextRecogniser."""
    return fold_stream(recordings, ["user_id"], ["seq"], ContextRecogniser(factory, mode, **options), "ts", late)


def run_batches(lines: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """A request loop: each micro-batch of requests goes through ``handle``; the query that does it is returned."""
    return (
        requests(lines).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
