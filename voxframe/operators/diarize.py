"""Who speaks when: smoothing and binarising speaker probabilities, and scoring frames for a speaker cache."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frame length in seconds of the probabilities.
FRAME_SECONDS = 0.08


@dataclass(frozen=True)
class Thresholds:
    """Onset and offset of activity, pads before and after in seconds, least activity and least pause."""

    onset: float = 0.64
    offset: float = 0.56
    pad_on: float = 0.0
    pad_off: float = 0.0
    min_on: float = 0.1
    min_off: float = 0.1


def sensitivity_thresholds(s: Column, preset: Thresholds = Thresholds()) -> Column:
    """(onset, offset) of a sensitivity clamped to 0..1: the preset near one half, else a line."""
    x = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    near = F.abs(x - 0.5) < 0.01
    return F.struct(
        F.when(near, preset.onset).otherwise(F.lit(0.4) + F.lit(0.3) * x).alias("onset"),
        F.when(near, preset.offset).otherwise(F.lit(0.3) + F.lit(0.3) * x).alias("offset"),
    )


_KEY = ["media_id", "speaker_id"]


def median_smooth(frames: DataFrame, half: int = 5) -> DataFrame:
    """Upper median of up to 2 * half + 1 frames around each (media_id, speaker_id, frame, p)."""
    w = Window.partitionBy(*_KEY).orderBy("frame").rowsBetween(-half, half)
    ordered = F.array_sort(F.collect_list("p").over(w))
    return frames.withColumn("_near", ordered).withColumn(
        "p", F.element_at("_near", F.floor(F.size("_near") / 2).cast("int") + 1)
    ).drop("_near")


def active_frames(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Frames with ``active``: on at p >= onset, off at p < offset, at most one change a frame.

    With onset >= offset the last decisive frame tells the state.  Otherwise frames between the two toggle it, which only
    a fold over a medium's frames can follow.
    """
    if t.onset >= t.offset:
        mark = F.when(F.col("p") >= t.onset, 1).when(F.col("p") < t.offset, 0)
        w = Window.partitionBy(*_KEY).orderBy("frame")
        return frames.withColumn("active", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)) == 1)

    def run(batches):
        last, on = None, False
        for batch in batches:
            out = []
            for media, speaker, p in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (media, speaker) != last:
                    last, on = (media, speaker), False
                on = p >= t.offset if on else p >= t.onset
                out.append(on)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*_KEY, "frame", "p", "active"])

    rows = frames.select(*_KEY, F.col("frame").cast("int").alias("frame"), F.col("p").cast("double").alias("p"))
    ordered = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "frame")
    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("active", T.BooleanType())]))


def activity_segments(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Segments (media_id, speaker_id, start, end) of active frames, padded, without the too short ones.

    A segment runs from its first active frame to the first inactive one after it, or to the end of the frames.
    """
    w = Window.partitionBy(*_KEY).orderBy("frame")
    marked = active_frames(frames, t)
    new = (F.col("active") != F.coalesce(F.lag("active").over(w), F.lit(False))).cast("int")
    runs = marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).where("active")
    start = F.greatest(F.min("frame") * FRAME_SECONDS - t.pad_on, F.lit(0.0))
    end = (F.max("frame") + 1) * FRAME_SECONDS + t.pad_off
    return (
        runs.groupBy(*_KEY, "_run")
        .agg(start.alias("start"), end.alias("end"))
        .where(F.col("end") - F.col("start") >= t.min_on)
        .drop("_run")
    )


def merge_close(segments: DataFrame, min_off: float = 0.1) -> DataFrame:
    """Segments of one speaker joined where the pause is shorter than ``min_off``; the later one's end counts."""
    w = Window.partitionBy(*_KEY).orderBy("start", "end")
    apart = F.coalesce((F.col("start") - F.lag("end").over(w) >= min_off).cast("int"), F.lit(1))
    return (
        segments.withColumn("_apart", apart)
        .withColumn("_group", F.sum("_apart").over(w))
        .groupBy(*_KEY, "_group")
        .agg(F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"))
        .drop("_group")
    )


def diarize(frames: DataFrame, t: Thresholds = Thresholds(), half: int = 5) -> DataFrame:
    """Smoothed, binarised and merged segments of every speaker."""
    return merge_close(activity_segments(median_smooth(frames, half), t), t.min_off)


def log_odds(frames: DataFrame, floor: float = 0.25) -> DataFrame:
    """Score of each (media_id, frame, speaker_id, p): ln p - ln(1 - p) + sum over speakers of ln(1 - p) - ln 0.5, with
    p raised to ``floor`` first, and then 1 - p."""
    raised = F.greatest(F.col("p"), F.lit(floor))
    log_p = F.log(raised)
    log_q = F.log(F.greatest(1 - raised, F.lit(floor)))
    everyone = F.sum(log_q).over(Window.partitionBy("media_id", "frame"))
    return frames.withColumn("score", log_p - log_q + everyone - F.log(F.lit(0.5)))


def disable_low(scored: DataFrame, least: float = 0.5, enough: int = 22) -> DataFrame:
    """Scores with -infinity where p is not above ``least``, and where a score is not positive although the speaker has
    ``enough`` positive ones."""
    low = F.lit(float("-inf"))
    first = scored.withColumn("score", F.when(F.col("p") > least, F.col("score")).otherwise(low))
    positive = F.count_if(F.col("score") > 0).over(Window.partitionBy(*_KEY))
    return (
        first.withColumn("n_positive", positive)
        .withColumn("score", F.when((F.col("score") <= 0) & (F.col("n_positive") >= enough), low).otherwise(F.col("score")))
    )


def boost_top(scored: DataFrame, k: int, scale: float) -> DataFrame:
    """Adds -scale * ln 0.5 to each speaker's ``k`` best frames (ties: the earlier frame); -infinity keeps its rank and
    stays."""
    w = Window.partitionBy(*_KEY).orderBy(F.col("score").desc(), "frame")
    extra = -scale * F.log(F.lit(0.5))
    return scored.withColumn("_rank", F.row_number().over(w)).withColumn(
        "score", F.when(F.col("_rank") <= k, F.col("score") + extra).otherwise(F.col("score"))
    ).drop("_rank")


def boost(scored: DataFrame, passes: tuple[tuple[int, float], ...] = ((33, 2.0), (66, 1.0))) -> DataFrame:
    """Each speaker's best frames lifted in passes (how many, how far); a later pass ranks what the earlier one made."""
    for k, scale in passes:
        scored = boost_top(scored, k, scale)
    return scored


def cache_frames(scored: DataFrame, k: int = 188, silent: int = 3) -> DataFrame:
    """Slots (media_id, slot, speaker_id, frame, disabled) of each medium's ``k`` best cells (speaker, frame).

    ``silent`` placeholders a speaker, after its frames, outrank every score.  Slots go by speaker and frame, but cells
    of score -infinity come last.  Those and the placeholders are disabled: they have neither speaker nor frame.
    """
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    cells = scored.select("media_id", "speaker_id", "frame", F.lit(0).alias("_place"), F.col("score").cast("double").alias("score"))
    places = F.explode(F.sequence(F.lit(1), F.lit(silent))).alias("_place")
    speakers = cells.select("media_id", "speaker_id").distinct()
    if silent:
        held = speakers.select("media_id", "speaker_id", F.lit(None).cast(scored.schema["frame"].dataType).alias("frame"), places, high.alias("score"))
        cells = cells.unionByName(held)
    flat = ["speaker_id", "_place", "frame"]
    best = Window.partitionBy("media_id").orderBy(F.col("score").desc(), *flat)
    kept = cells.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    void = F.col("score") == low
    order = Window.partitionBy("media_id").orderBy(void, *flat)
    disabled = void | (F.col("_place") > 0)
    return kept.select(
        "media_id",
        (F.row_number().over(order) - 1).alias("slot"),
        F.when(~disabled, F.col("speaker_id")).alias("speaker_id"),
        F.when(~disabled, F.col("frame")).alias("frame"),
        disabled.alias("disabled"),
    )


def silence_mean(frames: DataFrame, probabilities: DataFrame, under: float = 0.2) -> DataFrame:
    """Mean vector (media_id, dim, value) of the frames (media_id, frame, vector) whose speaker probabilities sum to
    less than ``under``."""
    quiet = probabilities.groupBy("media_id", "frame").agg(F.sum("p").alias("_p")).where(F.col("_p") < under)
    cells = frames.join(quiet, ["media_id", "frame"], "left_semi").select("media_id", F.posexplode("vector").alias("dim", "x"))
    return cells.groupBy("media_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def gather(slots: DataFrame, frames: DataFrame, silence: DataFrame) -> DataFrame:
    """Vectors of cache slots (media_id, slot, frame, disabled); disabled slots get the silence vector."""
    quiet = silence.groupBy("media_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda c: c["value"]).alias("_quiet")
    )
    vector = F.transform("vector", lambda x: x.cast("double"))
    return (
        slots.join(frames.select("media_id", "frame", "vector"), ["media_id", "frame"], "left")
        .join(quiet, "media_id", "left")
        .select("media_id", "slot", "frame", F.when(F.col("disabled"), F.col("_quiet")).otherwise(vector).alias("vector"))
    )
