"""Joins on time: by greatest overlap, by point, to the neighbours, and chunk planning.

Interval joins meet on media and time bucket, so a long medium is no single join key; every pair is made once, in the
bucket where the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 60.0


def _bucketed(df: DataFrame, start: str, end: str, seconds: float) -> DataFrame:
    lo = F.floor(F.col(start) / F.lit(seconds))
    return df.withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(lo, F.floor(F.col(end) / F.lit(seconds))))))


def overlap_join(
    sentences: DataFrame, segments: DataFrame, tie: str = "last", keys: list[str] | None = None, bucket: float = BUCKET_SECONDS
) -> DataFrame:
    """Each sentence with the speaker it overlaps most, ``UNKNOWN`` without any overlap.

    sentences: media_id, pos, start, end, ...; segments: media_id, ord, start, end, speaker.  Of equal overlaps the
    first or last segment by ``ord`` wins, as ``tie`` says.
    """
    keys = keys or ["media_id", "pos"]
    left = _bucketed(sentences.select(*keys, "start", "end"), "start", "end", bucket)
    right = _bucketed(
        segments.select("media_id", "ord", F.col("start").alias("s2"), F.col("end").alias("e2"), "speaker"), "s2", "e2", bucket
    )
    overlap = F.least("end", "e2") - F.greatest("start", "s2")
    pairs = (
        left.join(right, ["media_id", "_bucket"])
        .where((F.col("s2") < F.col("end")) & (F.col("e2") > F.col("start")))
        .where(F.col("_bucket") == F.floor(F.greatest("start", "s2") / F.lit(bucket)))
    )
    order = F.col("ord") if tie == "last" else -F.col("ord")
    best = pairs.groupBy(*keys).agg(
        F.max(F.struct(overlap.alias("overlap"), order.alias("order"), F.col("speaker").alias("speaker"))).alias("best")
    )
    return sentences.join(best, keys, "left").select(
        *[sentences[c] for c in sentences.columns],
        F.coalesce("best.speaker", F.lit("UNKNOWN")).alias("speaker"),
        F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"),
    )


def point_join(points: DataFrame, segments: DataFrame, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Each point (media_id, point_id, t) with the first segment that holds it, else the nearest by its edges.

    Segments are [start, end); of equally near ones the first by ``ord`` wins.  A medium without segments gives null.
    Points meet the segments of their own time bucket only; for the others the nearest edge is the last one before or the
    first one after, which a window over points and edges finds.
    """
    keys = ["media_id", "point_id"]
    held = (
        points.withColumn("_bucket", F.floor(F.col("t") / F.lit(bucket)))
        .join(_bucketed(segments.select("media_id", "ord", "start", "end"), "start", "end", bucket), ["media_id", "_bucket"])
        .where((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
        .groupBy(*keys)
        .agg(F.min("ord").alias("_held"))
    )
    edges = segments.select("media_id", "ord", F.explode(F.array("start", "end")).alias("at"))
    # Of edges at one time only the least ord can win
    edges = edges.groupBy("media_id", "at").agg(F.min("ord").alias("ord"))
    both = points.select(*keys, F.col("t").alias("at"), F.lit(None).cast(segments.schema["ord"].dataType).alias("ord")).unionByName(
        edges.select("media_id", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), "at", "ord")
    )
    edge = F.when(F.col("ord").isNotNull(), F.struct("at", "ord"))
    w = Window.partitionBy("media_id").orderBy("at")
    before = F.last(edge, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(edge, ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.withColumns({"_before": before, "_after": after}).where("point_id IS NOT NULL")

    def candidate(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("distance"), F.col(f"{c}.ord").alias("ord")))

    near = near.select(*keys, F.least(candidate("_before"), candidate("_after")).alias("near"))
    return (
        points.join(near, keys, "left")
        .join(held, keys, "left")
        .select(
            *keys,
            "t",
            F.coalesce("_held", "near.ord").alias("ord"),
            F.when(F.col("near").isNotNull(), F.col("_held").isNotNull()).alias("inside"),
        )
    )


def neighbour_segments(points: DataFrame, segments: DataFrame, guard: float = 0.1) -> DataFrame:
    """Start of the previous and next segment from each point: before t - guard (else the last one wraps around),
    after t + guard (else the first one).  Points and starts meet in one ordered window a medium."""
    none = F.lit(None).cast("double")
    starts = segments.select("media_id", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.col("start").alias("at"), F.col("start"))

    def seen(sign: float) -> DataFrame:
        return points.select("media_id", "point_id", (F.col("t") + F.lit(sign * guard)).alias("at"), none.alias("start")).unionByName(starts)

    w = Window.partitionBy("media_id").orderBy("at")
    span = {-1.0: (Window.unboundedPreceding, Window.currentRow), 1.0: (Window.currentRow, Window.unboundedFollowing)}
    found = []
    for sign, pick, name in ((-1.0, F.last, "_prev"), (1.0, F.first, "_next")):
        # A start at the very place does not count
        rows = seen(sign)
        strict = w.orderBy(F.col("at"), F.col("start").isNotNull() if sign < 0 else F.col("start").isNull())
        rows = rows.withColumn(name, pick("start", ignorenulls=True).over(strict.rowsBetween(*span[sign])))
        found.append(rows.where("point_id IS NOT NULL").select("media_id", "point_id", name))
    ends = segments.groupBy("media_id").agg(F.max("start").alias("_last"), F.min("start").alias("_first"))
    return (
        found[0]
        .join(found[1], ["media_id", "point_id"])
        .join(ends, "media_id")
        .select("media_id", "point_id", F.coalesce("_prev", "_last").alias("prev_start"), F.coalesce("_next", "_first").alias("next_start"))
    )


def chunk_plan(media: DataFrame, length: float = 120.0, overlap: float = 15.0) -> DataFrame:
    """Chunks (media_id, chunk, n_chunks, chunk_start, chunk_end) of media (media_id, duration)."""
    step = length - overlap
    n = F.greatest(F.ceil(F.col("duration") / F.lit(step)), F.lit(1))
    return (
        media.withColumn("n_chunks", n)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
        .select(
            "media_id",
            "chunk",
            "n_chunks",
            (F.col("chunk") * step).alias("chunk_start"),
            F.least(F.col("chunk") * step + length, F.col("duration")).alias("chunk_end"),
        )
    )


def owns(middle: Column, chunk: Column, n_chunks: Column, length: float = 120.0, overlap: float = 15.0) -> Column:
    """Whether a chunk owns a token whose middle (in chunk time) is given; a lone chunk counts as the first."""
    half = overlap / 2
    first = chunk == 0
    last = ~first & (chunk == n_chunks - 1)
    low = F.when(first, 0.0).otherwise(half)
    high = F.when(last, length).otherwise(length - half)
    return (middle >= low) & (middle < high)


def merge_chunks(tokens: DataFrame, length: float = 120.0, overlap: float = 15.0) -> DataFrame:
    """Chunk tokens (media_id, chunk, n_chunks, chunk_start, start, end, text) on the medium's time, each kept once."""
    middle = (F.col("start") + F.col("end")) / 2
    return tokens.where(owns(middle, F.col("chunk"), F.col("n_chunks"), length, overlap)).select(
        "media_id",
        "chunk",
        (F.col("start") + F.col("chunk_start")).alias("start"),
        (F.col("end") + F.col("chunk_start")).alias("end"),
        "text",
    )
