"""Sample and frame arithmetic on array columns, and spectra in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.binding import bound


def pcm16(sample: Column) -> Column:
    return sample.cast("double") / 32768.0


def resample(samples: Column, rate: Column | int, target: int = 16000) -> Column:
    """Linear interpolation to the target rate; beyond the last sample it holds."""
    rate = F.lit(rate) if isinstance(rate, int) else rate
    ratio = rate / F.lit(float(target))

    def run(x: Column) -> Column:
        n = F.size(x)
        count = F.floor(n / ratio).cast("int")

        def at(i: Column) -> Column:
            place = i * ratio
            low = F.floor(place).cast("int")
            a = F.get(x, F.least(low, n - 1)).cast("double")
            return a + (F.get(x, F.least(low + 1, n - 1)).cast("double") - a) * (place - low)

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))

    return bound(samples, run)


def peak_normalise(samples: Column) -> Column:
    """Divided by the largest magnitude plus 1e-5, unless that is at most 1e-6."""

    def run(x: Column) -> Column:
        peak = F.array_max(F.transform(x, F.abs))
        by = bound(peak, lambda p: F.when(p > 1e-6, p + 1e-5).otherwise(1.0))
        return bound(by, lambda d: F.transform(x, lambda v: v / d))

    return bound(samples.cast("array<double>"), run)


def downmix(samples: Column, channels: int) -> Column:
    """Mean of each group of ``channels`` samples; an incomplete last group is divided by ``channels`` too."""
    groups = F.ceil(F.size(samples) / F.lit(channels)).cast("int")

    def mean(g: Column) -> Column:
        part = F.slice(samples, g * channels + 1, F.lit(channels))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / channels

    return F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), mean)).otherwise(F.array().cast("array<double>"))


def preemphasis(samples: Column, factor: float = 0.97, guard: str = "none") -> Column:
    """x[i] - factor * x[i - 1], the first sample as it is.

    guard: ``input`` takes samples that are not finite as 0, ``result`` sets results that are not finite to 0.
    """

    def finite(x: Column) -> Column:
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    def step(x: Column, before: Column) -> Column:
        y = F.when(before.isNull(), x).otherwise(x - F.lit(factor) * before)
        return finite(y) if guard == "result" else y

    def run(x: Column) -> Column:
        # The same samples one place later meet each other; the last of them has no partner
        later = F.concat(F.array(F.lit(None).cast("double")), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
        return F.when(F.size(x) > 0, F.zip_with(x, later, step)).otherwise(x)

    clean = samples.cast("array<double>")
    return bound(F.transform(clean, finite) if guard == "input" else clean, run)


def argmax_first(values: Column) -> Column:
    """Place of the greatest value from 0, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_last(values: Column) -> Column:
    return (F.size(values) - F.array_position(F.reverse(values), F.array_max(values))).cast("int")


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples))


def mean_absolute_level(samples: Column, gain: float = 8.0) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return F.least(F.lit(1.0), total / F.size(samples) * gain)


def compress_level(ratio: Column, top: float = 20.0) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(ratio, F.lit(1e-6))) / F.log1p(F.lit(top)))


def guarded_log(x: Column) -> Column:
    return F.log(x + 2.0**-24)


def slaney_mel(hz: Column) -> Column:
    """Linear to 1000 Hz, logarithmic above."""
    return F.when(hz < 1000.0, hz * 3.0 / 200.0).otherwise(15.0 + F.log(hz / 1000.0) * 27.0 / np.log(6.4))


def htk_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def hann(n: int, periodic: bool = False) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def mel_filters(n_mels: int, n_fft: int, rate: int = 16000, scale: str = "slaney") -> np.ndarray:
    """Triangles over FFT bins whose area is two over their width in Hz."""
    if scale == "htk":
        to = lambda f: 2595.0 * np.log10(1 + f / 700.0)
        back = lambda m: 700.0 * (10 ** (m / 2595.0) - 1)
    else:
        to = lambda f: f * 0.015 if f < 1000 else 15 + np.log(f / 1000) * 27 / np.log(6.4)
        back = lambda m: np.where(m < 15, m / 0.015, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edges = back(np.linspace(to(0.0), to(rate / 2), n_mels + 2))
    bins = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(
    audio: DataFrame, n_mels: int = 80, n_fft: int = 512, window: int = 400, hop: int = 160, centred: bool = False, scale: str = "slaney"
) -> DataFrame:
    """(media_id, frame, mel array) of (media_id, samples): pre-emphasised samples, padded by half an FFT on both sides,
    Hann window, power spectrum, mel filters, guarded logarithm.

    centred: a periodic window in the middle of the FFT frame, else a symmetric one at its beginning.
    """
    bank, shape = mel_filters(n_mels, n_fft, scale=scale), np.zeros(n_fft)
    at = (n_fft - window) // 2 if centred else 0
    shape[at : at + window] = hann(window, periodic=centred)

    def run(batches):
        for batch in batches:
            for media, samples in zip(batch.column(0), batch.column(1), strict=True):
                x = np.asarray(samples.as_py() or [], dtype=np.float64)
                x = np.pad(x, n_fft // 2)
                n = (len(x) - n_fft) // hop + 1
                frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop][:n] * shape
                power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
                mel = np.log(power @ bank.T + 2.0**-24)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([media.as_py()] * n, type=batch.schema.field(0).type),
                        pa.array(np.arange(n), pa.int32()),
                        pa.array(mel.tolist(), pa.list_(pa.float64())),
                    ],
                    names=["media_id", "frame", "mel"],
                )

    rows = audio.select("media_id", preemphasis(F.col("samples")).alias("samples"))
    kind = rows.schema["media_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"media_id {kind}, frame int, mel array<double>")


def normalise_features(cells: DataFrame) -> DataFrame:
    """(x - mean) / (deviation + 1e-5) of cells (media_id, frame, mel, value) by medium and mel; a lone frame gives NaN."""
    from pyspark.sql import Window

    w = Window.partitionBy("media_id", "mel")
    spread = F.coalesce(F.stddev_samp("value").over(w), F.lit(float("nan")))
    return cells.withColumn("value", (F.col("value") - F.avg("value").over(w)) / (spread + 1e-5))


def band_levels(bins: DataFrame, bands: int = 8, low: float = 80.0, high: float = 4000.0) -> DataFrame:
    """0.6 * rms + 0.4 * max of the magnitudes in log-spaced bands, over 32768 and raised by the root of the band's centre over
    the lowest frequency, for spectra (media_id, frame, hz, magnitude) of 16-bit samples."""
    place = F.floor(F.log(F.col("hz") / low) / float(np.log(high / low)) * bands)
    inside = bins.where((F.col("hz") >= low) & (F.col("hz") < high)).withColumn("band", place.cast("int"))
    level = 0.6 * F.sqrt(F.avg(F.col("magnitude") * F.col("magnitude"))) + 0.4 * F.max("magnitude")
    gain = F.sqrt(F.pow(F.lit(high / low), (F.col("band") + 0.5) / bands)) / 32768.0
    return inside.groupBy("media_id", "frame", "band").agg(level.alias("level")).withColumn("level", F.col("level") * gain)


def loud_enough(samples: DataFrame, least: float = 0.03) -> DataFrame:
    """(media_id, level) of the recordings whose root mean square of (media_id, value) is not below ``least``."""
    level = F.sqrt(F.avg(F.col("value") * F.col("value")))
    return samples.groupBy("media_id").agg(level.alias("level")).where(F.col("level") >= least)


def noise_floor(levels: DataFrame, frames: int = 25, margin: float = 1.2) -> DataFrame:
    """Mean level of each medium's first ``frames`` frames, times the margin; null while there are fewer."""
    first = levels.where(F.col("frame") < frames)
    return first.groupBy("media_id").agg(
        F.when(F.countDistinct("frame") >= frames, F.avg("level") * margin).alias("floor")
    )


def smooth_levels(levels: DataFrame, alpha: float = 0.35) -> DataFrame:
    """Exponential mean over frames of (media_id, frame, level), which starts at the first level.

    A mean depends on the one before it: sorted partitions are read in batches, and one mean is carried on.
    """

    def run(batches):
        last, mean = None, 0.0
        for batch in batches:
            media, level = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for m, x in zip(media, level, strict=True):
                mean = x if m != last else alpha * x + (1 - alpha) * mean
                last = m
                out.append(mean)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["media_id", "frame", "level"])

    rows = levels.select("media_id", F.col("frame").cast("long").alias("frame"), F.col("level").cast("double").alias("level"))
    kind = rows.schema["media_id"].dataType.simpleString()
    ordered = rows.repartition("media_id").sortWithinPartitions("media_id", "frame")
    return ordered.mapInArrow(run, f"media_id {kind}, frame long, level double")
