"""Trigger times: the first loud sample and its peak."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.functions import kernels
from brinewave.operators.filters import filter_blocks
from brinewave.operators.groups import per_group

REC = "recording_id"
KEYS = [REC, "channel"]

# Share of the maximum that triggers (default, video sound, array sound), seconds in which
# the peak is looked for, leading seconds of array sound, and the mark of a missing crossing.
SHARE, VIDEO_SHARE, AUDIO_SHARE = 0.75, 0.60, 0.81
PEAK_SECONDS, AUDIO_SECONDS = 0.5, 4
NO_CROSSING = -99999999


def _first_where(samples: str, condition) -> Column:
    """1-based place of the first sample that meets the condition, NULL where none does."""
    at = F.array_position(F.transform(samples, lambda v: condition(v)), True)
    return F.when(at > 0, at)


def first_crossing(blocks: DataFrame, threshold: float) -> DataFrame:
    """First sample above the threshold, else above half of it, else the missing mark."""

    def first(level):
        return F.min(F.col("start_idx") - 1 + _first_where("samples", lambda v: v > level))

    found = blocks.groupBy(*KEYS).agg(first(threshold).alias("_a"), first(threshold / 2).alias("_b"))
    return found.select(*KEYS, F.coalesce("_a", "_b", F.lit(NO_CROSSING).cast("bigint")).alias("first_idx"))


def window_crossings(cut: DataFrame, threshold: float) -> DataFrame:
    """For every window and channel the place (from 1) where the window's envelope first exceeds the threshold, else
    half of it, else the missing mark. `cut` are windows as `operators.windows` cuts them."""

    @F.arrow_udf("array<bigint>")
    def run(samples: pa.Array) -> pa.Array:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(samples)
        for mine, x in kernels.stacked(samples):
            y = kernels.envelope(x)
            found = np.full(x.shape[:2], NO_CROSSING, dtype=np.int64)
            for level in (threshold / 2, threshold):  # the whole threshold has the last word
                over = y > level
                found = np.where(over.any(axis=2), over.argmax(axis=2) + 1, found)
            for i, row in zip(mine, found):
                out[i] = row
        return pa.array(out, pa.list_(pa.int64()))

    rows = cut.select(REC, "det_id", F.inline(F.arrays_zip(F.col("channels.channel").alias("channel"), run(F.col("channels.samples")).alias("place"))))
    return rows.select(REC, "det_id", "channel", "place")


def triggers(blocks: DataFrame, fs: float, share: float = SHARE, peak_s: float = PEAK_SECONDS) -> DataFrame:
    """First sample whose magnitude is above share x (signed) maximum, moved to the peak that follows.

    Three passes that each reduce blocks to one row per channel; a block takes part
    in the later ones only where it can matter.
    """
    top = per_group(blocks.groupBy(*KEYS).agg(F.max(F.array_max("samples")).alias("_top")))
    level = F.col("_top") * share
    loud = blocks.join(top, KEYS)
    first = loud.groupBy(*KEYS).agg(
        F.min(F.col("start_idx") - 1 + _first_where("samples", lambda v: F.abs(v) > level)).alias("_first")
    )
    found = first.where(F.col("_first").isNotNull())
    if not peak_s:
        return found.select(*KEYS, F.col("_first").alias("idx"))
    found = per_group(found)
    span = int(round(fs * peak_s))
    last = F.col("start_idx") + F.size("samples") - 1
    near = blocks.join(found, KEYS).where(
        (last >= F.col("_first")) & (F.col("start_idx") <= F.col("_first") + span)
    )
    begin = F.greatest(F.col("_first") - F.col("start_idx"), F.lit(0).cast("bigint"))
    end = F.least(F.col("_first") + span - F.col("start_idx"), F.size("samples").cast("bigint") - 1)
    cut = near.withColumn("_begin", begin).withColumn(
        "_cut", F.slice("samples", (begin + 1).cast("int"), (end - begin + 1).cast("int"))
    )
    peak = F.array_max("_cut")
    at = F.col("start_idx") + F.col("_begin") + F.array_position("_cut", peak) - 1
    best = cut.groupBy(*KEYS).agg(F.max(F.struct(peak.alias("v"), (-at).alias("at"))).alias("_m"))
    return best.select(*KEYS, (-F.col("_m.at")).alias("idx"))


def leading(blocks: DataFrame, n: int) -> DataFrame:
    """The first n samples of every recording."""
    keep = F.least(F.lit(n).cast("bigint") - F.col("start_idx") + 1, F.size("samples").cast("bigint")).cast("int")
    return blocks.where(F.col("start_idx") <= n).withColumn("samples", F.slice("samples", F.lit(1), keep))


def leading_with_halo(blocks: DataFrame, n: int) -> DataFrame:
    """The first n samples of every recording, as if it ended there: right halos end there too."""
    end = F.col("start_idx") + F.size("samples") - 1
    halo = F.least(F.greatest(F.lit(n).cast("bigint") - end, F.lit(0).cast("bigint")), F.size("right_halo").cast("bigint")).cast("int")
    cut = blocks.where(F.col("start_idx") <= n).withColumn("right_halo", F.slice("right_halo", F.lit(1), halo))
    return leading(cut, n)


def trigger_times(video: DataFrame, array: DataFrame, fs: float, band: tuple[float, float] | None = None) -> DataFrame:
    """Trigger seconds of the video's sound and of the array's, NULL where there is none.

    Both hold one channel per recording. With a band both are filtered first, the array's sound as far as it is looked at;
    blocks then need halos of the filter's settling length.
    """
    if band:
        video, array = filter_blocks(video, fs, band), filter_blocks(leading_with_halo(array, AUDIO_SECONDS * fs), fs, band)
    v = triggers(video, fs, VIDEO_SHARE).select(REC, ((F.col("idx") - 1) / fs).alias("video_s"))
    a = triggers(leading(array, AUDIO_SECONDS * fs), fs, AUDIO_SHARE).select(REC, ((F.col("idx") - 1) / fs).alias("audio_s"))
    every = video.select(REC).union(array.select(REC)).distinct()
    return every.join(v, REC, "left").join(a, REC, "left")


def clock_offsets(video: DataFrame, array: DataFrame, fs: float, band: tuple[float, float] | None = None) -> DataFrame:
    """The job of a folder: triggers of both sounds (filtered), and sync_s, how much later the array's began; NULL where
    one of them has no trigger."""
    times = trigger_times(video, array, fs, band)
    return times.withColumn("sync_s", F.col("video_s") - F.col("audio_s"))
