"""Marks on video frames and detections on animation frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brinewave.operators.windows import cut_spans

REC = "recording_id"

# Colour (red, green, blue) and dot size of each detection type, in order.
MARK_STYLES = [
    ((1, 0, 0), 63),
    ((1, 1, 0), 58),
    ((0, 1, 0), 53),
    ((1, 0, 1), 48),
    ((1, 1, 1), 33),
]


def mark_styles(spark) -> DataFrame:
    """Five rows: method_no, red, green, blue, dot_size."""
    rows = [(n, *colour, size) for n, (colour, size) in enumerate(MARK_STYLES, start=1)]
    return spark.createDataFrame(rows, "method_no int, red int, green int, blue int, dot_size int")


def frame_marks(pixels: DataFrame, n_frames: Column | int) -> DataFrame:
    """The marks that fall on a frame of the video, with the look of their method."""
    styles = F.broadcast(mark_styles(pixels.sparkSession))  # five fixed rows
    limit = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    return pixels.where(F.col("frame").between(1, limit)).join(styles, "method_no")


def animation_frames(dets: DataFrame, frame_len: int, lag: int = 0) -> DataFrame:
    """Which animation frames show a detection.

    Frame k is shown from k*frame_len and takes the detections strictly between
    k*frame_len - lag and (k+1)*frame_len. Each detection goes to at most
    lag / frame_len + 2 frames.
    """
    at = F.col("idx") - 1
    # strict bounds: k > at/len - 1 and k < (at + lag)/len
    first = F.floor(at / frame_len)
    last = F.ceil((at + lag) / frame_len) - 1
    return dets.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))


def frame_audio(blocks: DataFrame, frames: DataFrame, fs: float, length: int, block_len: int) -> DataFrame:
    """Sound for each video frame: `length` samples after its time, zeros outside the recording.

    `blocks` hold one channel; `frames` need recording_id, frame (from 1), fps and
    sync_s, the clock offset of the video.
    """
    at = (F.col("frame") - 1) / F.col("fps") - F.col("sync_s")
    begin = F.rint(at * fs + 1).cast("bigint")
    spans = frames.select(REC, F.col("frame").alias("det_id"), (begin + 1).alias("first_idx"), (begin + length).alias("last_idx"))
    cut = cut_spans(blocks, spans, block_len).select(REC, "det_id", F.col("channels")[0].alias("c"))
    joined = spans.join(cut, [REC, "det_id"], "left")
    zero = F.lit(0.0)
    before = F.least(F.coalesce(F.col("c.first_idx") - F.col("first_idx"), F.lit(length)), F.lit(length)).cast("int")
    kept = F.coalesce("c.samples", F.array().cast("array<double>"))
    after = F.lit(length) - before - F.size(kept)
    padded = F.concat(F.array_repeat(zero, before), kept, F.array_repeat(zero, after))
    return joined.select(REC, F.col("det_id").alias("frame"), padded.alias("samples"))
