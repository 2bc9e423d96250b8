"""Detection on growing recordings.

Blocks come from `sources.pcm.stream_pcm`. Filters, envelopes, peaks and frame
spectra are per block, so the batch operators run on a stream as they are, with
a fixed threshold. Trains need state per recording.

Late rows: the reference has no rule. Here event time is sample time; Spark drops
rows older than the watermark, and nothing younger is decided before the
watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brinewave.operators import impulses

TRAIN = "recording_id string, start_idx bigint, end_idx bigint, last_member_idx bigint, n_dets bigint, level double"
STATE = (
    "idx array<bigint>, peak array<double>, at array<bigint>, decided bigint, "
    "start_idx bigint, last_idx bigint, n_dets bigint, level double"
)


def live_impulses(blocks: DataFrame, fs: float, band, ref_channel: int, dist: int, threshold: float, started: Column) -> DataFrame:
    """Impulses of streamed blocks, with the event time `ts` of each; `started` is the recording's start time."""
    found = impulses.detect_impulses(blocks, fs, band, ref_channel, dist, threshold)
    micros = F.rint(F.col("t_s") * 1_000_000).cast("bigint")
    return found.withColumn("ts", F.timestamp_micros(F.unix_micros(started) + micros))


def live_counts(dets: DataFrame, delay: str, length: str) -> DataFrame:
    """Detections per recording, kind and window of event time."""
    late = dets.withWatermark("ts", delay)
    counted = late.groupBy("recording_id", "kind", F.window("ts", length)).agg(F.count("*").alias("n"))
    return counted.select("recording_id", "kind", F.col("window.start").alias("start"), "n")


def live_trains(dets: DataFrame, min_len: int, interval: int, fs: float, delay: str) -> DataFrame:
    """Trains of streamed detections (recording_id, idx, peak, ts), each given out when it is closed.

    State per recording: the clicks that can still change (those within `interval`
    of the watermark and min_len before them) and the open train. A train stays
    open until a click that is no member follows, as in the batch operator.
    """
    interval_ms = int(np.ceil(interval / fs * 1000))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            idx, peak, at, decided, start, last, count, level = state.get
            idx, peak, at = list(idx), list(peak), list(at)
        else:
            idx, peak, at, decided, start, last, count, level = [], [], [], 0, None, None, 0, None
        for batch in batches:
            idx += batch["idx"].tolist()
            peak += batch["peak"].tolist()
            at += batch["at"].tolist()
        order = np.argsort(np.array(idx, dtype=np.int64), kind="stable")
        idx, peak, at = ([v[i] for i in order] for v in (idx, peak, at))
        places = np.array(idx, dtype=np.int64)
        starts = np.zeros(len(idx), dtype=bool)
        if len(idx) > min_len:
            starts[:-min_len] = places[min_len:] - places[:-min_len] < interval
        member = [bool(starts[max(0, i - min_len) : i + 1].any()) for i in range(len(idx))]
        watermark = state.getCurrentWatermarkMs()
        out, known = [], decided
        while known < len(idx) and at[known] + interval_ms < watermark:
            if member[known]:
                start = idx[known] if start is None else start
                level = peak[known] if level is None else max(level, peak[known])
                last, count = idx[known], count + 1
            elif start is not None:
                out.append((key[0], start, idx[known], last, count, level))
                start, last, count, level = None, None, 0, None
            known += 1
        drop = max(0, known - min_len)
        idx, peak, at, known = idx[drop:], peak[drop:], at[drop:], known - drop
        state.update((idx, peak, at, known, start, last, count, level))
        if known < len(idx):
            state.setTimeoutTimestamp(max(at[known] + interval_ms + 1, watermark + 1))
        yield pd.DataFrame(out, columns=["recording_id", "start_idx", "end_idx", "last_member_idx", "n_dets", "level"])

    late = dets.withWatermark("ts", delay).select(
        F.col("recording_id").cast("string").alias("recording_id"), "idx", "peak", "ts", F.unix_millis("ts").alias("at")
    )
    return late.groupBy("recording_id").applyInPandasWithState(
        step, TRAIN, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )

